"""Derivation samplers over a synchronous grammar with one nonterminal.

A derivation of a sentence pair is a set of rules (k, s, t). Symbols are words, or NONTERMINAL + k for the place of rule k; rule 0 is the top. Rules are dishes
of a restaurant in which each different rule has one table. A round walks over all sentences: those of a shard one after the other in one task, against
counts that are exact for the shard and from the round before for the rest of the corpus. A state is a table (sid, rules, names), so that to save
and restore a chain is to write and read it; each round's draws depend on seed, round and shard only.

Defined results: pairs with an empty or null side have no derivation and are left out; equal pairs are sentences of their own; words must not start with NONTERMINAL.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONTERMINAL, APART = "\x01", "\x1f"
STATE = "sid string, rules array<struct<k:int,s:array<string>,t:array<string>>>, names array<string>"
Side = tuple[str, ...]


def places(side: Side) -> list[str]:
    return [x for x in side if x.startswith(NONTERMINAL)]


def arity(s: Side) -> int:
    return len(places(s))


def is_insertion(s: Side, t: Side) -> bool:
    """The source is a place only, the target has words beside it."""
    return len(s) == 1 and arity(s) == 1 and 0 < arity(t) < len(t)


def is_part(s: Side, t: Side, whole: tuple[Side, Side]) -> bool:
    """Both sides hold the same places, and it is not all of the rule."""
    return (s, t) != whole and sorted(places(s)) == sorted(places(t))


def split(rule: tuple[Side, Side], i: int, j: int, u: int, v: int, place: str) -> tuple[Side, Side]:
    """The rule with a place for s[i:j] and t[u:v]."""
    s, t = rule
    return (*s[:i], place, *s[j:]), (*t[:u], place, *t[v:])


def combined(rule: tuple[Side, Side], place: str, child: tuple[Side, Side]) -> tuple[Side, Side]:
    """The rule with the child's sides at its place."""
    put = lambda side, mine: tuple(y for x in side for y in (mine if x == place else (x,)))
    return put(rule[0], child[0]), put(rule[1], child[1])


def name(rule: tuple[Side, Side]) -> str:
    """The rule with its places numbered along the source: equal for equal rules of all derivations."""
    number = {x: f"{NONTERMINAL}{n}" for n, x in enumerate(places(rule[0]))}
    return (APART * 2).join(APART.join(number.get(x, x) for x in side) for side in rule)


def read(rules: dict[int, tuple[Side, Side]], k: int = 0) -> tuple[Side, Side]:
    """The sentence pair of a derivation."""
    rule = rules[k]
    for x in places(rule[0]):
        rule = combined(rule, x, read(rules, int(x[1:])))
    return rule


def from_links(s: Side, t: Side, links: list[tuple[int, int]]) -> dict[int, tuple[Side, Side]]:
    """A derivation from word links: the smallest blocks that no link leaves are children of the top rule, unlinked words stay in it."""
    blocks = [({i}, {u}) for i, u in links]
    span = lambda x: set(range(min(x), max(x) + 1))
    while True:
        blocks = [(span(a), span(b)) for a, b in blocks]
        met = next(((x, y) for x in range(len(blocks)) for y in range(x) if blocks[x][0] & blocks[y][0] or blocks[x][1] & blocks[y][1]), None)
        if met is None:
            break
        x, y = blocks.pop(met[0]), blocks.pop(met[1])
        blocks.append((x[0] | y[0], x[1] | y[1]))
    if len(blocks) == 1 and len(blocks[0][0]) == len(s) and len(blocks[0][1]) == len(t):
        blocks = []
    blocks.sort(key=lambda b: min(b[0]))
    out = {k: (tuple(s[i] for i in sorted(a)), tuple(t[u] for u in sorted(b))) for k, (a, b) in enumerate(blocks, 1)}

    def top(side: Side, which: int) -> Side:
        starts, inside = {min(b[which]): k for k, b in enumerate(blocks, 1)}, set().union(*[b[which] for b in blocks])
        return tuple(f"{NONTERMINAL}{starts[i]}" if i in starts else x for i, x in enumerate(side) if i in starts or i not in inside)

    return {0: (top(s, 0), top(t, 1)), **out}


class Room:
    """Counts of rules and the probability of the next one. `others` counts what lies outside the shard."""

    def __init__(self, others: dict[str, int], total: int, types: int, discount: float, strength: float, rate: float, word: float):
        self.own: dict[str, int] = {}
        self.others, self.total, self.types = others, total, types
        self.discount, self.strength, self.rate, self.word = discount, strength, rate, math.log(word)
        self.sources = {x.split(APART * 2, 1)[0] for x in others}  # of all rules that were ever counted
        self._bases: dict[tuple[int, int, int], float] = {}

    def count(self, key: str) -> int:
        return self.own.get(key, 0) + self.others.get(key, 0)

    def put(self, key: str, n: int) -> None:
        """Own counts that the totals know already."""
        self.own[key] = self.own.get(key, 0) + n
        self.sources.add(key.split(APART * 2, 1)[0])

    def add(self, rule: tuple[Side, Side], n: int = 1) -> None:
        key = name(rule)
        before = self.count(key)
        self.put(key, n)
        self.total += n
        self.types += (before + n > 0) - (before > 0)

    def base(self, rule: tuple[Side, Side]) -> float:
        return self.base_of(len(rule[0]), len(rule[1]), sum(len(x) - arity(x) for x in rule))

    def base_of(self, s: int, t: int, words: int) -> float:
        """Poisson lengths of both sides and a price for each word."""
        got = self._bases.get((s, t, words))
        if got is None:
            got = self._bases[s, t, words] = sum(x * math.log(self.rate) - self.rate - math.lgamma(x + 1) for x in (s, t)) + self.word * words
        return got

    def log_prob(self, *rules: tuple[Side, Side]) -> float:
        return self.log_prob_of(*((self.count(name(r)), self.base(r)) for r in rules))

    def log_prob_of(self, *rules: tuple[int, float]) -> float:
        """The same of rules with such counts and bases."""
        out, new, all_ = 0.0, math.log(self.strength + self.discount * self.types), math.log(self.total + self.strength)
        for c, base in rules:
            fresh = new + base  # of a long rule below the range of doubles
            if c > 0:
                seen = math.log(c - self.discount)
                fresh = max(seen, fresh) + math.log1p(math.exp(-abs(seen - fresh)))
            out += fresh - all_
        return out


def _stays(weights: list[float]) -> list[float]:
    """Running sums of the shares of log weights; the last is 1."""
    top = max(weights)
    weights = [math.exp(x - top) for x in weights]
    all_ = sum(weights)
    sums = list(accumulate(x / all_ for x in weights))
    return [x / sums[-1] for x in sums]


def _parts(rule: tuple[Side, Side], i: int, j: int, most: int) -> list[tuple[int, int]]:
    """Spans (u, v) of target symbols that hold the same places as the source symbols i to j, if that is not all of the rule."""
    s, t = rule[0][i:j], rule[1]
    want, n = set(places(s)), len(t)
    mine = [x.startswith(NONTERMINAL) for x in t]
    if not any(mine):
        spans = [] if want else [(u, v) for u in range(n) for v in range(min(n, u + most), u, -1)]
    else:
        before = [0, *accumulate(mine)]
        fits = [x in want for x in t]
        good = [0, *accumulate(fits)]
        spans = [(u, v) for u in range(n) for v in range(min(n, u + most), u, -1) if good[v] - good[u] == len(want) == before[v] - before[u]]
    return [x for x in spans if x != (0, n)] if j - i == len(rule[0]) else spans


class _Splits:
    """Log weights of the rule with a place for s[i:j] and t[u:v] together with that child. Both rules' names are made only where a rule with their source
    is counted; elsewhere a weight depends on lengths alone."""

    def __init__(self, rule: tuple[Side, Side], i: int, j: int, room: Room):
        (s, t), self.room, self.width = rule, room, j - i
        inside, held = places(s[i:j]), set(s[i:j])
        number = {x: f"{NONTERMINAL}{n}" for n, x in enumerate(inside)}
        self.child = APART.join(number.get(x, x) for x in s[i:j]) + APART * 2
        place = f"{NONTERMINAL}{arity(s[:i])}"
        rest = {x: f"{NONTERMINAL}{n}" for n, x in enumerate(y for y in (*s[:i], NONTERMINAL, *s[j:]) if y.startswith(NONTERMINAL))}
        self.left = APART.join((*(rest.get(x, x) for x in s[:i]), place, *(rest.get(x, x) for x in s[j:]))) + APART * 2
        self.ask = self.left[:-2] in room.sources, self.child[:-2] in room.sources
        self.t_child = [number.get(x, x) for x in t] if self.ask[1] else []
        self.t_left = [x if x in held else rest.get(x, x) for x in t] if self.ask[0] else []
        self.place, self.inner = place, len(inside)
        self.s_left, self.n_t = len(s) - self.width + 1, len(t)
        self.words_left = self.s_left - 1 - (arity(s) - len(inside)), self.n_t - (arity(t) - len(inside))
        self.plain: dict[int, float] = {}

    def __call__(self, u: int, v: int) -> tuple[int, float]:
        """Key and log weight: equal keys have equal weights."""
        d = v - u
        a = self.room.count(self.left + APART.join((*self.t_left[:u], self.place, *self.t_left[v:]))) if self.ask[0] else 0
        b = self.room.count(self.child + APART.join(self.t_child[u:v])) if self.ask[1] else 0
        if a <= 0 and b <= 0 and d in self.plain:
            return d, self.plain[d]
        left = self.room.base_of(self.s_left, self.n_t - d + 1, sum(self.words_left) - d)
        child = self.room.base_of(self.width, d, self.width - self.inner + d - self.inner)
        got = self.room.log_prob_of((a, left), (b, child))
        if a <= 0 and b <= 0:
            self.plain[d] = got
            return d, got
        return -1, got


def walk(rules: dict, room: Room, rng, heat: float = 1.0, every: bool = False, most: int = 9, most_arity: int = 2) -> None:
    """Samples the rules of one derivation from the top down, wide parts first, and changes them and the room. Binary: each possible child is decided for by
    itself; every: one draw among all target spans of a source part and the rule as it is. A child has at most `most` symbols a side when it is made."""
    todo, draw = [0], rng.random

    def joined(k: int, place: str) -> bool:
        """Whether rule k took over the child at its place."""
        old, rule = int(place[1:]), combined(rules[k], place, rules[int(place[1:])])
        room.add(rules[old], -1)
        if draw() < _stays([heat * room.log_prob(rules[k], rules[old]), heat * room.log_prob(rule)])[0]:
            room.add(rules[old])
            return False
        del rules[old]
        rules[k] = rule
        return True

    def cut(k: int, i: int, j: int, alone: float) -> bool:
        """Whether rule k gave s[i:j] and some t[u:v] to a new child."""
        spans = _parts(rules[k], i, j, most)
        if not spans:
            if every:
                draw()
            return False
        weight, limits, taken = _Splits(rules[k], i, j, room), {}, None
        if every:
            pick = bisect_right(_stays([heat * alone, *(heat * weight(u, v)[1] for u, v in spans)]), draw())
            taken = spans[pick - 1] if pick else None
        else:
            for u, v in spans:
                key, w = weight(u, v)
                limit = limits.get(key)
                if limit is None:
                    limit = _stays([heat * alone, heat * w])[0]
                    if key >= 0:
                        limits[key] = limit
                if draw() >= limit:
                    taken = u, v
                    break
        if taken is None:
            return False
        new = max(rules) + 1
        child = rules[k][0][i:j], rules[k][1][taken[0] : taken[1]]
        rules[k] = split(rules[k], i, j, *taken, f"{NONTERMINAL}{new}")
        rules[new] = child
        room.add(child)
        return True

    while todo:
        k = todo.pop()
        room.add(rules[k], -1)
        alone = room.log_prob(rules[k])
        for width in range(min(len(rules[k][0]), most), 0, -1):
            i = 0
            while i + width <= len(rules[k][0]):
                part = rules[k][0][i : i + width]
                if width == 1 and arity(part):
                    changed = dropped = joined(k, part[0])
                else:
                    changed, dropped = arity(part) <= most_arity and cut(k, i, i + width, alone), False
                    if every and arity(part) > most_arity:
                        draw()
                if changed:
                    alone = room.log_prob(rules[k])
                i += not dropped
        room.add(rules[k])
        todo += [int(x[1:]) for x in places(rules[k][0])]


def _row(sid: str, rules: dict) -> tuple:
    return sid, [{"k": k, "s": list(s), "t": list(t)} for k, (s, t) in sorted(rules.items())], [name(r) for r in rules.values()]


def _checked(*sides: Side) -> None:
    if any(places(x) for x in sides):
        raise ValueError("a word starts like a place")


def started(pairs: DataFrame, links: bool = False) -> DataFrame:
    """The first state of pairs (sid, src, trg): a rule for the whole pair, or, with a column links (array of struct i, u), rules from the links."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                s, t = tuple(r.src), tuple(r.trg)
                _checked(s, t)
                out.append(_row(r.sid, from_links(s, t, [(x["i"], x["u"]) for x in r.links]) if links else {0: (s, t)}))
            yield pd.DataFrame(out, columns=["sid", "rules", "names"])

    cols = ["sid", "src", "trg", *(["links"] if links else [])]
    return pairs.filter("size(src) > 0 AND size(trg) > 0").select(*cols).mapInPandas(run, STATE)


def rule_counts(state: DataFrame) -> DataFrame:
    """rule, n"""
    return state.select(F.explode("names").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def sampled(state: DataFrame, round_: int, seed: int, every: bool = False, heat: float = 1.0, most: int = 9, shard_of: int = 256, discount: float = 0.1, strength: float = 1.0, rate: float = 2.0, word: float = 0.001) -> DataFrame:
    """The state after one more round. Shards hold about `shard_of` sentences; state must be written, it is read twice."""
    import pandas as pd

    size = state.count()
    shards = max(1, -(-size // shard_of))
    tasks = max(2 * state.sparkSession.sparkContext.defaultParallelism, min(shards // 16, 100_000))  # given, as the work is large where the rows are few bytes
    counts = rule_counts(state)
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    dealt = state.withColumn("shard", F.pmod(F.xxhash64(F.lit(round_), "sid"), F.lit(shards)))
    own = dealt.select(F.col("shard").alias("part"), F.explode("names").alias("rule")).groupBy("part", "rule").agg(F.count(F.lit(1)).alias("own"))
    known = own.join(counts.filter("n > 1"), "rule").filter("n > own").select("part", "rule", (F.col("n") - F.col("own")).alias("n"))

    def run(key, rows, known):
        import numpy as np

        rng = np.random.default_rng([seed, round_, int(key[0])])
        room = Room(dict(zip(known["rule"], known["n"], strict=True)), total, types, discount, strength, rate, word)
        trees = []
        for r in rows.sort_values("sid").itertuples(index=False):
            trees.append((r.sid, {x["k"]: (tuple(x["s"]), tuple(x["t"])) for x in r.rules}))
        for _, rules in trees:  # totals know the shard's own rules already
            for rule in rules.values():
                room.put(name(rule), 1)
        for _, rules in trees:
            walk(rules, room, rng, heat, every, most)
        return pd.DataFrame([_row(*x) for x in trees], columns=["sid", "rules", "names"])

    return dealt.repartition(tasks, "shard").groupBy("shard").cogroup(known.repartition(tasks, "part").groupBy("part")).applyInPandas(run, STATE)
