"""Word alignment models and grammar statistics."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.functions.special import lgamma, log_poisson
from loomcount.sources.tables import multiplied, written

NULL = "<null>"


def word_links(pairs: DataFrame, src: Column, trg: Column) -> DataFrame:
    """sid, s, t, n: how often a source word (with the null word) and a target word meet in a pair. Repeats are counted, not repeated. Pairs are dealt by sid, so
    that what follows inside a sid moves no links."""
    p = pairs.select("sid", F.concat(F.array(F.lit(NULL)), src).alias("s"), trg.alias("t"))
    p = multiplied(p, F.size("s") * F.size("t"), "sid")
    a = p.select("sid", F.explode("s").alias("s"), "t").select("sid", "s", F.explode("t").alias("t"))
    return a.groupBy("sid", "s", "t").agg(F.count(F.lit(1)).alias("n"))


def model1(links: DataFrame, rounds: int, written=written) -> DataFrame:
    """s, t, p after so many EM rounds from a uniform start; `written` cuts the lineage between rounds. Links are made anew in each round, as they are many times
    their texts. From the second on they meet the table once and go back to their sid once; the sums of a target word's occurrence are windows there."""
    occurrence = W.partitionBy("sid", "t")
    probs = None
    for _ in range(rounds):
        met = links.withColumn("p", F.lit(1.0)) if probs is None else links.join(probs, ["s", "t"]).repartition("sid")
        share = F.col("n") * F.col("p")
        # a source word that stands n times adds n times to the sum of each of the target word's occurrences
        met = met.withColumn("unit", F.min("n").over(occurrence)).withColumn("z", F.sum(share).over(occurrence))
        c = met.groupBy("s", "t").agg(F.sum(share / F.col("z") * F.col("unit")).alias("c"))
        c = written(c)
        by_s = c.groupBy("s").agg(F.sum("c").alias("cs"))
        probs = c.join(by_s, "s").select("s", "t", (F.col("c") / F.col("cs")).alias("p"))
    return links.select("s", "t").distinct().withColumn("p", F.lit(1.0)) if probs is None else written(probs)


def two_way(rules: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """rule, s, t and s2t, t2s of rules (rule, s array, t array), with different names: ln of the probability of one side by Model 1 given the other, both ways. A side of n words gives each word
    of the other the mean over its words and the null word. forward: (s, t, p) for p(t | s), backward: (s, t, p) for p(s | t), where the null word is t; what a
    table doesn't have is 0, so that a rule may have -infinity. Word pairs of a rule meet both tables in one join."""
    rules = multiplied(rules, F.size("s") * F.size("t"), "rule")
    counted = lambda c: rules.select("rule", F.explode(F.concat(F.array(F.lit(NULL)), c)).alias(c)).groupBy("rule", c).agg(F.count(F.lit(1)).alias(f"n{c}"))
    pairs = counted("s").join(counted("t"), "rule").filter(~((F.col("s") == NULL) & (F.col("t") == NULL)))
    table = forward.select("s", "t", F.col("p").alias("f")).join(backward.select("s", "t", F.col("p").alias("b")), ["s", "t"], "full_outer")
    met = pairs.join(table, ["s", "t"], "left").select("rule", "s", "t", "ns", "nt", F.coalesce("f", F.lit(0.0)).alias("f"), F.coalesce("b", F.lit(0.0)).alias("b"))
    met = met.repartition("rule")  # once for both windows and the sums
    met = met.withColumn("zf", F.sum(F.col("ns") * F.col("f")).over(W.partitionBy("rule", "t"))).withColumn("zb", F.sum(F.col("nt") * F.col("b")).over(W.partitionBy("rule", "s")))
    # each word's sum is taken once: in its row with the null word
    ln = lambda z: F.when(z > 0, F.log(z)).otherwise(F.lit(float("-inf")))
    total = met.groupBy("rule").agg(
        F.sum(F.when(F.col("s") == NULL, F.col("nt") * ln(F.col("zf")))).alias("sf"), F.sum(F.when(F.col("t") == NULL, F.col("ns") * ln(F.col("zb")))).alias("sb")
    )
    n, m = F.size("s"), F.size("t")
    return rules.join(total, "rule", "left").select("rule", "s", "t", (F.coalesce("sf", F.lit(0.0)) - m * F.log(n + 1.0)).alias("s2t"), (F.coalesce("sb", F.lit(0.0)) - n * F.log(m + 1.0)).alias("t2s"))


def log_mean(a: Column, b: Column) -> Column:
    """ln((exp a + exp b) / 2) without leaving the range of doubles."""
    high = F.greatest(a, b)
    return F.when(high == float("-inf"), high).otherwise(high + F.log1p(F.exp(F.least(a, b) - high)) - F.log(F.lit(2.0)))


def baum_welch(seqs: DataFrame, states: int, symbols: int, rounds: int) -> tuple[list, list[float]]:
    """((start, transition, emission), log likelihoods) of an HMM over rows (obs array<int>, times). Forward and backward run for each sequence where it is; what
    comes together are states x (states + symbols) expected counts."""
    import numpy as np

    rng = np.random.default_rng(4)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    params = [norm(rng.random(states) + 1), norm(rng.random((states, states)) + 1), norm(rng.random((states, symbols)) + 1)]
    trace = []
    for _ in range(rounds):
        start, move, emit = (p.tolist() for p in params)

        def expect(batches, start=start, move=move, emit=emit):
            import pandas as pd

            s0, tr, em = (np.array(x) for x in (start, move, emit))
            a, b, c, ll = np.zeros_like(s0), np.zeros_like(tr), np.zeros_like(em), 0.0
            for batch in batches:
                for o, times in zip(batch["obs"], batch["times"], strict=True):
                    if not len(o):
                        continue
                    o = np.asarray(o)
                    f, scale = np.zeros((len(o), len(s0))), np.zeros(len(o))
                    for k, x in enumerate(o):
                        v = (s0 if k == 0 else f[k - 1] @ tr) * em[:, x]
                        scale[k] = v.sum()
                        f[k] = v / scale[k]
                    r = np.ones((len(o), len(s0)))
                    for k in range(len(o) - 2, -1, -1):
                        r[k] = tr @ (em[:, o[k + 1]] * r[k + 1]) / scale[k + 1]
                    g = f * r
                    a += times * g[0]
                    np.add.at(c.T, o, times * g)
                    for k in range(len(o) - 1):
                        b += times * np.outer(f[k], em[:, o[k + 1]] * r[k + 1]) * tr / scale[k + 1]
                    ll += times * float(np.log(scale).sum())
            yield pd.DataFrame({"k": range(len(s0) + tr.size + em.size + 1), "v": np.concatenate([a, b.ravel(), c.ravel(), [ll]])})

        got = dict(seqs.mapInPandas(expect, "k int, v double").groupBy("k").agg(F.sum("v")).collect())
        v = np.array([got[k] for k in range(len(got))])
        trace.append(float(v[-1]))
        parts = v[:states], v[states : states + states**2].reshape(states, states), v[states + states**2 : -1].reshape(states, symbols)
        params = [norm(np.maximum(p, 1e-12)) for p in parts]
    return [p.tolist() for p in params], trace


def pyp_predictive(c: Column, t: Column, customers: Column, tables: Column, a: float, b: float, p0: Column) -> Column:
    """Probability of a dish with c customers at t tables in a restaurant with discount a and strength b."""
    return (c - a * t + (b + a * tables) * p0) / (customers + b)


def pyp_minus_one(c: Column, t: Column, customers: Column, tables: Column, a: float, b: float, p0: Column) -> Column:
    """The same after one customer of the dish has gone (from a table that stays)."""
    return pyp_predictive(c - 1, t, customers - 1, tables, a, b, p0)


def pyp_log_prob(rows: DataFrame, a: float, b: float) -> DataFrame:
    """lp of a restaurant (dish, customers, tables, hist map of table size to number) for a > 0 with Beta(1, 1) and Gamma(1, 1) priors."""
    sizes = rows.select(F.explode("hist").alias("size", "m"))
    seats = sizes.agg(F.sum(F.col("m") * (lgamma(F.col("size") - a) - lgamma(F.lit(1 - a)))).alias("seats"))
    all_ = rows.agg(F.sum("customers").cast("double").alias("c"), F.sum("tables").cast("double").alias("t"))
    lp = lgamma(F.lit(b + 0.0)) - lgamma(F.col("c") + b) + F.col("t") * F.log(F.lit(a)) + lgamma(F.col("t") + b / a) - lgamma(F.lit(b / a)) + F.col("seats") - b
    return all_.crossJoin(F.broadcast(seats)).select(lp.alias("lp"))  # one row each


def expected_tables(c: Column, a: float, b: float) -> Column:
    """Expected number of tables of c customers: (b / a) (prod (b + a + i) / (b + i) - 1), by log gammas."""
    return (b / a) * (F.exp(lgamma(c + b + a) - lgamma(F.lit(b + a)) - lgamma(c + b) + lgamma(F.lit(b + 0.0))) - 1)


def seat(dishes: DataFrame, key: str, order: str, a: float, b: float, p0: float, seed: int) -> DataFrame:
    """key, dish, customers, tables, hist: customers of each restaurant are seated in order, then every fifth is unseated again; one task for each restaurant
    at a time, as seating is sequential."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(order)
        rng = np.random.default_rng([seed, int(rows[key].iloc[0])])
        at: dict = {}
        tables = 0
        for d in rows["dish"]:
            sizes = at.setdefault(d, [])
            weights = np.array([s - a for s in sizes] + [(b + a * tables) * p0])
            pick = int(rng.choice(len(weights), p=weights / weights.sum()))
            if pick == len(sizes):
                sizes.append(1)
                tables += 1
            else:
                sizes[pick] += 1
        for d in rows["dish"].iloc[::5]:
            sizes = at[d]
            pick = int(rng.choice(len(sizes), p=np.array(sizes) / sum(sizes)))
            sizes[pick] -= 1
            if not sizes[pick]:
                sizes.pop(pick)
                tables -= 1
        out = [(rows[key].iloc[0], d, sum(s), len(s), {int(x): s.count(x) for x in set(s)}) for d, s in at.items() if s]
        return pd.DataFrame(out, columns=[key, "dish", "customers", "tables", "hist"])

    return dishes.groupBy(key).applyInPandas(run, f"{key} long, dish string, customers long, tables long, hist map<int, int>")


def slice_sample(log_density, start: float, low: float, high: float, draws: int, seed: int) -> list[float]:
    """Draws from a density over (low, high) by the slice sampler with shrinking intervals."""
    import numpy as np

    rng, x, out = np.random.default_rng(seed), start, []
    for _ in range(draws):
        level = log_density(x) + np.log(rng.random())
        a, z = low, high
        while True:
            y = rng.uniform(a, z)
            if log_density(y) > level:
                x = float(y)
                break
            a, z = (y, z) if y < x else (a, y)
        out.append(x)
    return out


def rule_base(src_len: Column, trg_len: Column, terminals: Column, rate: float, penalty: float, log_m1: Column) -> Column:
    """ln of a rule's base measure: Poisson lengths of both sides, a penalty for each terminal and the word model's log probability."""
    return log_poisson(src_len.cast("double"), F.lit(rate)) + log_poisson(trg_len.cast("double"), F.lit(rate)) + terminals * F.log(F.lit(penalty)) + log_m1


def annealing(iteration: Column, first: float, last: float, steps: int) -> Column:
    """Temperature that falls from first to last in equal steps and stays."""
    return F.when(iteration >= steps, F.lit(last)).otherwise(first + (last - first) * iteration / steps)


def max_span(iteration: Column, start: int, every: int, most: int) -> Column:
    return F.least(F.lit(start) + F.floor(iteration / every), F.lit(most))


#: Probabilities of the grammar's rules: both children in the same order, in turned order, a word pair.
ITG_RULES = {"straight": 0.4, "inverted": 0.2, "word": 0.4}
#: Weights of a split in sums and in the best derivation. In either order the children are the same where one of them has words of one side only, or none of the side.
ITG_SUMS = ITG_RULES | {"either": ITG_RULES["straight"] + ITG_RULES["inverted"]}
ITG_BEST = ITG_RULES | {"either": max(ITG_RULES["straight"], ITG_RULES["inverted"])}
#: Pairs of the same lengths whose charts are filled together: 6 MB a chart at nine words a side.
ITG_TOGETHER = 256
#: Places of word pairs in a lot of pairs of the same lengths: 1,000 pairs of nine words a side.
ITG_LOT = 100_000


@functools.lru_cache(256)
def _itg_splits(n: int, m: int) -> list[tuple[tuple[int, int], list]]:
    """Lengths (a, b) of the spans of two words or more, smaller ones first, with all their splits: rule, lengths of the first and of the second child, and where these begin for the spans of
    that length at all places: slices of blocks[lengths][source place, target place]. A split with an empty child weighs nothing and isn't there. A child with words of one side only meets
    the other in the same way by both rules: such a split is there once, as "either"."""
    out = []
    for a, b in sorted(((a, b) for a in range(n + 1) for b in range(m + 1) if a + b > 1), key=sum):
        h, v, splits = n - a + 1, m - b + 1, []
        for name in ("straight", "inverted"):
            for k in range(a + 1):
                for p in range(b + 1):
                    of, at = (p, (0, p)) if name == "straight" else (b - p, (p, 0))
                    both = 0 < k < a and 0 < of < b
                    if 0 < k + of < a + b and (both or name == "straight"):
                        first, second = ((slice(f, f + h), slice(g, g + v)) for f, g in ((0, at[0]), (k, at[1])))
                        splits.append((name if both else "either", (k, of), first, (a - k, b - of), second))
        out.append(((a, b), splits))
    return out


def _itg_blocks(words) -> dict:
    """Of words[i, u, pair] (the last i and u: the null word) the blocks of single words, one of them or none linked: blocks[lengths][source place, target place, pair]."""
    import numpy as np

    n, m, g = words.shape[0] - 1, words.shape[1] - 1, words.shape[2]
    w = ITG_RULES["word"] * words
    return {(1, 0): np.broadcast_to(w[:n, m:], (n, m + 1, g)), (0, 1): np.broadcast_to(w[n:, :m], (n + 1, m, g)), (1, 1): w[:n, :m]}


def _itg_filled(words):
    """Blocks of inside probabilities."""
    import numpy as np

    n, m, g = words.shape[0] - 1, words.shape[1] - 1, words.shape[2]
    inside = _itg_blocks(words)
    for (a, b), splits in _itg_splits(n, m):
        shape = (n - a + 1, m - b + 1, g)
        sums, made = {name: np.zeros(shape) for name in ITG_SUMS if name != "word"}, np.empty(shape)
        for name, x, at, y, to in splits:
            np.multiply(inside[x][at], inside[y][to], out=made)
            sums[name] += made
        total = sum(ITG_SUMS[name] * s for name, s in sums.items())
        inside[a, b] = total + inside[a, b] if (a, b) == (1, 1) else total
    return inside


def itg_expected_of(words):
    """For pairs of n and m words, words[i, u, pair] the probability of a word pair (the last i and u: the null word): inside probabilities under an inversion grammar, and how
    often each place of words is expected in the derivations (inside and outside), of the same shape as words. All pairs go through the chart together."""
    import numpy as np

    n, m, g = words.shape[0] - 1, words.shape[1] - 1, words.shape[2]
    inside = _itg_filled(words)
    z = inside[n, m][0, 0]
    outside = {q: np.zeros(x.shape) for q, x in inside.items()}
    outside[n, m][:] = 1.0
    for q, splits in reversed(_itg_splits(n, m)):
        above, made = {name: ITG_SUMS[name] * outside[q] for name in ITG_SUMS if name != "word"}, np.empty(outside[q].shape)
        for name, x, at, y, to in splits:
            np.multiply(above[name], inside[y][to], out=made)
            outside[x][at] += made
            np.multiply(above[name], inside[x][at], out=made)
            outside[y][to] += made
    counts = np.zeros(words.shape)
    counts[:n, :m], counts[:n, m], counts[n, :m] = outside[1, 1], outside[1, 0].sum(1), outside[0, 1].sum(0)
    counts *= ITG_RULES["word"] * words
    return z, np.divide(counts, z, out=np.zeros(words.shape), where=z > 0)


def itg_best_of(words) -> list[list[tuple[int, int]]]:
    """The links (i, u) of the best derivation of each pair, words as above. Of equal ones the first: straight before inverted, then by the places of the split.
    Where the order of the children doesn't matter, the straight rule weighs more than the inverted one."""
    import numpy as np

    n, m, g = words.shape[0] - 1, words.shape[1] - 1, words.shape[2]
    best, choice = _itg_blocks(words), {}
    weighed = lambda x: {name: p * x for name, p in ITG_BEST.items() if name != "word"}
    scaled = {q: weighed(x) for q, x in best.items() if q != (1, 1)}
    for q, splits in _itg_splits(n, m):
        shape = (n - q[0] + 1, m - q[1] + 1, g)
        top, made, above = (best[q].copy() if q in best else np.zeros(shape)), np.empty(shape), np.empty(shape, dtype=bool)
        choice[q] = np.full(shape, -1, dtype=np.int16)
        for c, (name, x, at, y, to) in enumerate(splits):
            np.multiply(scaled[x][name][at], best[y][to], out=made)
            np.greater(made, top, out=above)
            np.copyto(choice[q], c, where=above)
            np.maximum(top, made, out=top)
        best[q], scaled[q] = top, weighed(top)
    splits_of, out = dict(_itg_splits(n, m)), []
    for k in range(g):
        links, todo = [], [((n, m), 0, 0)]
        while todo:
            q, i, u = todo.pop()
            c = choice[q][i, u, k] if q in choice else -1
            if c < 0:
                links += [(i, u)] if q == (1, 1) and best[q][i, u, k] > 0 else []
                continue
            _, x, (f, p), y, (h, r) = splits_of[q][c]
            todo += [(x, i + f.start, u + p.start), (y, i + h.start, u + r.start)]
        out.append(sorted(links))
    return out


def _itg_words(s: list[str], t: list[str], table: dict, unseen: float):
    import numpy as np

    return np.array([[[table.get((x, y), unseen)] for y in [*t, NULL]] for x in [*s, NULL]])


def itg_expected(s: list[str], t: list[str], table: dict, unseen: float = 1e-6) -> tuple[float, dict]:
    """The inside log probability of a pair and how often each word pair is expected in its derivations."""
    import math

    z, made = itg_expected_of(_itg_words(s, t, table, unseen))
    counts: dict = {}
    for i, x in enumerate([*s, NULL]):
        for u, y in enumerate([*t, NULL]):
            if made[i, u, 0] > 0:
                counts[x, y] = counts.get((x, y), 0.0) + float(made[i, u, 0])
    return math.log(z[0]) if z[0] > 0 else float("-inf"), counts


def itg_inside(s: list[str], t: list[str], table: dict, unseen: float = 1e-6):
    """Inside log probability of a pair and the links (i, u) of its best derivation; O(n^3 m^3), short pairs only."""
    import math

    words = _itg_words(s, t, table, unseen)
    z = float(_itg_filled(words)[len(s), len(t)][0, 0, 0])
    return math.log(z) if z > 0 else float("-inf"), itg_best_of(words)[0]


def _itg_short(most: int) -> Column:
    return F.coalesce(F.size("src").between(1, most) & F.size("trg").between(1, most), F.lit(False))


class ItgPairs(NamedTuple):
    """Different pairs of 1 to some words a side. Their words are numbers, which are moved, sorted and compared faster."""

    #: (lot, src, trg, times, n, m): pairs of n and m words. A lot has pairs of the same lengths, as they go through one chart, and about ITG_LOT places of word pairs, however many pairs there are.
    short: DataFrame
    #: (lot, s, t): word pairs that a lot asks for, each once.
    asked: DataFrame
    #: Number of lots.
    lots: int
    #: (word, id), the null word included; what _itg_id needs for these ids; the null word's id.
    words: DataFrame
    seed: int
    null: int


def _itg_id(word: Column, seed: int) -> Column:
    return F.xxhash64(word, F.lit(seed))


def _itg_ids(words: str, seed: int) -> Column:
    return F.transform(words, lambda w: _itg_id(w, seed)).alias(words)


def _itg_pairs(pairs: DataFrame, most: int, written) -> ItgPairs:
    short = pairs.filter(_itg_short(most)).select("src", "trg", F.xxhash64("src", "trg").alias("h")).groupBy("h", "src", "trg").agg(F.count(F.lit(1)).alias("times"))
    short = written(short.select("h", "src", "trg", "times", F.size("src").alias("n"), F.size("trg").alias("m")))
    words = short.select(F.explode(F.concat("src", "trg")).alias("word")).union(short.sparkSession.range(1).select(F.lit(NULL).alias("word"))).distinct()
    words, seed = written(words), 0
    while True:  # until no two words have the same number
        coded = words.withColumn("id", _itg_id(F.col("word"), seed))
        every, ids, null = coded.agg(F.count(F.lit(1)), F.count_distinct("id"), F.max(F.when(F.col("word") == NULL, F.col("id")))).first()
        if every == ids:
            break
        seed += 1
    lengths = F.col("n") * (most + 1) + F.col("m")
    pairs_of = dict(short.groupBy(lengths).count().collect())  # most * most rows
    lots = [pairs_of.get(k, 0) * (k // (most + 1) + 1) * (k % (most + 1) + 1) // ITG_LOT + 1 for k in range((most + 1) ** 2)]
    lot = lengths.cast("bigint") * (1 << 32) + F.pmod("h", F.get(F.array(*[F.lit(x).cast("bigint") for x in lots]), lengths))
    short, count = short.select(lot.alias("lot"), _itg_ids("src", seed), _itg_ids("trg", seed), "times", "n", "m"), sum(lots[k] for k in pairs_of)
    word = lambda c: F.explode(F.concat(c, F.array(F.lit(null).cast("bigint"))))
    asked = _dealt_lots(short, count).select("lot", "trg", word("src").alias("s")).select("lot", "s", word("trg").alias("t")).filter((F.col("s") != null) | (F.col("t") != null))
    return ItgPairs(short, written(asked.distinct()), count, coded, seed, null)


def _dealt_lots(df: DataFrame, lots: int) -> DataFrame:
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(lots, 100_000)), "lot")


def _over_lots(made: ItgPairs, probs: DataFrame | None, run, schema: str) -> DataFrame:
    """run(batch, null word) of each lot's pairs (src, trg, times, n, m, part), where a pair's part of the table (s, t, p) of numbered words is (at, p); without a table it is null."""
    pairs, run = _dealt_lots(made.short, made.lots).groupBy("lot"), functools.partial(run, null=made.null)
    if probs is None:
        return pairs.applyInArrow(lambda a: _itg_run(run, a, None), schema)
    found = _dealt_lots(made.asked.join(probs, ["s", "t"]).select("lot", "s", "t", "p"), made.lots)
    return pairs.cogroup(found.groupBy("lot")).applyInArrow(lambda a, b: _itg_run(run, a, b), schema)


def _itg_run(run, pairs, found):
    import pyarrow as pa

    batch = pairs.combine_chunks().to_batches()[0]
    if found is None:
        part = pa.nulls(batch.num_rows, pa.list_(pa.struct([("at", pa.int32()), ("p", pa.float64())])))
    else:
        part = _itg_part(batch, run.keywords["null"], *(found.column(c).combine_chunks() for c in ("s", "t", "p")))
    return pa.Table.from_batches([run(batch.append_column("part", part))])


def _itg_part(batch, null, found_s, found_t, found_p):
    """For each pair of n and m words the list of (at, p) of its word pairs that are found: at i * (m + 1) + u, the null words last."""
    import numpy as np
    import pyarrow as pa

    rows, n, m = batch.num_rows, batch.column("n")[0].as_py(), batch.column("m")[0].as_py()
    coded = pa.concat_arrays([batch.column("src").flatten(), batch.column("trg").flatten(), pa.array([null], found_s.type), found_s, found_t]).dictionary_encode()
    s, t, none, x, y = np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum([rows * n, rows * m, 1, len(found_s)]))
    size, side = len(coded.dictionary), lambda ids, k: np.column_stack([ids.reshape(rows, k), np.full(rows, none[0])])
    asked = (side(s, n)[:, :, None] * size + side(t, m)[:, None, :]).reshape(rows, -1)
    keys = x * size + y
    order = np.argsort(keys)
    keys = np.append(keys[order], -1)
    place = np.searchsorted(keys[:-1], asked)
    hit = keys[place] == asked
    at = np.nonzero(hit)[1].astype(np.int32)
    p = found_p.to_numpy(zero_copy_only=False)[order][place[hit]]
    begins = np.concatenate([[0], np.cumsum(hit.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(begins), pa.StructArray.from_arrays([pa.array(at), pa.array(p)], ["at", "p"]))


@functools.lru_cache(256)
def _itg_uniform(n: int, m: int, p: float):
    """What itg_expected_of gives for any pair of n and m words where all word pairs have the probability p."""
    import numpy as np

    return itg_expected_of(np.full((n + 1, m + 1, 1), p))


def _itg_groups(batch, unseen: float):
    """Of an Arrow batch (n, m, part): (first row, end, words) of pairs of the same lengths, at most ITG_TOGETHER. A word pair that isn't in a part has `unseen`."""
    import numpy as np
    import pyarrow.compute as pc

    n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
    part = batch.column("part")
    at, p = (x.to_numpy(zero_copy_only=False) for x in part.flatten().flatten())
    sizes = pc.fill_null(part.value_lengths(), 0).to_numpy()
    begins = np.concatenate([[0], np.cumsum(sizes)])
    changes = np.flatnonzero((n[1:] != n[:-1]) | (m[1:] != m[:-1])) + 1
    for low, high in zip([0, *changes.tolist()], [*changes.tolist(), len(n)], strict=True):
        for a in range(low, high, ITG_TOGETHER):
            z = min(a + ITG_TOGETHER, high)
            table = np.full((z - a, (n[a] + 1) * (m[a] + 1)), unseen)
            flat = slice(begins[a], begins[z])
            table[np.repeat(np.arange(z - a), sizes[a:z]), at[flat]] = p[flat]
            yield a, z, np.ascontiguousarray(table.reshape(z - a, n[a] + 1, m[a] + 1).transpose(1, 2, 0))


def itg_counts(batch, uniform: float | None, null=NULL):
    """Of an Arrow batch (src, trg, times, n, m, part), whose words have any type with `null` for the null word, the expected counts (s, t, c) of its word pairs, and the log likelihood where s and t are null. With `uniform` all word pairs have that probability."""
    import numpy as np
    import pyarrow as pa

    src, trg = batch.column("src"), batch.column("trg")
    coded = pa.concat_arrays([src.flatten(), trg.flatten(), pa.array([null], src.type.value_type)]).dictionary_encode()
    ids, names, times = coded.indices.to_numpy().astype(np.int64), coded.dictionary, batch.column("times").to_numpy()
    n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
    of_s, of_t = np.concatenate([[0], np.cumsum(n)]), n.sum() + np.concatenate([[0], np.cumsum(m)])
    null, keys, counts, likely = ids[-1], [], [], 0.0
    for a, z, words in _itg_groups(batch, uniform or 0.0):
        side = lambda of, size, a=a, z=z: np.column_stack([ids[of[a] : of[z]].reshape(z - a, size[a]), np.full(z - a, null)])
        s, t = side(of_s, n).T[:, None], side(of_t, m).T[None]
        if uniform is None:
            inside, c = itg_expected_of(words)
        else:
            inside, c = (np.repeat(x, z - a, axis=-1) for x in _itg_uniform(words.shape[0] - 1, words.shape[1] - 1, uniform))
            both = (s == null) & (t == null)
            own = both.sum((0, 1)) > 1  # the null word is a word of theirs
            if own.any():
                words[both] = 0.0
                inside[own], c[:, :, own] = itg_expected_of(words[:, :, own])
        with np.errstate(divide="ignore"):
            likely += float((times[a:z] * np.log(inside)).sum())
        c *= times[a:z]
        used = c > 0
        keys.append((s * len(names) + t)[used])
        counts.append(c[used])
    pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, np.concatenate(counts), len(pairs))
    side = lambda x: pa.concat_arrays([names.take(pa.array(x)), pa.nulls(1, names.type)])
    return pa.RecordBatch.from_arrays([side(pairs // len(names)), side(pairs % len(names)), pa.array(np.append(sums, likely))], names=["s", "t", "c"])


def itg_links(batch, unseen: float = 1e-6, null=NULL):
    """Of an Arrow batch (src, trg, n, m, part): src, trg, lp, links."""
    import numpy as np
    import pyarrow as pa

    lp, links = np.zeros(batch.num_rows), []
    for a, z, words in _itg_groups(batch, unseen):
        with np.errstate(divide="ignore"):
            lp[a:z] = np.log(_itg_filled(words)[words.shape[0] - 1, words.shape[1] - 1][0, 0])
        links += [" ".join(f"{i}-{u}" for i, u in x) for x in itg_best_of(words)]
    src, trg = (c.cast(pa.list_(c.type.value_type)) for c in (batch.column("src"), batch.column("trg")))  # as Spark declares it
    return pa.RecordBatch.from_arrays([src, trg, pa.array(lp), pa.array(links, pa.string())], names=["src", "trg", "lp", "links"])


def _itg_rounds(made: ItgPairs, rounds: int, written) -> tuple[DataFrame, list[float]]:
    every = made.asked.select("s", "t").distinct()
    first = 1.0 / max(1, every.count())
    if not rounds:
        return every.withColumn("p", F.lit(first)), []
    probs, trace = None, []
    for _ in range(rounds):
        found = _over_lots(made, probs, functools.partial(itg_counts, uniform=first if probs is None else None), "s long, t long, c double")
        found = written(found.groupBy("s", "t").agg(F.sum("c").alias("c")))
        likely, total = found.agg(F.sum(F.when(F.col("s").isNull(), F.col("c"))), F.sum(F.when(F.col("s").isNotNull(), F.col("c")))).first()
        trace.append(likely or 0.0)
        probs = found.filter("s IS NOT NULL AND c > 0").select("s", "t", (F.col("c") / F.lit(total)).alias("p"))
    return probs, trace


def itg_train(pairs: DataFrame, rounds: int, most: int = 9, written=written) -> tuple[DataFrame, list[float]]:
    """s, t, p (a joint distribution over word pairs, the null word on one side included) after so many EM rounds over pairs (src array, trg array), from a
    uniform start, with the log likelihood before each round. Equal pairs are computed once; in the first round pairs of the same lengths have the same expected counts. Pairs with an empty side or more
    than `most` words a side are not read: the table of spans grows with the fourth power of the length. Without pairs the table is empty. The word `<null>` is taken as the null word."""
    made = _itg_pairs(pairs, most, written)
    probs, trace = _itg_rounds(made, rounds, written)
    for side in ("s", "t"):
        probs = probs.withColumnRenamed(side, "id").join(made.words.withColumnRenamed("word", side), "id").drop("id")
    return written(probs.select("s", "t", "p")), trace


def _itg_aligned(pairs: DataFrame, made: ItgPairs, probs: DataFrame, most: int) -> DataFrame:
    got = _over_lots(made, probs, itg_links, "src array<bigint>, trg array<bigint>, lp double, links string")
    keyed = lambda df: df.withColumn("h", F.xxhash64("src", "trg"))  # noqa: E731  sorted faster by a number than by arrays
    met = keyed(pairs.filter(_itg_short(most)).select("sid", _itg_ids("src", made.seed), _itg_ids("trg", made.seed))).join(keyed(got), ["h", "src", "trg"], "left").select("sid", "lp", "links")
    return met.unionByName(pairs.filter(~_itg_short(most)).select("sid", F.lit(None).cast("double").alias("lp"), F.lit(None).cast("string").alias("links")))


def itg_alignments(pairs: DataFrame, probs: DataFrame, most: int = 9, written=written) -> DataFrame:
    """sid, lp, links (i-j joined by spaces) of pairs (sid, src, trg) under a table (s, t, p); pairs with an empty side or more than `most` words a side have null. Only short pairs are moved."""
    made = _itg_pairs(pairs, most, written)
    for side in ("s", "t"):
        probs = probs.withColumnRenamed(side, "word").join(made.words.withColumnRenamed("id", side), "word").drop("word")
    return _itg_aligned(pairs, made, probs, most)


def itg_trained_alignments(pairs: DataFrame, rounds: int, most: int = 9, written=written) -> DataFrame:
    """itg_alignments under the table of itg_train over the same pairs."""
    made = _itg_pairs(pairs, most, written)
    return _itg_aligned(pairs, made, _itg_rounds(made, rounds, written)[0], most)


def grammar_stats(rules: DataFrame) -> DataFrame:
    """types, mean lengths and the sum of tables * ln p0 of rules (s array, t array, tables, p0)."""
    return rules.agg(F.count(F.lit(1)).alias("types"), F.avg(F.size("s")).alias("src_len"), F.avg(F.size("t")).alias("trg_len"), F.sum(F.col("tables") * F.log("p0")).alias("base"))


def length_histogram(rules: DataFrame) -> DataFrame:
    return rules.groupBy(F.size("s").alias("len")).agg(F.sum("tables").alias("tables"))


def sampled_sentences(grammar: list[tuple[str, list[str], list[str], float]], n: int, seed: int, most: int = 200) -> list[tuple[str, str]]:
    """Sentence pairs drawn from a synchronous grammar of (lhs, source, target, probability); nonterminals are upper case and linked by name. Expansion stops after `most` rules with an error."""
    import random

    rng = random.Random(seed)
    by: dict = {}
    for r in grammar:
        by.setdefault(r[0], []).append(r)

    def expand(lhs: str, left: list[int]) -> tuple[list[str], list[str]]:
        left[0] -= 1
        if left[0] < 0:
            raise ValueError("the derivation does not end")
        r = rng.choices(by[lhs], weights=[x[3] for x in by[lhs]])[0]
        done = {x: expand(x, left) for x in r[1] if x.isupper()}
        flat = lambda side, k: [w for x in side for w in (done[x][k] if x.isupper() else [x])]
        return flat(r[1], 0), flat(r[2], 1)

    return [tuple(" ".join(side) for side in expand("S", [most])) for _ in range(n)]
