"""Secret scan through a trigram inverted index.

For each rule a Boolean query over lower-cased trigrams is derived from its regular expression (trigram_query). The index holds
postings (trigram, text key); the key is a 64-bit hash of the text, so copies share postings. Intersecting the postings of a key and
evaluating the rules' queries gives candidate (key, rule) pairs, which meet the documents in an ordinary join; candidates are
then verified with the expression itself. Rules without a mandatory trigram are verified on every text. A key is only a
candidate's name: a collision costs a verification, never a result.

By default only trigrams that some rule asks for are put into the index: the rest of the postings would never be read.
build_index(docs, None) builds all of them.

Spans count code points, end exclusive, leftmost non-overlapping for each kind, over the whole match.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned one by one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSE = re._parser


@dataclass(frozen=True)
class Rule:
    """group: its length must reach `least` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base rules as asked for, then those that the scan adds.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}", 0, 27),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
MOST_EXACT, MOST_CLASS = 64, 4


def _and(*qs):
    out = frozenset().union(*(q[1] if q[0] == "and" else [q] for q in qs if q is not True))
    return True if not out else next(iter(out)) if len(out) == 1 else ("and", out)


def _or(*qs):
    if any(q is True for q in qs):
        return True
    parts = set().union(*(q[1] if q[0] == "or" else [q] for q in qs))
    terms = {q: q[1] if q[0] == "and" else frozenset([q]) for q in parts}
    parts = {q for q in parts if not any(terms[p] < terms[q] for p in parts)}  # a weaker alternative makes a stronger one needless
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of_string(s: str):
    return _and(*[("tri", s[i : i + 3]) for i in range(len(s) - 2)]) if len(s) >= 3 else True


def trigram_query(pattern: str):
    """True (no mandatory trigram), ("tri", t), ("and", set) or ("or", set): what the lower-cased trigrams of every matching text fulfil."""

    def exact(item) -> set[str] | None:
        """The strings that an item stands for, where they are few."""
        op, arg = item
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            if any(str(o) not in ("LITERAL", "RANGE") for o, _ in arg):
                return None
            chars = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
            return chars if len(chars) <= MOST_CLASS else None
        if name == "SUBPATTERN":
            return sequence(arg[3])
        if name == "BRANCH":
            all_ = [sequence(x) for x in arg[1]]
            return None if None in all_ else set().union(*all_)
        if name == "MAX_REPEAT" and arg[1] != PARSE.MAXREPEAT and arg[1] <= 3:
            one = sequence(arg[2])
            return None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
        return None

    def sequence(items) -> set[str] | None:
        out = {""}
        for item in items:
            more = exact(item)
            if more is None or len(out) * len(more) > MOST_EXACT:
                return None
            out = {a + b for a in out for b in more}
        return out

    def query(items):
        found, run = [], {""}
        for item in items:
            more = exact(item)
            if more is not None and len(run) * len(more) <= MOST_EXACT:
                run = {a + b for a in run for b in more}
                continue
            found.append(_or(*map(_of_string, run)))
            run = more if more is not None and len(more) <= MOST_EXACT else {""}
            op, arg = item
            if more is None and str(op) == "SUBPATTERN":
                found.append(query(arg[3]))
            elif more is None and str(op) == "BRANCH":
                found.append(_or(*map(query, arg[1])))
            elif more is None and str(op) == "MAX_REPEAT" and arg[0] > 0:
                found.append(query(arg[2]))
        return _and(*found, _or(*map(_of_string, run)))

    return query(PARSE.parse(pattern))


def trigrams_of(q) -> set[str]:
    return set() if q is True else {q[1]} if q[0] == "tri" else set().union(*map(trigrams_of, q[1]))


def holds(q, has) -> Column:
    if q is True:
        return F.lit(True)
    if q[0] == "tri":
        return has(q[1])
    parts = [holds(x, has) for x in sorted(q[1], key=str)]
    out = parts[0]
    for x in parts[1:]:
        out = out & x if q[0] == "and" else out | x
    return out


def build_index(docs: DataFrame, trigrams: set[str] | None) -> DataFrame:
    """Postings (trigram, key) of docs (key, text); only of the given trigrams, or of all."""
    low = F.lower("text")
    if trigrams is None:
        each = F.array_distinct(F.regexp_extract_all(low, F.lit("(?s)(?=(...))"), F.lit(1)))
    else:
        each = F.filter(F.array(*[F.lit(t) for t in sorted(trigrams)]), lambda t: F.contains(F.col("_low"), t))
    return docs.withColumn("_low", low).select(F.explode(each).alias("trigram"), "key")


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(key, one Boolean for each rule) of the keys for which some rule's query holds."""
    hit = index.groupBy("key").agg(F.collect_set("trigram").alias("got"))
    out = hit.select("key", *[holds(q, lambda t: F.array_contains("got", t)).alias(f"may_{kind}") for kind, q in queries.items()])
    some = F.lit(False)
    for kind in queries:
        some = some | F.col(f"may_{kind}")
    return out.filter(some)


def bound(value: Column, f) -> Column:
    """f(value), with value computed once: the lambda's variable stands for it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in text, with the lengths of what lies between them.

    The running length is taken in blocks of about the root of the number of matches, because each append copies its array."""
    both = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"))

    def sized(x: Column) -> Column:
        enough = F.char_length(F.regexp_extract(x["hit"], rule.pattern, rule.group)) >= rule.least
        return F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), enough.alias("ok"))

    def folded(items: Column, at: Column, kind: str, step) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(items, begin, step, lambda a: a["out"])

    def blocks(m: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(m))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(m), F.lit(1)), width), lambda i: F.slice(m, i, width))

    def next_block(a: Column, m: Column) -> Column:
        end = F.aggregate(m, a["at"], lambda z, x: z + x["gap"] + x["hit"])
        return F.struct(end.alias("at"), F.array_append(a["out"], a["at"]).alias("out"))

    def next_span(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + x["hit"]
        span = F.struct(begin.alias("start"), end.alias("end"), x["ok"].alias("ok"))
        return F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out"))

    def placed(bs: Column) -> Column:
        within = lambda m, at: folded(m, at, "struct<start:int,end:int,ok:boolean>", next_span)
        return F.flatten(F.zip_with(bs, folded(bs, F.lit(0), "int", next_block), within))

    matches = F.transform(F.filter(both, lambda x: x["hit"].isNotNull()), sized)
    return F.filter(bound(bound(matches, blocks), placed), lambda x: x["ok"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and found: array<struct<start, k, kind, end, base>> by start, then by the rules' order."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    found = candidates(build_index(keyed, set().union(*map(trigrams_of, queries.values()))), queries) if queries else None
    met = keyed.join(found, "key", "left") if found is not None else keyed
    none = F.array().cast("array<struct<start:int,k:int,kind:string,end:int,base:boolean>>")

    def of(k: int, r: Rule) -> Column:
        spans = F.transform(spans_of(F.col("text"), r), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), F.lit(r.kind).alias("kind"), x["end"].alias("end"), F.lit(r.base).alias("base")))
        need = F.coalesce(F.col(f"may_{r.kind}"), F.lit(False)) if r.kind in queries else F.col("text").rlike(r.pattern)
        return F.when(need, spans).otherwise(none)

    return met.select("doc_id", F.array_sort(F.concat(*[of(k, r) for k, r in enumerate(rules)])).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The columns that are compared: counts and a digest of the base spans, and all spans as a string."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", name), ",").alias("spans"),
    )
