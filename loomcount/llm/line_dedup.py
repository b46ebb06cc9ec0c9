"""Line dedup: repeated runs of lines by a suffix array over line ids.

Texts become sequences of line ids. Lines that occur once end every repeated run, so only stretches (segments) of lines that occur more
than once go on. Their suffixes are ranked by distributed prefix doubling: round k gives each position the rank of its next 2^k
lines, that is the number of suffixes that are smaller in these lines, by ranking the pairs (rank of 2^(k-1) lines here, rank of 2^(k-1)
lines further on). Equal ranks are an interval of the suffix array whose longest common prefix is at least 2^k lines. Any run of m
lines, 2^k <= m < 2^(k+1), is named by the ranks of its first and its last 2^k lines, which gives the intervals of common prefix m.

A run counts from `min_words` words on. For each line the shortest run of that many words that starts there and the shortest
that ends there are looked up; they cover all lines of every maximal repeated run, and as their lengths follow from their own lines, copies
look up the same runs. Of each run the first occurrence, by (doc_id, place), stays; the lines of later ones are deleted, unless they overlap
the first one in the same document (of sixty equal lines the first fifty words stay). The number of rounds is the logarithm of the longest such run.

Ranks are running sums over distinct pairs, taken in two steps (ranges of the second rank, then inside a range), so that a line that
starts a third of all suffixes is not one task.

Defined results: lines end at "\\n"; a null text stays null, an empty one empty; a null doc_id sorts first; rows that repeat both doc_id and text
count as one document and lose the same lines; a text all of whose lines go becomes empty; texts and lines of any length are read whole; an empty table stays
empty; all columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.llm.common import unused, written

MIN_WORDS, RANGES = 50, 1024
WORD = r"[^\x20\x09-\x0D]+"


def _ranked(pairs: DataFrame, first: str, second: str, width: int) -> DataFrame:
    """pairs (first, second, n) with `below`: the sum of n over pairs of the same first and a smaller second. Second lies in 0..width * RANGES."""
    ranged = pairs.withColumn("_range", F.floor(F.col(second) / width).cast("int"))
    inner = W.partitionBy(first, "_range").orderBy(second).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(first).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(first, "_range").agg(F.sum("n").alias("_n"))
    sums = sums.select(first, "_range", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_at"))
    return ranged.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(sums, [first, "_range"]).withColumn("below", F.col("_at") + F.col("_in")).drop("_range", "_at", "_in")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h (hash of the text), gone: the numbers (from 0) of the lines to delete; only of documents that lose some."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    line = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), line.alias("line"))
    rows = texts.select("doc_id", "h", F.posexplode("line").alias("pos", "line")).select("doc_id", "h", "pos", "line.*")
    rows = written(rows, "line-rows")

    # ids that occur more than once; the id's rank is the number of lines with smaller ids
    same = ["a", "b"]
    once = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = once.withColumn("part", F.shiftright("a", 52).cast("int"))  # 4,096 ranges of ids
    sums = spread.groupBy("part").agg(F.sum("n").alias("s")).select("part", (F.sum("s").over(W.orderBy("part")) - F.col("s")).alias("at"))
    inner = W.partitionBy("part").orderBy(*same).rowsBetween(W.unboundedPreceding, -1)
    named = spread.withColumn("in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(sums, "part").select(*same, (F.col("at") + F.col("in")).alias("r0"))
    by_doc = W.partitionBy("doc_id", "h").orderBy("pos")
    # rows that repeat doc_id and text are one document
    live = rows.join(named, same).groupBy("doc_id", "h", "pos").agg(F.first("w").alias("w"), F.first("r0").alias("r0"))
    live = live.withColumn("seg", F.col("pos") - F.row_number().over(by_doc))
    seg = ["doc_id", "h", "seg"]
    live = live.withColumn("c", F.sum("w").over(W.partitionBy(*seg).orderBy("pos")).cast("long"))
    # segments too short for a run go
    live = live.withColumn("all", F.sum("w").over(W.partitionBy(*seg))).filter(F.col("all") >= min_words).drop("all")
    live = written(live, "line-live")

    def met(point, query, ascending: bool) -> DataFrame:
        """For each place the place of the last point before its query in the order of values."""
        both = live.select(*seg, "pos", F.explode(F.array(F.struct(point.alias("v"), F.lit(0).alias("q")), F.struct(query.alias("v"), F.lit(1).alias("q")))).alias("x"))
        order = [F.asc("x.v"), F.asc("x.q"), F.asc("pos")] if ascending else [F.desc("x.v"), F.asc("x.q"), F.desc("pos")]
        last = F.last(F.when(F.col("x.q") == 0, F.col("pos")), ignorenulls=True).over(W.partitionBy(*seg).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        return both.withColumn("to", last).filter("x.q = 1 AND to IS NOT NULL")

    ends = met(F.col("c"), F.col("c") - F.col("w") + min_words, False).select(*seg, "pos", (F.col("to") - F.col("pos") + 1).alias("m"))
    starts = met(F.col("c") - F.col("w"), F.col("c") - min_words, True).select(*seg, F.col("to").alias("pos"), (F.col("pos") - F.col("to") + 1).alias("m"))
    runs = ends.unionByName(starts).groupBy(*seg).agg(F.collect_set(F.struct("pos", "m")).alias("runs"))
    runs = written(runs, "line-runs")
    got = runs.agg(F.max(F.array_max(F.transform("runs", lambda x: x["m"])))).first()[0]
    longest = got or 1
    highest = live.agg(F.max("r0")).first()[0] or 0

    k = 0
    while 2 << k <= longest:
        by_seg = W.partitionBy(*seg).orderBy("pos")
        # lead() counts rows, and the rows of a segment are consecutive lines
        pairs = live.withColumn("r", F.col(f"r{k}")).withColumn("s", F.lead(f"r{k}", 1 << k).over(by_seg))
        known = pairs.filter("r IS NOT NULL AND s IS NOT NULL")
        shared = known.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n"))
        ranks = _ranked(shared, "r", "s", max(1, -(-(highest + 1) // RANGES))).filter("n > 1").select("r", "s", (F.col("r") + F.col("below")).alias(f"r{k + 1}"))
        live = written(pairs.join(ranks, ["r", "s"], "left").drop("r", "s"), f"line-ranks-{k + 1}")
        k += 1

    levels = [f"r{i}" for i in range(k + 1)]
    stored = live.groupBy(*seg).agg(F.array_sort(F.collect_list(F.struct("pos", *levels))).alias("sa"))
    looked = runs.join(stored, [runs[c].eqNullSafe(stored[c]) for c in seg]).select(runs["doc_id"], runs["h"], "sa", F.explode("runs").alias("run"))
    at = F.col("run.pos") - F.get("sa", F.lit(0))["pos"]
    name = F.lit(None).cast("struct<x:bigint,y:bigint>")
    for i in range(k + 1):
        here = (F.col("run.m") >= (1 << i)) & (F.col("run.m") < (2 << i))
        pair = F.struct(F.get("sa", at)[f"r{i}"].alias("x"), F.get("sa", at + F.col("run.m") - (1 << i))[f"r{i}"].alias("y"))
        name = F.when(here, pair).otherwise(name)
    found = looked.select("doc_id", "h", F.col("run.pos").alias("pos"), F.col("run.m").alias("m"), name.alias("name")).filter("name.x IS NOT NULL AND name.y IS NOT NULL")
    place = F.struct("doc_id", "h", "pos")
    first = found.groupBy("m", "name").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("h").eqNullSafe(F.col("first.h"))
    later = found.join(first, ["m", "name"]).filter(~here | (F.col("pos") >= F.col("first.pos") + F.col("m")))
    gone = later.select("doc_id", "h", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("line"))
    return gone.groupBy("doc_id", "h").agg(F.collect_set("line").alias("gone"))


def appended(docs: DataFrame) -> tuple[str, str]:
    """The names that `dedup` gives to the number of lines before and the number deleted."""
    return unused("_lines", docs), unused("_gone", docs)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the deleted lines, with _lines (number before) and _gone (number deleted) appended; names that are taken get underscores before them."""
    _id, _h, _hash, _numbers = (unused(c, docs) for c in ("_id", "_h", "_text_hash", "_gone_lines"))
    gone = written(repeated_runs(docs, min_words), "line-gone").select(F.col("doc_id").alias(_id), F.col("h").alias(_h), F.col("gone").alias(_numbers))
    left = docs.withColumn(_hash, F.xxhash64("text"))
    # the same join at every size: what is deleted grows with the corpus, so it is never broadcast
    met = left.join(gone.hint("merge"), left["doc_id"].eqNullSafe(F.col(_id)) & (F.col(_hash) == F.col(_h)), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(_numbers))
    text = F.when(F.col(_numbers).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    keep = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    n, k = appended(docs)
    return met.select(*keep, F.coalesce(F.size(lines), F.lit(0)).alias(n), F.coalesce(F.size(_numbers), F.lit(0)).alias(k))
