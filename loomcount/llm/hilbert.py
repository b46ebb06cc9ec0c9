"""Sharding along a Hilbert curve over quantised metadata.

Each dimension is cut at quantiles into 2^BITS steps, the steps give an index on the Hilbert curve, rows are ordered by (index, text checksum, doc_id) and the order is cut into runs of equal
row counts (law `rows`: counts at most one apart). Files of a run span a small box of the metadata space, so min/max statistics prune on every dimension. Equal texts with equal metadata stand side by side.

Strings are cut at the quantiles of whole strings, exactly: their different values are counted and these counts summed in their order. Places in the order are numbered in sampled ranges of about equal numbers of rows, so no task sees a whole
cell or group of equal texts, however large, and the result does not depend on how rows are dealt.

Defined results: null dimensions take step 0; a null text has size 1 and checksum 0; texts of any length are read whole; null doc_ids come first in their cell and checksum; repeated rows get slots of their own; an empty
table gives an empty result; dimension columns that are absent raise Spark's usual error, more than MOST_DIMS a ValueError; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.functions.ordered import numbered, running
from loomcount.llm.common import unused, written

BITS, MOST_DIMS = 4, 15


def hilbert_index(steps: Column, dims: int, bits: int = BITS) -> Column:
    """Position on the curve of an array of `dims` integers below 2^bits, by built-in functions (Skilling's transpose form)."""
    todo = F.expr(f"transform(sequence(0, {dims * (bits - 1) - 1}), k -> named_struct('q', shiftleft(1, cast({bits} - 1 - k div {dims} as int)), 'i', k % {dims}))") if bits > 1 else F.expr("cast(array() as array<struct<q:int,i:int>>)")

    def step(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        flip = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(q - 1)).otherwise(v))
        t = x[0].bitwiseXOR(F.get(x, i)).bitwiseAND(q - 1)
        swap = F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(t)).otherwise(v))
        return F.when(F.get(x, i).bitwiseAND(q) != 0, flip).otherwise(swap)

    turned = F.aggregate(todo, steps, step)
    gray = F.aggregate(turned, F.array().cast("array<int>"), lambda a, v: F.array_append(a, v.bitwiseXOR(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))
    bit_list = F.expr(f"transform(sequence(1, {bits - 1}), k -> shiftleft(1, cast(k as int)))") if bits > 1 else F.expr("cast(array() as array<int>)")
    boxed = F.transform(F.array(gray), lambda x: F.struct(x.alias("x"), F.aggregate(bit_list, F.lit(0), lambda a, q: F.when(x[dims - 1].bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a)).alias("t")))
    done = F.get(F.transform(boxed, lambda b: F.transform(b["x"], lambda v: v.bitwiseXOR(b["t"]))), F.lit(0))
    order = F.expr(f"transform(sequence(0, {bits * dims - 1}), k -> named_struct('i', k % {dims}, 'q', shiftleft(1, cast({bits} - 1 - k div {dims} as int))))")
    return F.get(F.transform(F.array(done), lambda x: F.aggregate(order, F.lit(0).cast("long"), lambda a, s: a * 2 + F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0))), F.lit(0))


def _string_cuts(rows: DataFrame, name: str) -> list[str]:
    """The values at the quantiles 1 / 2^BITS, 2 / 2^BITS, ... of a column of strings, at most 2^BITS - 1 of them; nulls don't count."""
    counts = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    upto = lambda c: F.floor(c * 2**BITS / total)
    cuts = running(counts, name, {"before": F.col("n")}).filter(upto(F.col("before") + F.col("n")) > upto(F.col("before")))
    return sorted(r[0] for r in cuts.select(name).collect())  # 2^BITS rows at most


def assign(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, cell, shard, slot of each row of docs."""
    if not 0 < len(dims) <= MOST_DIMS:
        raise ValueError(f"1 to {MOST_DIMS} dimensions")
    text, kinds = F.coalesce(F.col("text"), F.lit("")), dict(docs.dtypes)
    strings = [i for i, d in enumerate(dims) if kinds[d] in ("string", "binary")]
    rows = written(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            *[(F.col(d).cast("string") if i in strings else F.col(d).cast("double")).alias(f"d{i}") for i, d in enumerate(dims)],
        ),
        "hilbert-rows",
    )
    shares = [k / 2**BITS for k in range(1, 2**BITS)]
    numbers = [i for i in range(len(dims)) if i not in strings]
    got = rows.agg(F.count(F.lit(1)), *[F.percentile_approx(f"d{i}", shares, 10_000) for i in numbers]).first()
    total, cuts = got[0], dict(zip(numbers, got[1:], strict=True)) | {i: _string_cuts(rows, f"d{i}") for i in strings}

    def step(i: int) -> Column:
        kind = "string" if i in strings else "double"
        at = F.array(*[F.lit(v) for v in cuts[i] or []]).cast(f"array<{kind}>")
        return F.when(F.col(f"d{i}").isNull(), 0).otherwise(F.size(F.filter(at, lambda v: F.col(f"d{i}") > v)))

    steps = F.array(*[step(i) for i in range(len(dims))])
    rows = rows.select("doc_id", "size", "text_crc32", hilbert_index(steps, len(dims)).alias("cell"))
    ranked = numbered(rows, "cell", "place", then=("text_crc32", "doc_id"))
    rank, n = "(place - 1)", f"{max(total, 1)}L"
    run = f"({rank} * {shards}) div {n}"
    slot = F.expr(f"{rank} - (({run}) * {n} + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "cell", F.expr(run).cast("int").alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 8, rows_per_file: int = 1_000_000) -> None:
    """The documents as Parquet under path, a folder for each shard, rows of a file in the order of the curve; if docs has columns
    `shard` or `slot`, the new ones get underscores before their names. Rows meet their places
    by doc_id and checksum, which only interchangeable rows share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    _id, _crc, _nth, shard, slot = (unused(c, docs) for c in ("_id", "_crc", "_nth", "shard", "slot"))
    same = W.partitionBy(_id, _crc)
    placed = assign(docs, dims, shards).select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias(_id), F.col("text_crc32").alias(_crc), F.col("shard").alias(shard), F.col("slot").alias(slot))
    placed = placed.withColumn(_nth, F.row_number().over(same.orderBy(shard, slot)))
    left = docs.withColumns({_id: F.coalesce(F.col("doc_id"), F.lit(-1)), _crc: F.crc32(text.cast("binary"))}).withColumn(_nth, F.row_number().over(same.orderBy(_id)))
    out = left.join(placed, [_id, _crc, _nth]).drop(_id, _crc, _nth)
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard).parquet(path)
