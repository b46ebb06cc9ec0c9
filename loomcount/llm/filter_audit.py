"""Filter interaction audit: what each filter removes in every order of the filters, as an incidence matrix product.

A document is reduced to a mask of the filters that it fails, a bit each. Per part (a value of `lang`) three histograms over the masks are stacked as rows: of all
documents, of those labelled good and of those labelled toxic. All answers for all orders and steps are linear in these histograms, so a part's answers are its rows times
integer matrices of 2^5 masks by 120 orders * 5 steps: whether a mask is kept after the step, removed in it, fails its filter but was removed earlier, fails that filter alone.
Documents are read once and never sorted or compared for an order.

Texts are told apart by SHA-256. Whether a smaller doc_id has the same text is asked by joining each row's digest and doc_id with the digest's smallest
doc_id: a group of copies of any size is reduced on the map side, and the join's key names one document, not the group. Rows that repeat text, doc_id and part are counted before they are
shuffled. Labels meet documents by doc_id; of a doc_id with several labels any 1 counts.

Defined results: a null text counts as empty, texts of any length are read whole; a null lang is the part ''; a null doc_id is no smaller than any other, never fails the filter of copies and has no label; of rows
that share text and doc_id none fails for the other; zeros stand for parts and steps without documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount.llm import runs as rn
from loomcount.llm.common import drop_written, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, MARKS = 200, 50, 3, b"#$%&*|"  # words; per cent of words; per cent of code points; signs
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def matrices(filters: int = len(FILTERS)) -> tuple[list[str], dict[str, np.ndarray]]:
    """The orders, and int64 matrices masks x (orders * steps): kept, removed, redundant, unique, and shapley (removals of the column's filter in all orders)."""
    orders = list(permutations(range(filters)))
    mask = np.arange(1 << filters)[:, None]
    fails = (mask >> np.arange(filters)) & 1  # masks x filters
    order = np.array(orders)
    at = order.ravel()  # the filter of each column
    before = np.zeros((1 << filters, len(orders), filters + 1), dtype=np.int64)  # failing filters among the first steps
    before[:, :, 1:] = np.cumsum(fails[:, order], axis=2)
    earlier, after = (x.reshape(1 << filters, -1) > 0 for x in (before[:, :, :-1], before[:, :, 1:]))
    own = fails[:, at] > 0
    out = {"kept": ~after, "removed": own & ~earlier, "redundant": own & earlier, "unique_fails": mask == 1 << at}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    by_filter = np.stack([out["removed"][:, at == f].sum(1) for f in range(filters)], axis=1)
    return ["".join(FILTERS[f] for f in o) for o in orders], out | {"shapley": by_filter[:, at]}


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask (filters A to D) of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from loomcount.llm import ngram_hash as ng

        mark, upper, inner = np.zeros((3, 256), bool)
        mark[list(MARKS)] = True
        upper[ord("A") : ord("Z") + 1] = True
        inner[0x80:0xC0] = True  # all bytes of a code point but its first
        for b in batches:
            data, offsets = ng.arrow_strings(b.column(3))
            out = np.zeros(b.num_rows, dtype=np.int32)
            for first, last in rn.chunks(offsets):
                some, n = offsets[first : last + 1] - offsets[first], last - first
                raw = data[offsets[first] : offsets[last]]
                found, text = rn.runs(raw, some, rn.WORD)
                wide = max(1, len(found.dictionary))
                words = np.bincount(text, minlength=n)
                distinct = np.bincount(np.unique(text * wide + found.indices.to_numpy(zero_copy_only=False)) // wide, minlength=n)
                capitals, later, marks = (np.bincount(np.searchsorted(some, np.flatnonzero(kind[raw]), side="right") - 1, minlength=n) for kind in (upper, inner, mark))
                points = np.diff(some) - later
                fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_UPPER * points, marks > 0)
                out[first:last] = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out)], names=["doc_id", "part", "digest", "mask"])

    text = F.coalesce("text", F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def _histograms(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """part, mask, good, toxic, n; and the written table that it reads."""
    rows = written(masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    label = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    label = label.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = rows.join(first, ["digest", "doc_id"], "left").join(label, "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return met.groupBy("part", mask.alias("mask"), zero("good"), zero("toxic")).agg(F.sum("n").alias("n")), rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    counts, rows = _histograms(docs, labels)
    cells = 1 << len(FILTERS)
    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("h"))  # 4 entries a mask at most
    stacked = written(stacked, "audit-histograms")
    drop_written(rows)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        orders, by = matrices()
        steps = len(FILTERS)
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(1).flatten()
            mask, is_good, is_toxic, count = (h.field(k).to_numpy() for k in range(4))
            at = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            n, good, toxic = np.zeros((3, b.num_rows, cells), dtype=np.int64)
            for rows, held in ((n, 1), (good, is_good), (toxic, is_toxic)):
                np.add.at(rows, (at, mask), count * held)
            columns = [n @ by[x] for x in ("kept", "removed", "redundant", "unique_fails")] + [good @ by["removed"], toxic @ by["removed"], n @ by["shapley"]]
            part = np.repeat(np.arange(b.num_rows), len(orders) * steps)
            named = [b.column(0).take(pa.array(part)), pa.array(np.tile(np.repeat(orders, steps), b.num_rows)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders) * b.num_rows))]
            yield pa.RecordBatch.from_arrays(named + [pa.array(c.ravel()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return stacked.mapInArrow(run, SCHEMA)
