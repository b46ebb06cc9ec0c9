"""Ranked lexical search as a blocked sparse matrix product: item-term multiplicities times term-document impacts.

Items are dealt into blocks of about ITEM_TERMS (item, term) entries. A block's item-term matrix is broadcast, so its size is bounded (an item of
more terms makes a block of its own), and the documents are read twice for each block:

1. Each task counts, for the terms of the block, the documents that hold them, and all documents and terms; these partial counts are summed
   by term. They give the weights, a vector as long as the block's vocabulary.
2. Each task makes of every chunk of texts the term-document matrix of int64 impacts, rows sorted by term, and multiplies: the rows of an item's terms are
   merged, scaled by their multiplicity, into one accumulator over the chunk's documents (Gustavson's order). Of each product row the best k go on
   to the task's best k, so a task gives at most k rows an item, whatever its number of documents.

The tasks' rows meet in two steps, first in MEET groups an item, so that no group gathers the rows of all tasks. Nothing is pruned: every document is scored for each item.

Score: the sum, over an item's terms with repeats, of w * ((10^9 tf) div (1000 tf + 8 m)), m = 25 + (75 n N) div L, w = floor(1000 ln((2N + 2) / (2 df + 1)));
integers throughout, the product 75 n N without overflow.

Defined results: terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased and nothing else, texts of any length are read whole; a null, empty or
termless document counts for nothing and is never found; an item without terms, or none of whose terms scores, has no row; documents that repeat an id or a text are ranked
each for itself, equal scores by ascending doc_id, null ids last; items that repeat an item_id, or have none, are items of their own; empty tables give
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.llm import runs as rn
from loomcount.llm.common import drop_written, written

ITEM_TERMS, MEET = 500_000, 64
SCHEMA = "item_id long, rank int, doc_id long, score long"


def _item_rows(items: DataFrame) -> DataFrame:
    """item_id, terms and times (multiplicities) of each item with terms."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from loomcount.llm import ngram_hash as ng

        for b in batches:
            data, offsets = ng.arrow_strings(b.column(1))
            for first, last in rn.chunks(offsets):
                some = offsets[first : last + 1]
                found, text = rn.runs(data[some[0] : some[-1]], some - some[0], rn.TERM, True)
                wide = max(1, len(found.dictionary))
                key, times = np.unique(text * wide + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
                of, which = key // wide, key % wide
                cuts = np.searchsorted(of, np.arange(last - first + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(cuts, found.dictionary.cast(pa.binary()).take(pa.array(which)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), terms, pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))], names=["item_id", "terms", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, terms array<binary>, times array<long>").filter(F.size("terms") > 0)


class _Matrix:
    """The item-term matrix of a block by rows: the terms of item i are columns[rows[i]:rows[i + 1]]."""

    def __init__(self, table):
        import numpy as np

        self.ids = table.column("item_id").combine_chunks()
        terms = table.column("terms").combine_chunks()
        coded = terms.flatten().dictionary_encode()
        self.rows = terms.offsets.to_numpy() - terms.offsets[0].as_py()
        self.columns = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.times = table.column("times").combine_chunks().flatten().to_numpy()
        self.vocabulary = coded.dictionary.to_pylist()


def _counted(batches: Iterator, place: dict, column: int):
    """For each chunk of the texts: its first row, number of terms of each text, and (term, text, occurrences) of the terms with a place, sorted by term."""
    import numpy as np

    from loomcount.llm import ngram_hash as ng

    for b in batches:
        data, offsets = ng.arrow_strings(b.column(column))
        for first, last in rn.chunks(offsets):
            some = offsets[first : last + 1]
            found, text = rn.runs(data[some[0] : some[-1]], some - some[0], rn.TERM, True)
            n = np.bincount(text, minlength=last - first)
            term = np.array([place.get(t, -1) for t in found.dictionary.to_pylist()], dtype=np.int64)[found.indices.to_numpy(zero_copy_only=False)] if len(text) else text
            known, docs = term >= 0, last - first
            key, tf = np.unique(term[known] * docs + text[known], return_counts=True)
            yield b, first, n, key // docs, key % docs, tf


def _statistics(texts: DataFrame, sent) -> tuple[int, int, object]:
    """N, L and the document frequency of each term of the block."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        vocabulary = sent.value.vocabulary
        place = {t: i for i, t in enumerate(vocabulary)}
        total = np.zeros(len(vocabulary) + 2, dtype=np.int64)
        for _, _, n, term, _, _ in _counted(batches, place, 0):
            total[:-2] += np.bincount(term, minlength=len(vocabulary))
            total[-2:] += ((n > 0).sum(), n.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["at", "n"])

    got = texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most the block's vocabulary and two rows
    total = np.zeros(len(sent.value.vocabulary) + 2, dtype=np.int64)
    total[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return int(total[-2]), int(total[-1]), total[:-2]


def weights(docs: int, held):
    import numpy as np

    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in held], dtype=np.int64)


def best(score, doc, unknown, k: int):
    """Places of the k first by falling score, then doc, rows without id last."""
    import numpy as np

    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((doc[some], unknown[some], -score[some]))[:k]]


def _products(texts: DataFrame, matrix, known, k: int) -> DataFrame:
    """item (row of the block's matrix), doc_id, score of the best k of each task."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        a, (all_docs, all_terms, weight) = matrix.value, known.value
        place = {t: i for i, t in enumerate(a.vocabulary)}
        top: dict = {}
        for b, first, n, term, text, tf in _counted(batches, place, 1):
            if not len(term):
                continue
            ids = b.column(0).slice(first, len(n))
            unknown, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            m = np.array([25 + (75 * x * all_docs) // all_terms for x in n.tolist()], dtype=np.int64)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[text]))
            start = np.searchsorted(term, np.arange(len(a.vocabulary) + 1))
            for i in range(len(a.rows) - 1):
                total = np.zeros(len(n), dtype=np.int64)
                for j in range(a.rows[i], a.rows[i + 1]):
                    s, e = start[a.columns[j]], start[a.columns[j] + 1]
                    if s < e:
                        total[text[s:e]] += a.times[j] * impact[s:e]
                low = top[i][0][-1] if i in top and len(top[i][0]) == k else 1
                some = np.flatnonzero(total >= low)
                if len(some):
                    new = (total[some], doc[some], unknown[some])
                    if i in top:
                        new = tuple(np.concatenate(x) for x in zip(top[i], new, strict=True))
                    order = best(*new, k)
                    top[i] = tuple(x[order] for x in new)
        if top:
            score, doc, unknown = (np.concatenate(x) for x in zip(*top.values(), strict=True))
            item = np.repeat(np.array(list(top), dtype=np.int64), [len(x[0]) for x in top.values()])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=unknown), pa.array(score)], names=["item", "doc_id", "score"])

    return texts.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    spark = docs.sparkSession
    entries = written(_item_rows(items).withColumn("uid", F.monotonically_increasing_id()), "lexical-items")
    count = entries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-count // ITEM_TERMS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = []
    for block in range(blocks):
        matrix = _Matrix(entries.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).toArrow()) if blocks > 1 else _Matrix(entries.toArrow())
        if not len(matrix.ids):
            continue
        sent = spark.sparkContext.broadcast(matrix)
        all_docs, all_terms, held = _statistics(texts, sent)
        if not all_terms:
            break
        known = spark.sparkContext.broadcast((all_docs, all_terms, weights(all_docs, held)))
        rows = _products(texts, sent, known, k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MEET)))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for key in (("item", "part"), ("item",)):
            rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)
        rows = written(rows.select("item", "rank", "doc_id", "score"), "lexical-found")
        import pyarrow as pa

        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(matrix.ids)), pa.int64()), "item_id": matrix.ids}))
        found.append(rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # the items of a block: at most ITEM_TERMS, or one
        sent.unpersist()
        known.unpersist()
    drop_written(entries)
    out = found[0] if found else spark.createDataFrame([], SCHEMA)
    for more in found[1:]:
        out = out.unionAll(more)
    return out
