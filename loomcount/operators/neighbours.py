"""Exact nearest neighbours and range search by a partition of space (survey 2.14, kd-tree).

Leaves come from medians of a bounded, seeded sample (SAMPLE rows, SAMPLE_VALUES numbers): each cut halves the sample rows of a node at the median of its widest dimension. Every vector is dealt to its leaf; a leaf's box
is made of the vectors that lie there, so its bound is proven, not estimated. Leaves are at most MOST_LEAVES, which bounds what is broadcast (cuts and boxes); a leaf of any length is split into blocks of about BLOCK.

Nearest neighbours take two rounds. In the first a query reads the leaves nearest to it that together hold k candidates, and gets a bound: its k-th distance there. In the
second it reads all other leaves whose box is within the bound, and none else: a leaf that is left out can't hold a nearer vector. A range search reads the leaves within its radius. Distances are
Euclidean, in double precision, on the original vectors; ties go to the smaller id.

In many dimensions boxes overlap and most leaves are read; the answer stays exact. `leaves_read` counts them.

Vectors that are null, empty or hold null or non-finite components, or have another length than the longest one's, and rows without id, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.operators.stats import finite
from loomcount.sources.tables import written

SAMPLE, SAMPLE_VALUES, MOST_LEAVES, LEAF, BLOCK, QUERIES, SEED = 16_384, 1 << 21, 4_096, 1_024, 2_048, 256, 5
SLACK = 1 + 1e-9  # on squared bounds, so that rounding leaves no candidate out


class Tree:
    """Cuts of a complete binary tree: node i has the children 2i + 1 and 2i + 2; the leaves are numbered from left to right."""

    def __init__(self, sample, depth: int):
        import numpy as np

        self.depth, inner = depth, (1 << depth) - 1
        self.dim, self.at = np.zeros(inner, dtype=np.int64), np.zeros(inner)
        held = {0: sample}
        for i in range(inner):
            x = held.pop(i)
            if len(x):
                self.dim[i] = np.argmax(x.max(0) - x.min(0))
                self.at[i] = np.median(x[:, self.dim[i]])
            right = x[:, self.dim[i]] > self.at[i]
            held[2 * i + 1], held[2 * i + 2] = x[~right], x[right]

    def leaf(self, x):
        import numpy as np

        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.dim[node]] > self.at[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


class Index:
    """The dealt vectors (id, v, leaf, block) and the leaves' boxes (low, high: leaves x dimensions) and sizes."""

    def __init__(self, vectors: DataFrame, ident: str, vector: Column):
        import numpy as np

        rows = vectors.select(F.col(ident).cast("long").alias("id"), vector.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
        width, n = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
        self.width, self.rows = width or 0, None
        if not n:
            return
        rows = rows.filter(F.size("v") == width)
        got = rows.orderBy(F.xxhash64(F.lit(SEED), "id")).limit(max(64, min(SAMPLE, SAMPLE_VALUES // width))).select("v").toArrow().column("v").combine_chunks()
        depth = int(min(np.log2(MOST_LEAVES), max(0, np.ceil(np.log2(n / LEAF)))))
        tree = Tree(got.flatten().to_numpy().reshape(-1, width), depth)
        sent = rows.sparkSession.sparkContext.broadcast(tree)

        def deal(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, width)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.leaf(x), pa.int32())], names=["id", "v", "leaf"])

        self.dealt = written(rows.mapInArrow(deal, "id long, v array<double>, leaf int"), "leaves")
        sizes = np.zeros(1 << depth, dtype=np.int64)
        for r in self.dealt.groupBy("leaf").count().collect():  # a row a leaf
            sizes[r["leaf"]] = r["count"]

        def boxes(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            low, high = {}, {}
            for b in batches:
                x, leaf = b.column(1).flatten().to_numpy().reshape(b.num_rows, width), b.column(0).to_numpy()
                for k in np.unique(leaf).tolist():
                    own = x[leaf == k]
                    low[k] = np.minimum(low.get(k, np.inf), own.min(0))
                    high[k] = np.maximum(high.get(k, -np.inf), own.max(0))
            if low:
                yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), *(pa.array([x.tolist() for x in side.values()], pa.list_(pa.float64())) for side in (low, high))], names=["leaf", "low", "high"])

        self.low, self.high = np.full((2, 1 << depth, width), np.inf)
        part = self.dealt.repartition("leaf", F.pmod("id", F.lit(16))).select("leaf", "v").mapInArrow(boxes, "leaf int, low array<double>, high array<double>")
        part = part.select("leaf", F.posexplode(F.arrays_zip("low", "high"))).groupBy("leaf", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
        got = part.toArrow()  # MOST_LEAVES rows for each dimension at most
        at = got.column("leaf").to_numpy(), got.column("pos").to_numpy()
        self.low[at], self.high[at] = got.column("low").to_numpy(), got.column("high").to_numpy()
        self.sizes, self.blocks = sizes, np.maximum(1, -(-sizes // BLOCK))
        self.rows = self.dealt


def box_distances(x, low, high):
    """Squared distance of each row of x to each box; infinite for empty boxes."""
    import numpy as np

    out = np.empty((len(x), len(low)))
    for i, v in enumerate(x):
        away = np.maximum(np.maximum(low - v, v - high), 0)
        out[i] = np.einsum("ij,ij->i", away, away)
    out[:, np.isinf(low[:, 0])] = np.inf
    return out


def _asked(index: Index, queries: DataFrame, k: int | None, radius: float | None, first: bool) -> DataFrame:
    """query_id, v, bound, leaf of each leaf that a query (query_id, v[, bound]) has to read."""
    sent = index.rows.sparkSession.sparkContext.broadcast((index.low, index.high, index.sizes))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        low, high, sizes = sent.value
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, low.shape[1])
            bound = b.column(2).to_numpy(zero_copy_only=False)
            for s in range(0, len(x), 256):
                d = box_distances(x[s : s + 256], low, high)
                if radius is not None:
                    take = d <= radius * radius * SLACK
                else:
                    order = np.argsort(d, axis=1, kind="stable")
                    held = np.cumsum(sizes[order], axis=1)
                    near = np.zeros(d.shape, dtype=bool)
                    np.put_along_axis(near, order, held - sizes[order] < k + 1, 1)
                    near &= sizes > 0
                    take = near if first else (d <= (bound[s : s + 256] ** 2 * SLACK)[:, None]) & ~near
                i, leaf = np.nonzero(take)
                some = b.slice(s, 256).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(leaf, pa.int32())], names=["query_id", "v", "bound", "leaf"])

    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"), "bound")
    return queries.mapInArrow(run, "query_id long, v array<double>, bound double, leaf int")


def _read(index: Index, asked: DataFrame, k: int | None, radius: float | None) -> DataFrame:
    """query_id, id, distance of what the asked leaves hold: the k nearest of each block, or all within the radius."""
    spark = index.rows.sparkSession
    blocks = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(index.blocks)], "leaf int, blocks int"))  # at most MOST_LEAVES rows
    parts = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))  # a row a leaf
    asked = asked.join(blocks, "leaf").join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leaf", "block", "part", "query_id", "v", "bound")
    held = index.rows.join(blocks, "leaf").join(F.broadcast(parts), "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("leaf", "block", "part", "id", "v")
    width = index.width

    def scan(held, asked):
        import numpy as np
        import pyarrow as pa

        flat = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, width)
        out = []
        if held.num_rows and asked.num_rows:
            x, ids = flat(held), held.column("id").to_numpy()
            for q, v, bound in zip(asked.column("query_id").to_numpy(), flat(asked), asked.column("bound").to_numpy(), strict=True):
                away = x - v
                d = np.sqrt(np.einsum("ij,ij->i", away, away))
                some = np.flatnonzero((ids != q) & (d <= (radius if radius is not None else bound)))
                if k is not None and len(some) > k:
                    some = some[d[some] <= np.partition(d[some], k - 1)[k - 1]]
                    some = some[np.lexsort((ids[some], d[some]))[:k]]
                out.append((np.full(len(some), q), ids[some], d[some]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2], pa.float64())})

    key = ["leaf", "block", "part"]
    return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(scan, "query_id long, id long, distance double")


def nearest(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, distance of the k nearest vectors of each query (query_id, v), without the one that has the query's id."""
    if index.rows is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance double")
    queries = queries.withColumn("bound", F.lit(float("inf"))).filter((F.size("v") == index.width) & F.forall("v", finite))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    one = written(_read(index, _asked(index, queries, k, None, True), k, None).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "near")
    bound = one.groupBy("query_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    more = queries.join(bound, "query_id", "left").withColumn("bound", F.when(F.col("n") >= k, F.col("far")).otherwise(F.col("bound")))
    two = _read(index, _asked(index, more, k, None, False), k, None)
    both = one.unionByName(two).withColumn("rank", rank).filter(F.col("rank") <= k)
    return both.select("query_id", "rank", "id", "distance")


def within(index: Index, queries: DataFrame, radius: float) -> DataFrame:
    """query_id, id, distance of all vectors within the radius of each query (query_id, v), without the one that has the query's id."""
    if index.rows is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, distance double")
    queries = queries.withColumn("bound", F.lit(float("inf"))).filter((F.size("v") == index.width) & F.forall("v", finite))
    return _read(index, _asked(index, queries, None, radius, True), None, radius)


def leaves_read(index: Index, queries: DataFrame, k: int, bounds: DataFrame) -> DataFrame:
    """query_id, first, second: the leaves that `nearest` reads in its rounds for queries (query_id, v), given its answers."""
    queries = queries.withColumn("bound", F.lit(float("inf")))
    far = bounds.groupBy("query_id").agg(F.max("distance").alias("far"))
    one = _asked(index, queries, k, None, True).groupBy("query_id").agg(F.count(F.lit(1)).alias("first"))
    two = _asked(index, queries.drop("bound").join(far, "query_id").withColumnRenamed("far", "bound"), k, None, False).groupBy("query_id").agg(F.count(F.lit(1)).alias("second"))
    return one.join(two, "query_id", "left").fillna(0, ["second"])
