"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its PREFIX nearest reference points (pivots) in order. Vectors at a small angle see the pivots in nearly the same order,
so pairs are retrieved through inverted lists of pivots: a pair is a candidate when at least SHARED pivots stand in both descriptions, and candidates are verified by their
cosine in double precision. With 16 and 3, pairs at a cosine of just 0.9 in 16 to 256 dimensions are retrieved in more than 99.6 % of the cases with up to 4,096 pivots, nearer ones more often; unrelated pairs are
candidates in 0.01 to 0.6 %.

Pivots are chosen from a bounded, seeded sample (SAMPLE vectors, SAMPLE_VALUES numbers) of the different vectors, greedily such that any two are APART; closer ones are taken only where there are too few. So a dense
group gets one pivot, not many that would describe its members by chance. About 4 sqrt(n) pivots are used, MOST_PIVOTS and PIVOT_VALUES numbers at most, which bounds the broadcast. Every vector is indexed.

Equal vectors are one node with a weight. A node's nearest pivot and its angle to it make balls: nodes within the ball's core radius all link with each other, and never with
the core of another ball, by the triangle inequality. These pairs are counted from the ball's weight and never compared, so a tight group costs what its members cost. All other pairs have a node of the rim:

* The list of a pivot holds the nodes with it in their description; lists without rims are dropped. Lists with too many pairs are refined to the nodes that share a second and a third pivot
  (up to SHARED: these must be shared anyway). A pair belongs to the list of its smallest shared pivots only. What is still too long is dealt as pairs of parts of LIST nodes at most, so that no task holds more than two.
* Inside a list the shared pivots of each rim with every node are counted by merging the sublists of its other pivots; only pairs that reach SHARED are verified. A list returns its linked
  nodes with the weight that they link with and a label of their component inside the list: a row a node, never a row a pair.

Links are summed by node; components join the labels by alternating stars.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component; vectors of different
length don't link; rows without vec_id get no links, no component and stay; of rows that repeat a vec_id each counts as a vector; labels and other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount.llm.common import drop_written, unused, written
from loomcount.llm.jaccard_join import components

COSINE, PREFIX, SHARED, LIST = 0.9, 16, 3, 1_024
SAMPLE, SAMPLE_VALUES, MOST_PIVOTS, PIVOT_VALUES, SEED = 16_384, 1 << 21, 4_096, 1 << 21, 11
APART = (0.6, 0.75, 0.85, 0.95, 1.0)  # most cosine of two pivots, loosened in turn
MARGIN = 1e-6  # radians between what the triangle inequality decides and what is compared
ELSEWHERE, PAIRS = 1_000, 65_536


def choose_pivots(sample, most: int):
    """Rows of unit vectors as pivots, in the order of the sample."""
    import numpy as np

    chosen = np.zeros(len(sample), dtype=bool)
    for apart in APART:
        near = sample @ sample[chosen].T if chosen.any() else np.zeros((len(sample), 0))
        free = ~chosen & (near < apart).all(axis=1)
        for i in range(len(sample)):
            if chosen.sum() >= most:
                return sample[chosen]
            if free[i]:
                chosen[i] = True
                free &= sample @ sample[i] < apart
    return sample[chosen]


def core_radii(pivots, angle: float):
    """Of each pivot's ball, the angle up to which its nodes link with each other and with no other ball's core."""
    import numpy as np

    if len(pivots) < 2:
        return np.full(len(pivots), angle / 2 - MARGIN)
    near = np.array([np.delete(pivots @ p, i).max() for i, p in enumerate(pivots)])
    apart = np.arccos(np.clip(near, -1, 1))
    return np.minimum(angle / 2, (apart - angle) / 2) - MARGIN


def linked(key, desc, core, vectors, left, right, cosine: float = COSINE):
    """Of nodes described by `desc` those pairs (places in left, right) of a list that link. key: the smallest pivots that the pairs of this list share."""
    import numpy as np

    last, need = key[-1], min(SHARED, desc.shape[1]) - len(key)
    shared = np.zeros((len(left), len(right)), dtype=np.int16)
    pivot, owner = desc.ravel(), np.repeat(np.arange(len(desc)), desc.shape[1])
    side = np.full((2, len(desc)), -1)
    side[0, left], side[1, right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(pivot, kind="stable")
    cuts = np.flatnonzero(np.diff(pivot[order])) + 1
    for nodes in np.split(order, cuts):
        u, nodes = pivot[nodes[0]], owner[nodes]
        if u in key or len(nodes) < 2:
            continue
        rows, columns = (side[k, nodes] for k in (0, 1))
        rows, columns = rows[rows >= 0], columns[columns >= 0]
        shared[rows[:, None], columns] += ELSEWHERE if u < last else 1
    good = (shared >= need) & (shared < ELSEWHERE) & (left[:, None] != right[None, :])
    rows, columns = np.nonzero(good)
    keep = np.zeros(len(rows), dtype=bool)
    size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    for s in range(0, len(rows), PAIRS):
        x, y = left[rows[s : s + PAIRS]], right[columns[s : s + PAIRS]]
        keep[s : s + PAIRS] = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= cosine * size[x] * size[y]
    return left[rows[keep]], right[columns[keep]]


def labels_of(n: int, x, y):
    """The smallest place that each of n places reaches by the pairs x, y."""
    import numpy as np

    label = np.arange(n)
    while True:
        after = label.copy()
        np.minimum.at(after, x, label[y])
        np.minimum.at(after, y, label[x])
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _in_list(table):
    """The nodes of a list, or of two parts of it, that link there: node, n (weight that it links with), label."""
    import numpy as np
    import pyarrow as pa

    table = table.combine_chunks()
    get = lambda c: table.column(c).to_numpy()
    rows = table.num_rows
    flat = lambda c, kind: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(kind)
    key = table.column("key")[0].as_py()
    node, w, part, core = get("node"), get("w"), get("part"), get("core")
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    rim = np.flatnonzero(~core & (part == i))
    right = np.arange(rows) if i == j else np.flatnonzero(part == j)
    out = [np.zeros(0, np.int64)] * 3
    if len(rim) and len(right):
        x, y = linked(key, flat("desc", np.int64), core, flat("v", np.float64), rim, right)
        n = np.bincount(x, w[y], rows).astype(np.int64)
        back = ~(~core[y]) if i == j else np.ones(len(y), bool)  # a pair of two rims of one part comes in both orders
        n += np.bincount(y[back], w[x[back]], rows).astype(np.int64)
        label = labels_of(rows, x, y)
        some = np.flatnonzero(n)
        out = [node[some], n[some], node[label[some]]]
    return pa.table({"node": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "label": pa.array(out[2], pa.int64())})


def _described(nodes: DataFrame, pivots, radii, kind: str) -> DataFrame:
    """nodes (node, v, w) with desc (nearest pivots in order), ball (the first) and core."""
    sent = nodes.sparkSession.sparkContext.broadcast((pivots, radii))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pivots, radii = sent.value
        few = min(PREFIX, len(pivots))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64)
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            desc, core = np.zeros((len(x), few), dtype=np.int32), np.zeros(len(x), dtype=bool)
            for s in range(0, len(x), 1_024):
                near = x[s : s + 1_024] @ pivots.T
                part = np.argpartition(-near, few - 1, axis=1)[:, :few]
                value = np.take_along_axis(near, part, 1)
                order = np.lexsort((part, -value))
                desc[s : s + 1_024] = np.take_along_axis(part, order, 1)
                angle = np.arccos(np.clip(value.max(axis=1), -1, 1))
                core[s : s + 1_024] = angle <= radii[desc[s : s + 1_024, 0]]
            cuts = pa.array(np.arange(0, (len(x) + 1) * few, few, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(cuts, pa.array(desc.ravel())), pa.array(desc[:, 0]), pa.array(core)], names=["node", "v", "w", "desc", "ball", "core"])

    return nodes.select("node", "v", "w").mapInArrow(run, f"node long, v {kind}, w long, desc array<int>, ball int, core boolean")


def _lists(nodes: DataFrame) -> DataFrame:
    """key, i, j, part, node, v, w, desc, core: the nodes of every list, or pair of its parts, that holds a rim."""
    cols = ["node", "v", "w", "desc", "core"]
    rows = nodes.select(*cols, F.explode("desc").alias("t")).withColumn("key", F.array("t")).drop("t")
    done = None
    for depth in range(1, SHARED + 1):
        rim = F.sum((~F.col("core")).cast("long"))
        sizes = rows.groupBy("key").agg(rim.alias("rims"), F.count(F.lit(1)).alias("all")).filter("rims > 0 AND all > 1")
        refine = (F.col("rims") * F.col("all") > 4 * LIST**2) if depth < SHARED else F.lit(False)
        parts = F.when(F.col("all") <= LIST, 0).otherwise(F.ceil((F.col("all") - F.col("rims")) / LIST)).cast("int")
        sizes = sizes.select("key", refine.alias("refine"), F.ceil(F.col("rims") / LIST).cast("int").alias("rim_parts"), parts.alias("core_parts"))
        met = rows.join(F.broadcast(sizes) if depth == 1 else sizes, "key")  # at most MOST_PIVOTS rows
        some = met.filter("NOT refine")
        done = some if done is None else done.unionByName(some)
        if depth < SHARED:
            more = met.filter("refine").withColumn("t", F.explode(F.expr("filter(desc, x -> x > element_at(key, -1))")))
            rows = more.withColumn("key", F.concat("key", F.array("t"))).select(*cols, "key")
    part = F.when(~F.col("core"), F.pmod(F.xxhash64("node"), F.col("rim_parts"))).when(F.col("core_parts") > 0, F.col("rim_parts") + F.pmod(F.xxhash64("node"), F.col("core_parts"))).otherwise(0)
    done = done.withColumn("part", part.cast("int"))
    last = F.when(F.col("core") & (F.col("core_parts") > 0), F.col("rim_parts") - 1).otherwise(F.col("rim_parts") + F.col("core_parts") - 1)
    done = done.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    return done.select("key", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "part", *cols)


def _usable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, v (null if it takes no part), h1, h2 (names of v) of every row; the type of v."""
    kind = "array<float>" if "float" in dict(vectors.dtypes)["embedding"] else "array<double>"
    v = F.col("embedding").cast(kind)
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull() & good, F.transform(v, lambda x: x + F.lit(0).cast(kind[6:-1]))).alias("v"))
    named = [F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(k), F.col("v"))).alias(f"h{k}") for k in (1, 2)]
    return rows.select("vec_id", "v", *named), kind


def _of_length(nodes: DataFrame, size: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """node, n of the links of vectors of one length; and the edges a, b of their components."""
    import numpy as np

    take = max(64, min(SAMPLE, SAMPLE_VALUES // size))
    got = nodes.orderBy(F.xxhash64(F.lit(SEED), "node")).limit(take).select("v").toArrow().column("v").combine_chunks()
    sample = got.flatten().to_numpy().reshape(len(got), -1).astype(np.float64)
    sample /= np.sqrt((sample**2).sum(1))[:, None]
    most = max(PREFIX, min(MOST_PIVOTS, PIVOT_VALUES // size, math.ceil(4 * nodes.count() ** 0.5)))
    pivots = choose_pivots(sample, most)
    described = written(_described(nodes, pivots, core_radii(pivots, math.acos(COSINE)), kind), "pivot-nodes")
    found = written(_lists(described).groupBy("key", "i", "j").applyInArrow(_in_list, "node long, n long, label long"), "pivot-links")
    cores = described.filter("core").select("ball", "node", "w")
    balls = cores.groupBy("ball").agg(F.sum("w").alias("all"), F.min("node").alias("first"))
    cores = cores.join(F.broadcast(balls), "ball")  # at most MOST_PIVOTS rows
    n = found.select("node", "n").unionAll(cores.select("node", F.col("all") - F.col("w")))
    edges = found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(cores.select("node", "first")).filter("a <> b")
    return n, edges


def join(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    rows, kind = _usable(vectors)
    rows = written(rows, "pivot-rows")
    nodes = rows.filter("v IS NOT NULL").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("low"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "pivot-vectors")
    n = edges = None
    for r in nodes.groupBy(F.size("v").alias("size")).count().orderBy("size").collect():  # a row for each length of vectors
        more_n, more_edges = _of_length(nodes.filter(F.size("v") == r["size"]), r["size"], kind)
        n, edges = (more_n, more_edges) if n is None else (n.unionAll(more_n), edges.unionAll(more_edges))
    if n is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = written(components(edges), "pivot-components")
    n = n.groupBy("node").agg(F.sum("n").alias("n"))
    met = nodes.select("node", "h1", "h2", "w", "low").join(n, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    met = written(met, "pivot-met")
    ids = met.groupBy("comp").agg(F.min("low").alias("component_id"))
    to = met.join(ids, "comp").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(to, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def keep_one(vectors: DataFrame) -> DataFrame:
    """The rows of vectors with the smallest vec_id of each component, and all rows without vec_id."""
    name = unused("id", vectors)
    few = join(vectors).filter("kept").select(F.col("vec_id").alias(name)).distinct()
    return vectors.join(few, vectors["vec_id"].cast("long").eqNullSafe(few[name]), "left_semi")
