"""Link graph features over an edge table (src, dst, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount.functions.special import ratio


def adjacency(edges: DataFrame) -> DataFrame:
    """node, nbr, n, dir (out or in)."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "n", F.lit("out").alias("dir"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "n", F.lit("in").alias("dir")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, outdeg, indeg: numbers of different neighbours."""
    a = adjacency(edges)
    return a.groupBy("node").agg(F.count_if(F.col("dir") == "out").alias("outdeg"), F.count_if(F.col("dir") == "in").alias("indeg"))


def neighbour_ratio(edges: DataFrame, measure: DataFrame, side: str) -> DataFrame:
    """Sum of the measure of the in (out) neighbours by the sum of their out (in) degrees; degrees are taken once for each node."""
    near = adjacency(edges).filter(F.col("dir") == side).select("node", "nbr")
    deg = degrees(edges).select(F.col("node").alias("nbr"), F.col("outdeg" if side == "in" else "indeg").alias("deg"))
    m = measure.select(F.col("node").alias("nbr"), "x")
    got = near.join(deg, "nbr").join(m, "nbr", "left")
    return got.groupBy("node").agg(ratio(F.sum(F.coalesce("x", F.lit(0.0))), F.sum("deg").cast("double")).alias("value"))


def two_hop(edges: DataFrame, measure: DataFrame, side: str, hop: str) -> DataFrame:
    """Over the hop-side links of a node's side neighbours: sum of the measure by the sum of link counts. The second hop is summed for each
    neighbour first, so that the join has a row for each edge and not for each path."""
    a = adjacency(edges)
    m = measure.select(F.col("node").alias("nbr"), "x")
    per = a.filter(F.col("dir") == hop).join(m, "nbr", "left").groupBy("node").agg(F.sum(F.coalesce("x", F.lit(0.0))).alias("sx"), F.sum("n").alias("sn"))
    near = a.filter(F.col("dir") == side).select("node", "nbr")
    got = near.join(per.select(F.col("node").alias("nbr"), "sx", "sn"), "nbr")
    return got.groupBy("node").agg(ratio(F.sum("sx"), F.sum("sn").cast("double")).alias("value"))


def all_features(edges: DataFrame, measure: DataFrame) -> DataFrame:
    """node, feature, value: degrees and the six neighbour features of the measure."""
    d = degrees(edges)
    out = d.select("node", F.lit("degree").alias("feature"), ratio(F.col("outdeg").cast("double"), F.col("indeg").cast("double")).alias("value"))
    for side in ("in", "out"):
        out = out.unionByName(neighbour_ratio(edges, measure, side).withColumn("feature", F.lit(f"near_{side}")))
        for hop in ("in", "out"):
            out = out.unionByName(two_hop(edges, measure, side, hop).withColumn("feature", F.lit(f"far_{side}_{hop}")))
    return out


def both_ways(edges: DataFrame, score: DataFrame, penalty: float = 0.1) -> DataFrame:
    """src, dst, w: ln(1 + n) of a link and its reverse together, times the penalty where the source scores below the target."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("back"))
    s, d = score.select(F.col("node").alias("src"), F.col("x").alias("xs")), score.select(F.col("node").alias("dst"), F.col("x").alias("xd"))
    got = edges.join(back, ["src", "dst"], "left").join(s, "src", "left").join(d, "dst", "left")
    w = F.log1p("n") + F.log1p(F.coalesce("back", F.lit(0)))
    return got.select("src", "dst", F.when(F.coalesce("xs", F.lit(0.0)) < F.coalesce("xd", F.lit(0.0)), w * penalty).otherwise(w).alias("w"))
