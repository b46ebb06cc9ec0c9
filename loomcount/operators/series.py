"""Time series as long tables (stream, epoch, value): features, labels, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def over(stream: str = "stream", epoch: str = "epoch"):
    return W.partitionBy(stream).orderBy(epoch)


def lag_diff(x: Column, k: int, w) -> Column:
    """x minus its value k epochs ago; 0 at the head."""
    return F.coalesce(x - F.lag(x, k).over(w), F.lit(0.0))


def band(x: Column, w) -> Column:
    """1 where x rose, else 0."""
    return F.when(x > F.lag(x, 1).over(w), 1).otherwise(0)


def sma(x: Column, n: int, w) -> Column:
    """Mean of the last n values; 0 until there are n."""
    return F.when(F.row_number().over(w) >= n, F.avg(x).over(w.rowsBetween(-(n - 1), 0))).otherwise(0.0)


def z_score(x: Column, group) -> Column:
    return F.try_divide(x - F.avg(x).over(group), F.stddev_samp(x).over(group))


def unit(x: Column, group) -> Column:
    """(x - min) / max: the divisor is the maximum, not the range."""
    return F.try_divide(x - F.min(x).over(group), F.max(x).over(group))


def six_bins(x: Column) -> Column:
    """0 to 5, cut at -0.2, -0.1, 0, 0.1 and 0.2."""
    out = F.lit(0)
    for c in (-0.2, -0.1, 0.0, 0.1, 0.2):
        out = out + F.when(x > c, 1).otherwise(0)
    return out


def delayed_labels(df: DataFrame, label: str, d: int) -> DataFrame:
    """Each epoch with the label d epochs on; epochs without one go."""
    return df.withColumn("_l", F.lead(label, d).over(over())).filter("_l IS NOT NULL").withColumn(label, F.col("_l")).drop("_l")


def balanced(df: DataFrame, label: str, key: Column, seed: str) -> DataFrame:
    """The classes cut to the size of the smallest, by a seeded hash of the key. Ranks are taken in ranges of the hash, not over a whole class."""
    rows = df.withColumn("_h", F.md5(F.concat(F.lit(seed), key.cast("string")))).withColumn("_r", F.substring("_h", 1, 3))
    sums = rows.groupBy(label, "_r").agg(F.count(F.lit(1)).alias("_n"))
    upto = sums.select(label, "_r", (F.sum("_n").over(W.partitionBy(label).orderBy("_r")) - F.col("_n")).alias("_before"))
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_least"))
    placed = rows.join(upto, [label, "_r"]).withColumn("_k", F.row_number().over(W.partitionBy(label, "_r").orderBy("_h")) + F.col("_before"))
    return placed.crossJoin(F.broadcast(least)).filter("_k <= _least").drop("_h", "_r", "_before", "_k", "_least")  # one row


def last_epochs(df: DataFrame, t: int) -> DataFrame:
    """df with is_test: among the last t epochs of its stream."""
    return df.withColumn("is_test", F.row_number().over(W.partitionBy("stream").orderBy(F.desc("epoch"))) <= t)


def folds(epochs: DataFrame, size: int) -> DataFrame:
    """fold, epoch, is_test: consecutive test blocks of `size` epochs (from 1), the last one moved back to fit."""
    n = epochs.agg(F.max("epoch").alias("n"))
    starts = n.select("n", F.explode(F.expr(f"sequence(0, cast(ceil(n / {float(size)}) as int) - 1)")).alias("fold"))
    starts = starts.select("fold", F.least(F.col("fold") * size + 1, F.col("n") - size + 1).alias("a"))
    return epochs.crossJoin(F.broadcast(starts)).select("fold", "epoch", F.col("epoch").between(F.col("a"), F.col("a") + size - 1).alias("is_test"))  # a row for each fold: the result has a row for each fold and epoch
