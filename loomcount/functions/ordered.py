"""Running sums and places in a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, key: str, sums: dict[str, Column], descending: bool = False, then: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each name, the sum over the rows before this one in the order of the key (then of the columns `then`), in each group `by`.

    Rows are cut into ranges of about equal numbers, by a sample of groups, keys and `then` together, and written once, so that both uses see the same
    ranges; sums of the ranges run in a window of at most a row for each range a group, rows only inside their range. Null keys come last."""
    from loomcount.sources.tables import written

    order = [F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), *[F.asc(c) for c in then]]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = df.withColumns({f"_v_{n}": c for n, c in sums.items()}).repartitionByRange(ranges, *by, *order)
    met = written(met.withColumn("_part", F.spark_partition_id()), "ranges")
    total = met.groupBy(*by, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    over = W.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    total = total.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_at_{n}") for n in sums])
    inner = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    met = met.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)) for n in sums})
    out = met.join(total, [met[c].eqNullSafe(total[f"_by_{c}"]) for c in by] + [F.col("_part") == F.col("_p")])
    return out.withColumns({n: F.col(f"_at_{n}") + F.col(f"_in_{n}") for n in sums}).drop("_part", "_p", *[f"_by_{c}" for c in by], *[f"_{k}_{n}" for k in ("v", "at", "in") for n in sums])


def numbered(df: DataFrame, key: str, name: str, descending: bool = False, then: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """df with its place (from 1) in the order."""
    return running(df, key, {name: F.lit(1)}, descending, then, by).withColumn(name, (F.col(name) + 1).cast("bigint"))


def bracketed(df: DataFrame, key: str, known: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `before` and `after`: the last non-null value of `known` at or before the row, and the first at or after it, in the order of the key in each group `by`.

    Rows are cut into ranges by a sample and written once, as in `running`; inside a range they look at the range only, and what lies beyond it is carried from range to range, a row for
    each range of a group. So no group is sorted in one task."""
    from loomcount.sources.tables import written

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = df.withColumn("_v", known).repartitionByRange(ranges, *by, key)
    met = written(met.withColumn("_part", F.spark_partition_id()), "ranges")
    some = met.filter("_v IS NOT NULL").groupBy(*by, "_part").agg(F.max_by("_v", key).alias("_last"), F.min_by("_v", key).alias("_first"))
    parts = met.select(*by, "_part").distinct()
    parts = parts.join(some, [parts[c].eqNullSafe(some[c]) for c in by] + [parts["_part"] == some["_part"]], "left").select(*[parts[c].alias(f"_by_{c}") for c in by], parts["_part"].alias("_p"), "_last", "_first")
    over = W.partitionBy(*[F.col(f"_by_{c}") for c in by] or [F.lit(0)]).orderBy("_p")
    parts = parts.withColumn("_last", F.last("_last", True).over(over.rowsBetween(W.unboundedPreceding, -1))).withColumn("_first", F.first("_first", True).over(over.rowsBetween(1, W.unboundedFollowing)))
    inner = W.partitionBy(*by, "_part").orderBy(key)
    met = met.withColumn("_in_last", F.last("_v", True).over(inner.rowsBetween(W.unboundedPreceding, 0))).withColumn("_in_first", F.first("_v", True).over(inner.rowsBetween(0, W.unboundedFollowing)))
    out = met.join(parts, [met[c].eqNullSafe(parts[f"_by_{c}"]) for c in by] + [F.col("_part") == F.col("_p")])
    out = out.withColumn("before", F.coalesce("_in_last", "_last")).withColumn("after", F.coalesce("_in_first", "_first"))
    return out.drop("_v", "_part", "_p", "_last", "_first", "_in_last", "_in_first", *[f"_by_{c}" for c in by])
