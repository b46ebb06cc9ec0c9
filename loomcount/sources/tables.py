"""Intermediate tables in the shared folder, and small tables dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path under spark.checkpoint.dir, or under a temporary folder where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="loomcount-")
        at = _own[app]
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as Parquet in the shared folder; cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to tasks where it is so small that Spark makes fewer tasks than there are cores: below spark.sql.files.openCostInBytes (4 MB) a core, by
    the plan's statistics. For small rows that become many (n-grams, word pairs). Larger tables stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if size < least * cores else df


#: Bytes of files for a task whose rows become many: their counts stay in memory (about 2 million n-grams in 4 MB).
DEALT = 4 << 20


#: Rows that are made in a task and counted there: their counts stay in memory.
MADE = 2_000_000


def multiplied(df: DataFrame, rows: Column, *by: str) -> DataFrame:
    """df dealt evenly, or by columns, to tasks that make about 2 million rows each, when `rows` rows are made of one; two for each core at least. One pass counts them."""
    total = df.agg(F.sum(rows.cast("bigint"))).first()[0] or 0
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, min(total // MADE, 100_000))
    return df.repartition(tasks, *by)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt evenly, or by columns, to tasks of about 4 MB of the files that it reads, two for each core at least, before its rows are exploded and counted: a scan's tasks are
    so large that the counts of one would be sorted on disk. Rows of unknown size keep their tasks."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size >= int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(2**63 - 1))):  # Spark doesn't know: rows that come from an RDD
        return df.repartition(*by) if by else df
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, min(size // DEALT, 100_000))
    return df.repartition(tasks, *by)
