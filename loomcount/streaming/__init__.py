"""Structured Streaming forms of the stream operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount.operators import lmstate
from loomcount.sources.tables import written


def daily_counts(stream: DataFrame, ts: str, *by: str, lateness: str = "1 day") -> DataFrame:
    """Counts in tumbling windows of a day behind a watermark; naive timestamps are taken as UTC."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return rows.groupBy(F.window(ts, "1 day").alias("w"), *by).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("day"), *by, "cnt")


def closed_counts(stream: DataFrame, ts: str, *by: str, lateness: str = "1 day") -> DataFrame:
    """For append mode: `daily_counts` of days that are closed, each once: those that end at or before the watermark, which is the largest time of earlier batches less the
    lateness. A row of a day that was closed before its batch is late and not counted; see `with_late`. Rows without a time are left out."""
    return daily_counts(stream.filter(F.col(ts).isNotNull()), ts, *by, lateness=lateness)


def with_late(closed: DataFrame, arrived: DataFrame, ts: str, *by: str) -> DataFrame:
    """The side output of `closed_counts`: day, by..., cnt, late for each closed day, where late are the rows of `arrived` (all that the stream was given) that came too late to be counted.
    A day counts as closed if it is in `closed`, or ends before one that is: groups whose rows are all late have cnt 0."""
    rows = arrived.filter(F.col(ts).isNotNull()).groupBy(F.window(F.col(ts).cast("timestamp"), "1 day")["start"].alias("day"), *by).agg(F.count(F.lit(1)).alias("_all"))
    last = closed.agg(F.max("day").alias("_last"))
    met = rows.join(closed, [rows[c].eqNullSafe(closed[c]) for c in ("day", *by)], "left").select(*[rows[c] for c in ("day", *by)], F.coalesce(closed["cnt"], F.lit(0)).alias("cnt"), "_all")
    return met.crossJoin(F.broadcast(last)).filter(F.col("day") <= F.col("_last")).select("day", *by, "cnt", (F.col("_all") - F.col("cnt")).alias("late"))  # one row


def lives(stream: DataFrame, ts: str, *by: str, least: int, gap: str, lateness: str = "1 day") -> DataFrame:
    """For append mode: by..., born, died, days, peak of items over daily periods (X02). An item is supported in a day with `least` rows or more; it lives from a supported day on as long as
    the next one is at most `gap` later, and is given out once, when the watermark is a day and `gap` beyond its last. Rows of a day that was closed before their batch are not counted. State is kept for each item and open life by Spark's state store
    and dropped by its event-time timers, so a batch touches only the items that it names. days: supported days; peak: most rows in a day."""
    daily = stream.filter(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    daily = daily.groupBy(F.window(ts, "1 day"), *by).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= least)
    at = F.window_time("window")  # the last microsecond of the day
    life = daily.withColumn("at", at).groupBy(F.session_window("at", gap).alias("life"), *by).agg(F.min("at").alias("born"), F.max("at").alias("died"), F.count(F.lit(1)).alias("days"), F.max("cnt").alias("peak"))
    return life.select(*by, F.date_trunc("day", "born").alias("born"), F.date_trunc("day", "died").alias("died"), "days", "peak")


def period_updates(stream: DataFrame, count: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, least: int = 2):
    """A writer that merges each micro-batch into the state table under `path` (a folder for each batch, the newest is the state). A batch that comes again overwrites
    its own folder, so a restart repeats nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        counts = written(count(batch), "batch")  # used several times
        if epoch == 0:
            state = lmstate.supported(counts, least, "gram", "ord").withColumn("hit", F.lit(True)).select("gram", "ord", "cnt", "hit")
        else:
            state = lmstate.period(spark.read.parquet(f"{path}/{epoch - 1}"), counts, least)
        state.write.mode("overwrite").parquet(f"{path}/{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def per_document(docs: DataFrame, f: Callable, schema: str) -> DataFrame:
    """A function of a pandas frame for each batch of documents."""
    return docs.mapInPandas(lambda batches: (f(b) for b in batches), schema)
