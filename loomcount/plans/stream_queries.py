"""Streaming queries that run a stream over a table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount import streaming
from loomcount.operators import ngrams as ng
from loomcount.plans.registry import Tables, query
from loomcount.plans.state_queries import _BOTH, _period
from loomcount.sources.tables import new_path


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def daily_windows_stream(t: Tables) -> DataFrame:
    """In complete mode, so that open windows are there too"""
    spark = t._spark
    rows = t.events
    stream = spark.readStream.schema(rows.schema).parquet(f"{t._dir}/events.parquet*")
    name = f"daily_{uuid.uuid4().hex}"
    q = streaming.daily_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", new_path(spark, "daily-windows")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "cnt")


# Thirds of the span of time arrive one after another; every seventh event of the first third comes with the last.
_LO, _HI = "epoch_us(min(ts)::TIMESTAMP)", "epoch_us(max(ts)::TIMESTAMP)"
_ARRIVAL = f"""b AS (SELECT {_LO} AS lo, {_HI} AS hi FROM events), a AS (SELECT e.*, CASE WHEN third = 0 AND event_id % 7 = 0 THEN 2 ELSE third END AS stage FROM (SELECT events.*, (3 * (epoch_us(ts::TIMESTAMP) - lo)) // (hi - lo + 1) AS third FROM events, b WHERE ts IS NOT NULL) e),
    m AS (SELECT stage, max(ts) - INTERVAL 1 DAY AS reached FROM a GROUP BY stage), k AS (SELECT a.*, date_trunc('day', ts) AS day, (SELECT max(reached) FROM m WHERE m.stage < a.stage) AS mark FROM a),
    z AS (SELECT max(reached) AS last FROM m), f AS (SELECT *, mark IS NOT NULL AND day + INTERVAL 1 DAY <= mark AS late FROM k, z)"""


def _stages(t: Tables) -> list[DataFrame]:
    e = t.events.filter("ts IS NOT NULL")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = e.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    third = F.expr("(3 * (us - lo)) div (hi - lo + 1)")
    e = e.withColumn("us", us).crossJoin(F.broadcast(span)).withColumn("third", third)  # one row
    e = e.withColumn("stage", F.when((F.col("third") == 0) & (F.col("event_id") % 7 == 0), 2).otherwise(F.col("third")))
    return [e.filter(F.col("stage") == k).select(*t.events.columns) for k in range(3)]


def _arriving(t: Tables, plan, name: str) -> tuple[DataFrame, DataFrame]:
    """What the stream `plan` has appended after the three arrivals, and all rows that it was given. It stops after each and goes on from its checkpoint."""
    spark, at = t._spark, new_path(t._spark, name)
    for rows in _stages(t):
        rows.write.mode("append").parquet(f"{at}/in")
        out = plan(spark.readStream.schema(t.events.schema).parquet(f"{at}/in"))
        q = out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out"), spark.read.schema(t.events.schema).parquet(f"{at}/in")


@query(f"WITH {_ARRIVAL} SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) FILTER (NOT late) AS cnt, count(*) FILTER (late) AS late FROM f WHERE day + INTERVAL 1 DAY <= last GROUP BY ALL")
def daily_windows_closed(t: Tables) -> DataFrame:
    """Append mode over three arrivals with late rows: days beyond the watermark once each, and how many of their rows came too late"""
    closed, arrived = _arriving(t, lambda s: streaming.closed_counts(s, "ts", "event_type"), "daily-closed")
    out = streaming.with_late(closed, arrived, "ts", "event_type")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "cnt", "late")


@query(f"""WITH {_ARRIVAL}, d AS (SELECT user_id, day, count(*) AS cnt FROM f WHERE NOT late GROUP BY ALL HAVING count(*) >= 2), g AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS head FROM d),
    l AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY day) AS life FROM g)
    SELECT user_id, strftime(min(day), '%Y-%m-%d') AS born, strftime(max(day), '%Y-%m-%d') AS died, count(*) AS days, max(cnt) AS peak FROM l, z GROUP BY user_id, life, last HAVING max(day) + INTERVAL 3 DAY <= last + INTERVAL 1 MICROSECOND""")
def item_lives_stream(t: Tables) -> DataFrame:
    """Users over daily periods: a life goes on while days with two events or more are at most two days apart; lives that are over are given out"""
    out, _ = _arriving(t, lambda s: streaming.lives(s, "ts", "user_id", least=2, gap="2 days"), "lives")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("user_id", day("born"), day("died"), "days", "peak")


@query(f"WITH {_BOTH}, s3 AS (SELECT * FROM s WHERE cnt >= 3), {_period('s3')}")
def trie_period_stream(t: Tables) -> DataFrame:
    """Documents with even ids arrive first, those with odd ids as the next period, to a stream that goes on from its checkpoint"""
    spark, docs, at = t._spark, t.documents, new_path(t._spark, "periods")
    for rest in (0, 1):
        docs.filter(F.col("doc_id") % 2 == rest).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{at}/in")
        writer = streaming.period_updates(stream, lambda batch: ng.counts(batch, [1, 2]), f"{at}/state", f"{at}/checkpoint", 3)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/state/1").select("gram", "ord", "cnt", "hit")


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words, length(coalesce(text, ''))::BIGINT AS signs FROM documents")
def per_document_function(t: Tables) -> DataFrame:
    """A Python function of each document, called with Arrow batches"""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def measured(batch):
        texts = batch["text"].fillna("")
        return batch[["doc_id"]].assign(words=texts.map(lambda x: len(word.findall(x))).astype("int64"), signs=texts.str.len().astype("int64"))

    return streaming.per_document(t.documents.select("doc_id", "text"), measured, "doc_id long, words long, signs long")
