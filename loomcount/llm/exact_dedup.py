"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

Texts are equal when identical after lower-casing A-Z only. A batch is reduced to one row per digest
before it meets the index, so that a group of copies of any size is combined on the map side. New digests are found by a sort-merge
anti-join in which the index side is read in its buckets, already partitioned, and are appended. The rows then take their answers from the index; those of a
digest with more than HOT rows meet it in salted parts (at most one such digest for each HOT rows).

The index is history: of equal texts in different batches the one that came first stays; inside a batch the largest doc_id stays. `ingest_all` deals a table in
batches of falling doc_id, so that the largest doc_id of all stays.

Defined results: a null text counts as empty, texts of any length are read whole; a null doc_id sorts below any other; of rows that share text and
doc_id exactly one stays; an empty batch gives an empty result and leaves the index unchanged; a batch that is ingested again under its name (after a crash,
say) gives the answers of its first time; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcount.llm.common import ascii_lower, drop_written, new_path, written

HOT = 65_536


class DigestIndex:
    """A table (digest, keep_id, batch) in `buckets` files a batch. Give name and path of an earlier index to go on with it."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or new_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if path and not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )

    def table(self) -> DataFrame | None:
        return self.spark.table(self.name) if self.spark.catalog.tableExists(self.name) else None

    def drop(self) -> None:
        """Deletes the index with its files."""
        if (index := self.table()) is not None:
            drop_written(index)
            self.spark.sql(f"DROP TABLE {self.name}")

    def _rows(self, docs: DataFrame) -> DataFrame:
        digest = F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)).alias("digest")
        return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest, F.monotonically_increasing_id().alias("uid")), "digest-rows")

    def new_digests(self, rows: DataFrame) -> DataFrame:
        """digest, keep_id of the digests of rows that the index lacks."""
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        index = self.table()
        return groups if index is None else groups.join(index.select("digest").hint("merge"), "digest", "left_anti")

    def _append(self, rows: DataFrame, batch: str) -> None:
        if (index := self.table()) is not None and not index.filter(F.col("batch") == batch).isEmpty():
            return  # appended before
        new = self.new_digests(rows).withColumn("batch", F.lit(batch))
        (
            new.repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        )

    def _answers(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        """doc_id, digest, keep_id, group_size (rows with this text among `rows`), kept of each of the rows, whose new digests stand under `batches`."""
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        found = groups.join(self.table().hint("merge"), "digest").withColumn("parts", F.ceil(F.col("group_size") / HOT).cast("int"))
        found = found.withColumn("kept_uid", F.when(F.col("batch").isin(batches), F.col("best.uid"))).select("digest", "group_size", "keep_id", "kept_uid", "parts")
        found = written(found, "digest-found")
        hot = found.filter("parts > 1").select("digest", "parts")  # at most a digest for each HOT rows
        salted = rows.join(hot, "digest", "left").withColumn("salt", F.coalesce(F.pmod("uid", "parts"), F.lit(0)).cast("int")).drop("parts")
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        kept = F.coalesce(F.col("uid") == F.col("kept_uid"), F.lit(False)).alias("kept")
        return salted.join(found, ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size", kept)

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds a batch; returns doc_id, digest, keep_id, group_size (rows of the batch with this text), kept for each of its rows."""
        rows, batch = self._rows(docs), batch or uuid.uuid4().hex
        self._append(rows, batch)
        return self._answers(rows, [batch])

    def ingest_all(self, docs: DataFrame, batches: int = 2) -> DataFrame:
        """The same for a table dealt in batches of about equal size, largest doc_ids first; group_size counts the whole table."""
        rows = self._rows(docs)
        cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
        cuts, names = sorted(set(cuts or []), reverse=True), []
        for k in range(len(cuts) + 1):
            part = F.lit(True)
            if k < len(cuts):
                part = F.col("doc_id") >= cuts[k]
            if k:
                below = F.col("doc_id") < cuts[k - 1]
                part = part & (below if k < len(cuts) else below | F.col("doc_id").isNull())
            names.append(uuid.uuid4().hex)
            self._append(rows.filter(part), names[-1])
        return self._answers(rows, names)
