"""Readers and writers for the line formats of the engine (S01-S30). Compression follows from the file name; bad lines are dropped where it says so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _cells(c: str = "value"):
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """value, path, period (the number after a word such as stream or week in the file's name; null without one). Plain, .gz and .bz2."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    got = reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^[A-Za-z]+?(\d+)", 1)
    return got.withColumn("period", F.when(number != "", number.cast("bigint")))


def write_lines(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """One string column as compressed text."""
    df.write.option("compression", compression).text(path)


def ngram_counts(spark: SparkSession, path: str) -> DataFrame:
    """gram, ord, cnt from lines `gram TAB count`; malformed lines are dropped."""
    v = F.split("value", "\t")
    got = spark.read.text(path).select(F.trim(F.get(v, F.lit(0))).alias("gram"), F.get(v, F.lit(1)).try_cast("bigint").alias("cnt"), F.size(v).alias("_n"))
    return got.filter("_n = 2 AND cnt IS NOT NULL AND gram <> ''").select("gram", F.size(F.split("gram", " +")).cast("bigint").alias("ord"), "cnt")


def write_counts(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "gram", F.col("cnt").cast("string")).alias("value")).write.text(path)


def series_matrix(rows: DataFrame, skip: int = 0, column: int | None = None) -> DataFrame:
    """epoch (from 1, after `skip` header rows), stream, part, value of rows (line: number from 0, value: text): cells are separated by white space, a cell may pack
    parts with slashes (S08). -1 stays a value."""
    r = rows.filter(F.col("line") >= skip).select((F.col("line") - skip + 1).alias("epoch"), F.posexplode(_cells()).alias("stream", "cell"))
    r = r if column is None else r.filter(F.col("stream") == column)
    return r.select("epoch", "stream", F.posexplode(F.split("cell", "/")).alias("part", "value")).withColumn("value", F.col("value").try_cast("double"))


def gold_column(rows: DataFrame, index: int = -1, part: int | None = None) -> DataFrame:
    """line, value: the last (or an indexed) cell of each line, or one part of it."""
    cells = _cells()
    cell = F.element_at(cells, -1) if index < 0 else F.get(cells, F.lit(index))
    return rows.select("line", (cell if part is None else F.get(F.split(cell, "/"), F.lit(part))).try_cast("double").alias("value"))


def weak_outputs(spark: SparkSession, path: str, classes: int) -> DataFrame:
    """source, epoch, k, p, hard, gold from lines `source epoch p0 .. hard gold`."""
    v = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    at = lambda k, kind: F.get(v, F.lit(k)).try_cast(kind)
    got = spark.read.text(path).filter(F.size(v) >= classes + 4).select(at(0, "int").alias("source"), at(1, "int").alias("epoch"), at(classes + 2, "int").alias("hard"), at(classes + 3, "int").alias("gold"), F.posexplode(F.transform(F.slice(v, 3, classes), lambda x: x.try_cast("double"))).alias("k", "p"))
    return got.select("source", "epoch", "k", "p", "hard", "gold")


def write_weak_outputs(df: DataFrame, path: str) -> None:
    one = df.groupBy("source", "epoch").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("ps"), F.first("hard").alias("hard"), F.first("gold").alias("gold"))
    ps = F.array_join(F.transform("ps", lambda x: x["p"].cast("string")), "\t")
    one.select(F.concat_ws("\t", F.col("source").cast("string"), F.col("epoch").cast("string"), ps, F.col("hard").cast("string"), F.col("gold").cast("string")).alias("value")).write.text(path)


def sentence_features(spark: SparkSession, path: str) -> DataFrame:
    """doc (file), label, p_pos, p_neg, p_neu, conf."""
    v = F.filter(F.split("value", r"[\s,]+"), lambda x: x != "")
    names = ("p_pos", "p_neg", "p_neu", "conf")
    return spark.read.text(path).filter(F.size(v) == 5).select(F.col("_metadata.file_name").alias("doc"), F.get(v, F.lit(0)).try_cast("int").alias("label"), *[F.get(v, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(names)])


def feature_csv(spark: SparkSession, path: str, ids: DataFrame, width: int) -> DataFrame:
    """id, f array of `width` numbers for every id of ids; lines that start with # are comments, missing ids are zero."""
    v = F.split("value", ",")
    got = spark.read.text(path).filter(~F.startswith("value", F.lit("#"))).select(F.get(v, F.lit(0)).try_cast("bigint").alias("id"), F.transform(F.slice(v, 2, width), lambda x: x.try_cast("double")).alias("f"))
    return ids.join(got, "id", "left").select("id", F.coalesce("f", F.array_repeat(F.lit(0.0), width)).alias("f"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """id, label (spam 1, nonspam -1) of lines `id label`; undecided ones are dropped."""
    v = _cells()
    got = spark.read.text(path).select(F.get(v, F.lit(0)).try_cast("bigint").alias("id"), F.get(v, F.lit(1)).alias("name"))
    return got.filter("name IN ('spam', 'nonspam') AND id IS NOT NULL").select("id", F.when(F.col("name") == "spam", 1).otherwise(-1).alias("label"))


def host_graph(rows: DataFrame) -> DataFrame:
    """src, dst, n of rows (line: the source, value: `dst:count ...`)."""
    e = rows.select(F.col("line").alias("src"), F.explode(_cells()).alias("e")).filter("e LIKE '%:%'")
    return e.select("src", F.split_part("e", F.lit(":"), F.lit(1)).cast("bigint").alias("dst"), F.split_part("e", F.lit(":"), F.lit(2)).cast("bigint").alias("n"))


def warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """url, html: records start at `warc/0.9`, the page at its first `<html`."""
    got = spark.read.option("lineSep", "warc/0.9").text(path).filter("trim(value) <> ''")
    return got.select(F.regexp_extract("value", r"(?i)(https?://\S+)", 1).alias("url"), F.regexp_extract("value", r"(?is)(<html.*)$", 1).alias("html")).filter("html <> ''")


def write_by_host(pages: DataFrame, path: str) -> None:
    """A folder for each host."""
    pages.withColumn("host", F.regexp_extract("url", r"^(?:[a-z]+://)?([^/?#]*)", 1)).write.partitionBy("host").parquet(path)


def page_dump(rows: DataFrame, separator: str) -> DataFrame:
    """page, text: lines between separator lines, put together in order."""
    from loomcount.functions.ordered import running

    r = running(rows, "line", {"page": (F.col("value") == separator).cast("int")}).filter(F.col("value") != separator)
    return r.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text"))


def news(spark: SparkSession, path: str, row: str = "newsitem") -> DataFrame:
    """date, headline, text of news items in XML."""
    schema = "_date string, headline string, text struct<p: array<string>>"
    got = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    return got.select(F.col("_date").alias("date"), "headline", F.array_join("text.p", "\n").alias("text"))


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content of every document in zip archives; an archive is one row of a binary scan."""

    def unpack(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    for n in z.namelist():
                        yield pd.DataFrame({"path": [p], "name": [n], "content": [z.read(n).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, name string, content string")


def articles(rows: DataFrame, remap: dict[str, str], known: list[str]) -> DataFrame:
    """rows (line, value): articles end at a line that starts with AN; the code after it is mapped to its prime source, others to OT."""
    from loomcount.functions.ordered import running

    r = running(rows, "line", {"article": F.startswith("value", F.lit("AN")).cast("int")})
    a = r.groupBy("article").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"))
    last = F.element_at("l", -1)["value"]
    code = F.regexp_extract(last, r"^AN\s+(\S+)", 1)
    for k, v in remap.items():
        code = F.when(code == k, v).otherwise(code)
    code = F.when(code.isin(known), code).otherwise("OT")
    return a.filter(F.startswith(last, F.lit("AN"))).select("article", code.alias("source"), F.array_join(F.transform(F.slice("l", 1, F.size("l") - 1), lambda x: x["value"]), "\n").alias("text"))


def parallel(src: DataFrame, trg: DataFrame, most: int) -> DataFrame:
    """sid, src, trg words of two line tables (line, value) with at most `most` words on either side."""
    w = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    met = src.select(F.col("line").alias("sid"), w("value").alias("src")).join(trg.select(F.col("line").alias("sid"), w("value").alias("trg")), "sid")
    return met.filter(F.size("src").between(1, most) & F.size("trg").between(1, most))


def translation_table(spark: SparkSession, path: str) -> DataFrame:
    """s, t, lp of lines `s t idx p`."""
    v = _cells()
    return spark.read.text(path).filter(F.size(v) == 4).select(F.get(v, F.lit(0)).alias("s"), F.get(v, F.lit(1)).alias("t"), F.log(F.nullif(F.get(v, F.lit(3)).try_cast("double"), F.lit(0.0))).alias("lp"))


def alignments(rows: DataFrame) -> DataFrame:
    """sid, i, j of rows (line, value: `i-j i-j`)."""
    e = rows.select(F.col("line").alias("sid"), F.explode(_cells()).alias("e")).filter("e LIKE '%-%'")
    return e.select("sid", F.split_part("e", F.lit("-"), F.lit(1)).cast("int").alias("i"), F.split_part("e", F.lit("-"), F.lit(2)).cast("int").alias("j"))


def alignment_lines(links: DataFrame) -> DataFrame:
    return links.groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j"))), lambda x: F.concat_ws("-", x["i"].cast("string"), x["j"].cast("string"))), " ").alias("value"))


def grammar(spark: SparkSession, path: str) -> DataFrame:
    """nt, s, t, n of lines `NT --> < s ||| t > count`."""
    part = lambda k: F.regexp_extract("value", r"^(\S+) --> < (.*?) \|\|\| (.*?) >\s*(\d+)?", k)
    return spark.read.text(path).filter(part(1) != "").select(part(1).alias("nt"), F.split(part(2), " +").alias("s"), F.split(part(3), " +").alias("t"), part(4).try_cast("bigint").alias("n"))


def grammar_lines(rules: DataFrame) -> DataFrame:
    return rules.select(F.concat("nt", F.lit(" --> < "), F.array_join("s", " "), F.lit(" ||| "), F.array_join("t", " "), F.lit(" > "), F.col("n").cast("string")).alias("value"))


def word_classes(spark: SparkSession, path: str) -> DataFrame:
    """word, class of lines `word class`."""
    v = _cells()
    return spark.read.text(path).filter(F.size(v) == 2).select(F.get(v, F.lit(0)).alias("word"), F.get(v, F.lit(1)).alias("class"))


def save(model: DataFrame, path: str) -> None:
    """Any model, vocabulary or derivation table as Parquet."""
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metric_pairs(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """y, p (and block) of lines `[block] target prediction`."""
    v = _cells()
    k = int(blocks)
    cols = [F.get(v, F.lit(0)).try_cast("bigint").alias("block")] * blocks + [F.get(v, F.lit(k)).try_cast("double").alias("y"), F.get(v, F.lit(k + 1)).try_cast("double").alias("p")]
    return spark.read.text(path).filter(F.size(v) == 2 + k).select(*cols)
