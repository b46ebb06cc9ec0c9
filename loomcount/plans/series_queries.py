"""Series queries: streams are event types, epochs their calendar days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.functions.ordered import numbered, running
from loomcount.operators import series as se
from loomcount.plans.registry import Tables, big, query, r6

_D = "d AS (SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY day) AS epoch, value FROM (SELECT event_type, date_trunc('day', ts) AS day, avg(value) / 100 AS value FROM events GROUP BY ALL))"
_W = "WINDOW w AS (PARTITION BY stream ORDER BY epoch)"


def daily(t: Tables) -> DataFrame:
    d = t.events.groupBy(F.col("event_type").alias("stream"), F.date_trunc("day", "ts").alias("day")).agg((F.avg("value") / 100).alias("value"))
    return d.select("stream", F.row_number().over(W.partitionBy("stream").orderBy("day")).cast("bigint").alias("epoch"), "value")


@query(f"WITH {_D} SELECT stream, epoch, round(coalesce(value - lag(value, 1) OVER w, 0), 6) AS d1, round(coalesce(value - lag(value, 3) OVER w, 0), 6) AS d3 FROM d {_W}")
def lag_diff(t: Tables) -> DataFrame:
    """W01"""
    w = se.over()
    return daily(t).select("stream", "epoch", r6(se.lag_diff(F.col("value"), 1, w), "d1"), r6(se.lag_diff(F.col("value"), 3, w), "d3"))


@query(f"WITH {_D}, a AS (SELECT stream, epoch, coalesce(value - lag(value, 1) OVER w, 0) AS x FROM d {_W}) SELECT stream, epoch, round(coalesce(x - lag(x, 1) OVER w, 0), 6) AS d FROM a {_W}")
def lag_diff_level2(t: Tables) -> DataFrame:
    """W01, second level"""
    w = se.over()
    one = daily(t).withColumn("x", se.lag_diff(F.col("value"), 1, w))
    return one.select("stream", "epoch", r6(se.lag_diff(F.col("x"), 1, w), "d"))


@query(f"WITH {_D}, a AS (SELECT stream, epoch, value - lag(value, 2) OVER w AS x FROM d {_W}) SELECT stream, epoch, round(x, 6) AS d FROM a WHERE epoch > 2")
def lag_diff_headless(t: Tables) -> DataFrame:
    """W02"""
    return daily(t).withColumn("d", se.lag_diff(F.col("value"), 2, se.over())).filter("epoch > 2").select("stream", "epoch", r6("d", "d"))


@query(f"WITH {_D} SELECT stream, epoch, CASE WHEN value > lag(value) OVER w THEN 1 ELSE 0 END::BIGINT AS band FROM d {_W}")
def binary_band(t: Tables) -> DataFrame:
    """W03"""
    return daily(t).select("stream", "epoch", big(se.band(F.col("value"), se.over()), "band"))


@query(f"WITH {_D} SELECT stream, epoch, round(CASE WHEN epoch >= 3 THEN avg(value) OVER (PARTITION BY stream ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END, 6) AS sma FROM d")
def sma3_zero_head(t: Tables) -> DataFrame:
    """W04"""
    return daily(t).select("stream", "epoch", r6(se.sma(F.col("value"), 3, se.over()), "sma"))


@query(f"WITH {_D} SELECT stream, epoch, round((value - avg(value) OVER g) / stddev_samp(value) OVER g, 6) AS z, round((value - min(value) OVER g) / max(value) OVER g, 6) AS u FROM d WINDOW g AS (PARTITION BY stream)")
def zscore_minmax(t: Tables) -> DataFrame:
    """W05, W06"""
    g = W.partitionBy("stream")
    return daily(t).select("stream", "epoch", r6(se.z_score(F.col("value"), g), "z"), r6(se.unit(F.col("value"), g), "u"))


@query(f"""WITH {_D}, a AS (SELECT *, CASE WHEN value > lag(value) OVER w THEN 1 ELSE 0 END AS band, coalesce(value - lag(value) OVER w, 0) AS diff FROM d {_W})
    SELECT stream, epoch, band::BIGINT AS band, round(diff, 6) AS diff, round(CASE WHEN epoch >= 3 THEN avg(diff) OVER (PARTITION BY stream ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END, 6) AS smooth FROM a""")
def extra_features(t: Tables) -> DataFrame:
    """W07"""
    w, x = se.over(), F.col("value")
    a = daily(t).withColumn("band", se.band(x, w)).withColumn("diff", se.lag_diff(x, 1, w))
    return a.select("stream", "epoch", big("band", "band"), r6("diff", "diff"), r6(se.sma(F.col("diff"), 3, w), "smooth"))


_CHANGE = "a AS (SELECT stream, epoch, coalesce(value - lag(value) OVER w, 0) AS x FROM d WINDOW w AS (PARTITION BY stream ORDER BY epoch))"
_BIN = "((x > -0.2)::INT + (x > -0.1)::INT + (x > 0)::INT + (x > 0.1)::INT + (x > 0.2)::INT)::BIGINT"


def changes(t: Tables) -> DataFrame:
    return daily(t).select("stream", "epoch", se.lag_diff(F.col("value"), 1, se.over()).alias("x")).withColumn("label", se.six_bins(F.col("x")).cast("bigint"))


@query(f"WITH {_D}, {_CHANGE}, b AS (SELECT stream, epoch, {_BIN} AS label FROM a), l AS (SELECT stream, epoch, lead(label, 2) OVER w AS label, count(*) OVER (PARTITION BY stream) AS n FROM b {_W}) SELECT stream, epoch, label, epoch > n - 2 - 5 AS is_test FROM l WHERE label IS NOT NULL")
def label_delay_split(t: Tables) -> DataFrame:
    """W08, W12, S09"""
    return se.last_epochs(se.delayed_labels(changes(t).drop("x"), "label", 2), 5).select("stream", "epoch", "label", "is_test")


@query(f"WITH {_D}, {_CHANGE} SELECT stream, {_BIN} AS label, count(*) AS n FROM a GROUP BY ALL")
def bin6(t: Tables) -> DataFrame:
    """W09"""
    return changes(t).groupBy("stream", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('5:' || doc_id)) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality FROM r WHERE k <= (SELECT min(n) FROM r)""")
def balanced_subsample(t: Tables) -> DataFrame:
    """W10"""
    return se.balanced(t.labels, "quality", F.col("doc_id"), "5:").select("doc_id", "quality")


@query("SELECT l_orderkey, l_linenumber, round((rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) - 1) / count(*) OVER (PARTITION BY l_linenumber), 6) AS r FROM lineitem")
def rank_normalise(t: Tables) -> DataFrame:
    """Share of strictly smaller values of the feature; equal values are one row while sums run"""
    l = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("v"))  # noqa: E741
    g = l.groupBy("l_linenumber", "v").agg(F.count(F.lit(1)).alias("c"))
    below = running(g, "v", {"less": F.col("c")}, by=("l_linenumber",)).select("l_linenumber", "v", "less")
    n = l.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return l.join(below, ["l_linenumber", "v"]).join(n, "l_linenumber").select("l_orderkey", "l_linenumber", r6(F.col("less") / F.col("n"), "r"))


@query(f"WITH {_D}, e AS (SELECT DISTINCT epoch FROM d), n AS (SELECT max(epoch) AS n FROM e), f AS (SELECT k AS fold, least(k * 7 + 1, n - 6) AS a FROM n, LATERAL (SELECT unnest(range(0, ceil(n / 7)::BIGINT)) AS k)) SELECT fold::BIGINT AS fold, epoch, epoch BETWEEN a AND a + 6 AS is_test FROM e, f")
def interval_cv(t: Tables) -> DataFrame:
    """W13"""
    return se.folds(daily(t).select("epoch").distinct(), 7).select(big("fold", "fold"), "epoch", "is_test")


@query(f"WITH {_D} SELECT stream, epoch, row_number() OVER (PARTITION BY stream ORDER BY epoch BETWEEN 8 AND 14, epoch) AS place FROM d")
def rearranged_epochs(t: Tables) -> DataFrame:
    """Test epochs at the end"""
    return daily(t).select("stream", "epoch", F.row_number().over(W.partitionBy("stream").orderBy(F.col("epoch").between(8, 14), "epoch")).cast("bigint").alias("place"))


_MASS = "m AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[aeiou]'))::DOUBLE / greatest(length(text), 1) AS pos, len(regexp_extract_all(text, '[stn]'))::DOUBLE / greatest(length(text), 1) AS neg FROM conversations)"


@query(f"WITH {_MASS} SELECT conv_id, turn, round(coalesce(pos - lag(pos) OVER w, 0), 6) AS dpos, round(coalesce(neg - lag(neg) OVER w, 0), 6) AS dneg, (turn % 3)::BIGINT AS epoch FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def mass_deltas(t: Tables) -> DataFrame:
    """W18, W19, M31"""
    share = lambda p: F.regexp_count("text", F.lit(p)).cast("double") / F.greatest(F.length("text"), F.lit(1))
    m, w = t.conversations.select("conv_id", "turn", share("[aeiou]").alias("pos"), share("[stn]").alias("neg")), W.partitionBy("conv_id").orderBy("turn")
    return m.select("conv_id", "turn", r6(se.lag_diff(F.col("pos"), 1, w), "dpos"), r6(se.lag_diff(F.col("neg"), 1, w), "dneg"), F.pmod("turn", F.lit(3)).cast("bigint").alias("epoch"))


@query(f"WITH {_D}, {_CHANGE}, b AS (SELECT stream, epoch, {_BIN} AS label FROM a) SELECT stream, count(*) FILTER (label = prev) AS hits, count(*) AS n FROM (SELECT stream, label, lag(label, 1, 0) OVER w AS prev FROM b {_W}) GROUP BY stream")
def previous_label_baseline(t: Tables) -> DataFrame:
    """W20"""
    b = changes(t).withColumn("prev", F.lag("label", 1, 0).over(se.over()))
    return b.groupBy("stream").agg(F.count_if(F.col("label") == F.col("prev")).alias("hits"), F.count(F.lit(1)).alias("n"))


_SENT = "s AS (SELECT event_id, event_type AS doc, CASE WHEN value > 60 THEN 1 WHEN value < 40 THEN -1 ELSE 0 END AS label FROM events)"


@query(f"WITH {_SENT} SELECT doc, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = -1) AS neg, count(*) FILTER (label = 0) AS neu, round(count(*) FILTER (label = -1) / count(*), 6) AS share FROM s GROUP BY doc")
def sentiment_tallies(t: Tables) -> DataFrame:
    """A10, S11"""
    s = t.events.select(F.col("event_type").alias("doc"), F.when(F.col("value") > 60, 1).when(F.col("value") < 40, -1).otherwise(0).alias("label"))
    n = lambda k: F.count_if(F.col("label") == k)
    return s.groupBy("doc").agg(n(1).alias("pos"), n(-1).alias("neg"), n(0).alias("neu"), r6(n(-1) / F.count(F.lit(1)), "share"))


@query("""WITH p AS (SELECT l.doc_id, d.source, l.quality = (d.n_chars > 400)::INT AS hit FROM labels l JOIN documents d USING (doc_id)), s AS (SELECT source, avg(hit::INT) AS acc FROM p GROUP BY source)
    SELECT source, round(acc, 6) AS acc, round((SELECT avg(acc) FROM s), 6) AS mean FROM s""")
def source_accuracy(t: Tables) -> DataFrame:
    """Accuracy of each source and its mean over the sources"""
    s = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id").groupBy("source").agg(F.avg((F.col("quality") == (F.col("n_chars") > 400).cast("int")).cast("int")).alias("acc"))
    return s.crossJoin(F.broadcast(s.agg(F.avg("acc").alias("mean")))).select("source", r6("acc", "acc"), r6("mean", "mean"))  # one row


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 1) AS good FROM labels GROUP BY split")
def class_counts_by_split(t: Tables) -> DataFrame:
    """A14, S14"""
    s = t.labels.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")).groupBy("split").pivot("quality", [0, 1]).count()
    return s.select("split", F.coalesce("0", F.lit(0)).alias("bad"), F.coalesce("1", F.lit(0)).alias("good"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS lower_, (list_sort(list(value)))[count(*) // 2 + 1] AS upper_ FROM events GROUP BY event_type")
def medians(t: Tables) -> DataFrame:
    """The element at floor(n / 2) from zero, and the lower median; the place is found by running counts, not by collecting a stream"""
    e = numbered(t.events.select("event_type", "value", "event_id"), "value", "k", then=("event_id",), by=("event_type",))
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    met = e.join(n, "event_type")
    return met.groupBy("event_type").agg(F.max(F.when(F.expr("k = (n + 1) div 2"), F.col("value"))).alias("lower_"), F.max(F.when(F.expr("k = n div 2 + 1"), F.col("value"))).alias("upper_"))


@query("""SELECT event_type, doc, max(CASE WHEN h = 0 THEN v END) AS f0, max(CASE WHEN h = 1 THEN v END) AS f1, max(CASE WHEN h = 2 THEN v END) AS f2, max(CASE WHEN h = 3 THEN v END) AS f3, max(label) AS label
    FROM (SELECT event_type, (event_id // 100)::BIGINT AS doc, hour(ts) // 6 AS h, round(sum(value), 4) AS v, max(user_id % 2)::BIGINT AS label FROM events GROUP BY ALL) GROUP BY ALL""")
def design_matrix(t: Tables) -> DataFrame:
    """Features as columns, the label last"""
    e = t.events.groupBy("event_type", F.expr("event_id div 100").alias("doc"), F.expr("hour(ts) div 6").alias("h")).agg(F.round(F.sum("value"), 4).alias("v"), F.max(F.col("user_id") % 2).alias("label"))
    m = e.groupBy("event_type", "doc").pivot("h", [0, 1, 2, 3]).agg(F.max("v").alias("v"), F.max("label").alias("l"))
    return m.select("event_type", "doc", *[F.col(f"{k}_v").alias(f"f{k}") for k in range(4)], F.greatest(*[F.col(f"{k}_l") for k in range(4)]).cast("bigint").alias("label"))


@query("SELECT event_id FROM events WHERE date_trunc('day', ts) IN (SELECT DISTINCT date_trunc('day', ts) FROM events WHERE event_type = 'purchase')")
def trading_dates(t: Tables) -> DataFrame:
    """Events on days of another set"""
    days = t.events.filter("event_type = 'purchase'").select(F.date_trunc("day", "ts").alias("day")).distinct()
    return t.events.withColumn("day", F.date_trunc("day", "ts")).join(days, "day", "left_semi").select("event_id")


@query("""WITH b AS (SELECT event_type, date_trunc('day', ts) AS day, arg_min(value, event_id) AS o, max(value) AS h, min(value) AS l, arg_max(value, event_id) AS c, count(*) AS volume FROM events GROUP BY ALL) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, o, h, l, c, volume FROM b""")
def ohlc_bars(t: Tables) -> DataFrame:
    """The schema of price bars"""
    b = t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return b.agg(F.min_by("value", "event_id").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "event_id").alias("c"), F.count(F.lit(1)).alias("volume"))
