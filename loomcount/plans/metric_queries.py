"""Metric queries over a score made from the labels table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount.operators import metrics as me
from loomcount.plans.registry import Tables, big, query, r6

_S = "s AS (SELECT doc_id, quality AS y, (doc_id % 4)::BIGINT AS block, ((doc_id * 37 + quality * 211 + toxic * 97) % 1000) / 1000.0::DOUBLE AS p FROM labels)"
_G = _S + """, g AS (SELECT p, n, pos, coalesce(sum(n) OVER w, 0) AS seen, coalesce(sum(pos) OVER w, 0) AS hits, sum(n) OVER () AS total, sum(pos) OVER () AS positives
    FROM (SELECT p, count(*) AS n, sum(y) AS pos FROM s GROUP BY p) WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def scored(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", F.col("quality").alias("y"), (F.col("doc_id") % 4).alias("block"), (((F.col("doc_id") * 37 + F.col("quality") * 211 + F.col("toxic") * 97) % 1000) / 1000.0).alias("p"))


@query(f"""WITH {_S}, c AS (SELECT block, count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn FROM s GROUP BY block)
    SELECT block, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp, tn::BIGINT AS tn, round((tp + tn) / (tp + fn + fp + tn), 6) AS acc, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv,
    round(tp / nullif(tp + fn, 0), 6) AS sen, round(tn / nullif(tn + fp, 0), 6) AS spc, round(tp / nullif(tp + fp, 0), 6) AS pre, round(tp / nullif(tp + fn, 0), 6) AS rec, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
    round(tp / nullif(tp + fp, 0) * (tp + fn + fp + tn) / nullif(tp + fn, 0), 6) AS lift, round(tp * 0 + fn * 5 + fp * 1 + tn * 0, 6) AS cost FROM c""")
def confusion_metrics(t: Tables) -> DataFrame:
    """A12, E01, E03"""
    got = me.cost(me.rates(me.confusion(scored(t), F.lit(0.5), "block")), 0, 5, 1, 0)
    return got.select("block", "tp", "fn", "fp", "tn", *[r6(c, c) for c in ("acc", "ppv", "npv", "sen", "spc", "pre", "rec", "f1", "lift", "cost")])


@query(f"WITH {_G} SELECT round(sum((n - pos) * (hits + pos / 2)) / (any_value(positives) * (any_value(total) - any_value(positives))), 6) AS roc FROM g")
def roc_area(t: Tables) -> DataFrame:
    """E04, W15, W16"""
    return me.roc_area(me.tie_groups(scored(t))).select(r6("roc", "roc"))


@query(f"""WITH {_G}, e AS (SELECT seen - hits + (k - 1) * (1 - pos / n) AS nb, hits + (k - 1) * pos / n AS pb, pos / n AS f, total, positives FROM g, LATERAL (SELECT unnest(range(1, n::BIGINT + 1)) AS k))
    SELECT round(sum(CASE WHEN nb + (1 - f) <= 50 + 1e-9 THEN (pb + f / 2) * (1 - f) ELSE 0 END) / any_value(positives) / (any_value(total) - any_value(positives)) * ((any_value(total) - any_value(positives))::BIGINT // 50), 6) AS r50 FROM e""")
def roc_50(t: Tables) -> DataFrame:
    """E05"""
    return me.roc_n(me.tie_groups(scored(t)), 50).select(r6("rocn", "r50"))


@query(f"""WITH {_G}, e AS (SELECT k, n, pos, hits, seen, positives FROM g, LATERAL (SELECT unnest(range(1, n::BIGINT + 1)) AS k) WHERE pos > 0)
    SELECT round(sum(pos / n * (hits + 1 + CASE WHEN n > 1 THEN (k - 1) * (pos - 1) / (n - 1) ELSE 0 END) / (seen + k)) / any_value(positives), 6) AS apr FROM e""")
def average_precision(t: Tables) -> DataFrame:
    """E06"""
    return me.average_precision(me.tie_groups(scored(t))).select(r6("apr", "apr"))


@query(f"""WITH {_G} SELECT round(sum((r - r0) * (pr + pr0) / 2), 6) AS area FROM (SELECT (hits + pos) / positives AS r, (hits + pos) / (seen + n) AS pr, hits / positives AS r0, CASE WHEN seen > 0 THEN hits / seen ELSE 1 END AS pr0 FROM g)""")
def precision_recall_area(t: Tables) -> DataFrame:
    """Trapezoids between the tie groups, precision 1 at the start"""
    g = me.tie_groups(scored(t))
    r, r0 = (F.col("hits") + F.col("pos")) / F.col("positives"), F.col("hits") / F.col("positives")
    pr, pr0 = (F.col("hits") + F.col("pos")) / (F.col("seen") + F.col("n")), F.when(F.col("seen") > 0, F.col("hits") / F.nullif(F.col("seen"), F.lit(0))).otherwise(1.0)
    return g.agg(r6(F.sum((r - r0) * (pr + pr0) / 2), "area"))


@query(f"WITH {_G} SELECT round(sum(greatest(0, least(n, positives - seen)) * pos / n) / any_value(positives), 6) AS prb FROM g")
def break_even_point(t: Tables) -> DataFrame:
    """E08"""
    return me.break_even(me.tie_groups(scored(t))).select(r6("prb", "prb"))


@query(f"""WITH {_S} SELECT block, round(sqrt(avg((y - p) ** 2)), 6) AS rms, round(avg(abs(y - p) ** 3) ** (1 / 3.0), 6) AS lp,
    round(avg(CASE WHEN (CASE WHEN y = 1 THEN p ELSE 1 - p END) <= 0 THEN 9e99 ELSE -log2(CASE WHEN y = 1 THEN p ELSE 1 - p END) END), 4) AS cxe FROM s WHERE p > 0 GROUP BY block""")
def error_norms(t: Tables) -> DataFrame:
    """E09, E10"""
    return me.errors(scored(t).filter("p > 0"), "block", norm=3.0).select("block", r6("rms", "rms"), r6("lp", "lp"), F.round("cxe", 4).alias("cxe"))


@query(f"""WITH {_S}, b AS (SELECT floor(p / 0.01) AS bin, sum(y) AS t, count(*) AS n FROM s GROUP BY bin) SELECT round(sum(n * (2 * greatest(t, n - t) / n - 1) ** 2) / sum(n), 6) AS slq FROM b""")
def slac_q(t: Tables) -> DataFrame:
    """E11"""
    return me.slac_q(scored(t), 0.01).select(r6("slq", "slq"))


@query(f"""WITH {_S} SELECT round(sum(e) / 19, 6) AS ca1 FROM (SELECT k, abs(avg(y) - avg(p)) AS e FROM s JOIN range(0, 19) r(k) ON p >= k * 0.05::DOUBLE AND p <= k * 0.05::DOUBLE + 0.1::DOUBLE GROUP BY k)""")
def calibration_bins(t: Tables) -> DataFrame:
    """E12"""
    return me.calibration_bins(scored(t)).select(r6("ca1", "ca1"))


@query(f"""WITH {_S}, o AS (SELECT row_number() OVER w AS k, sum(y) OVER v AS sy, sum(p) OVER v AS sp FROM s WINDOW w AS (ORDER BY p, y DESC, doc_id), v AS (ORDER BY p, y DESC, doc_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT round(avg(abs(sy - sp) / 100), 6) AS ca2 FROM o WHERE k >= 100""")
def calibration_sliding(t: Tables) -> DataFrame:
    """E13, W17"""
    return me.calibration_sliding(scored(t)).select(r6("ca2", "ca2"))


@query(f"""WITH {_S}, g AS (SELECT block, p, n, pos, coalesce(sum(n) OVER w, 0) AS seen FROM (SELECT block, p, count(*) AS n, sum(y) AS pos FROM s GROUP BY ALL) WINDOW w AS (PARTITION BY block ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT block, max(CASE WHEN pos > 0 THEN seen + n END)::BIGINT AS rkl, max((seen < 1 AND pos > 0 AND (pos = n OR seen + n <= 1))::BIGINT) AS top1, max((seen < 10 AND pos > 0 AND (pos = n OR seen + n <= 10))::BIGINT) AS top10 FROM g GROUP BY block""")
def rank_of_last_top(t: Tables) -> DataFrame:
    """E14, T07, E18"""
    g = me.tie_groups(scored(t), "block")
    return me.last_rank(g, "block").join(me.top_n(g, 1, "top1", "block"), "block").join(me.top_n(g, 10, "top10", "block"), "block")


@query(f"""WITH {_G} SELECT p, round((hits + pos) / positives, 6) AS tpr, round((seen + n - hits - pos) / (total - positives), 6) AS fpr, round((hits + pos) / (seen + n), 6) AS pre,
    round((hits + pos) / (seen + n) / (positives / total), 6) AS lift, round((hits + pos + total - positives - (seen + n - hits - pos)) / total, 6) AS acc,
    round((positives - hits - pos) * 5.0 + seen + n - hits - pos, 6) AS cost FROM g""")
def curves(t: Tables) -> DataFrame:
    """ROC, precision-recall, lift, accuracy and cost (5 for a missed positive, 1 for a false one) by threshold"""
    g = me.tie_groups(scored(t))
    tp, all_ = F.col("hits") + F.col("pos"), F.col("seen") + F.col("n")
    neg = F.col("total") - F.col("positives")
    return g.select("p", r6(tp / F.col("positives"), "tpr"), r6((all_ - tp) / neg, "fpr"), r6(tp / all_, "pre"), r6(tp / all_ / (F.col("positives") / F.col("total")), "lift"), r6((tp + neg - (all_ - tp)) / F.col("total"), "acc"), r6((F.col("positives") - tp) * 5.0 + (all_ - tp), "cost"))


_T = _G + """, t AS (SELECT p, (p + lead(p) OVER (ORDER BY p DESC)) / 2 AS th, hits + pos AS tp, seen + n - hits - pos AS fp, positives - hits - pos AS fn, total - positives - (seen + n - hits - pos) AS tn, total FROM g)"""


@query(f"""WITH {_T} SELECT (SELECT round(th, 6) FROM t WHERE th IS NOT NULL ORDER BY round((tp + tn) / total, 12) DESC, p DESC LIMIT 1) AS max_acc_threshold, (SELECT round(max((tp + tn) / total), 6) FROM t WHERE th IS NOT NULL) AS max_acc,
    (SELECT round(th, 6) FROM t WHERE th IS NOT NULL ORDER BY tp * 0 + fn * 5 + fp, p DESC LIMIT 1) AS min_cost_threshold, (SELECT round(min(fn * 5 + fp), 6) FROM t WHERE th IS NOT NULL) AS min_cost,
    (SELECT round(avg(p), 6) FROM (SELECT p, row_number() OVER (ORDER BY p, y DESC, doc_id) AS k, count(*) FILTER (y = 0) OVER () AS z FROM s) WHERE k IN (z, z + 1)) AS freq_threshold""")
def best_thresholds(t: Tables) -> DataFrame:
    """E02, E16"""
    s = scored(t)
    th = me.thresholds(me.tie_groups(s))
    a, c, f = me.max_accuracy(th), me.min_cost(th, 0, 5, 1, 0), me.frequency_threshold(s)
    one = a.select(r6("threshold", "max_acc_threshold"), r6("acc", "max_acc")).crossJoin(c.select(r6("threshold", "min_cost_threshold"), r6("cost", "min_cost")))
    return one.crossJoin(f.select(r6("threshold", "freq_threshold")))  # three tables of one row


@query(f"""WITH {_S}, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn FROM s)
    SELECT round(1 - (tp + tn) / (tp + fn + fp + tn), 6) AS acc_loss, round(1 - 2 * tp / (2 * tp + fp + fn), 6) AS f1_loss, round(1 - tp / (tp + fp), 6) AS pre_loss, round(1 - tp / (tp + fn), 6) AS rec_loss FROM c""")
def losses(t: Tables) -> DataFrame:
    """E17"""
    c = me.rates(me.confusion(scored(t), F.lit(0.5)))
    return c.select(*[r6(1 - F.col(k), f"{k}_loss") for k in ("acc", "f1", "pre", "rec")])


@query(f"""WITH {_S}, g AS (SELECT block, p, n, pos, coalesce(sum(n) OVER w, 0) AS seen, coalesce(sum(pos) OVER w, 0) AS hits, sum(pos) OVER (PARTITION BY block) AS positives
      FROM (SELECT block, p, count(*) AS n, sum(y) AS pos FROM s GROUP BY ALL) WINDOW w AS (PARTITION BY block ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    a AS (SELECT block, sum(pos / n * (hits + 1 + CASE WHEN n > 1 THEN (k - 1) * (pos - 1) / (n - 1) ELSE 0 END) / (seen + k)) / any_value(positives) AS apr, max(seen + n) AS rkl FROM g, LATERAL (SELECT unnest(range(1, n::BIGINT + 1)) AS k) WHERE pos > 0 GROUP BY block),
    e AS (SELECT block, sqrt(avg((y - p) ** 2)) AS rms FROM s GROUP BY block)
    SELECT round(avg(apr), 6) AS apr, round(avg(rkl), 6) AS rkl, round(avg(rms), 6) AS rms, count(*) AS blocks FROM a JOIN e USING (block)""")
def block_means(t: Tables) -> DataFrame:
    """A22, E18"""
    s = scored(t)
    g = me.tie_groups(s, "block")
    each = me.average_precision(g, "block").join(me.last_rank(g, "block"), "block").join(me.errors(s, "block"), "block")
    return each.agg(r6(F.avg("apr"), "apr"), r6(F.avg("rkl"), "rkl"), r6(F.avg("rms"), "rms"), F.count(F.lit(1)).alias("blocks"))


@query("""WITH s AS (SELECT toxic AS y, ((doc_id * 37 + toxic * 411) % 1000) / 1000.0 AS p FROM labels), c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn FROM s)
    SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(fp / (fp + tn), 6) AS fp_rate FROM c""")
def spam_f_measure(t: Tables) -> DataFrame:
    """Precision and recall in their usual sense"""
    s = t.labels.select(F.col("toxic").alias("y"), (((F.col("doc_id") * 37 + F.col("toxic") * 411) % 1000) / 1000.0).alias("p"))
    c = me.rates(me.confusion(s, F.lit(0.5)))
    return c.select(r6("f1", "f"), r6("sen", "sensitivity"), r6("spc", "specificity"), r6(1 - F.col("spc"), "fp_rate"))


@query("""WITH s AS (SELECT value AS y, ((event_id * 17) % 100) / 100.0 AS p FROM events) SELECT count(*) FILTER (y >= m) AS ones, count(*) AS n FROM s, (SELECT avg(y) AS m FROM s)""")
def binarised_targets(t: Tables) -> DataFrame:
    """E-preprocessing: targets at or above their mean are positive"""
    b = me.binarised(t.events.select(F.col("value").alias("y"), (((F.col("event_id") * 17) % 100) / 100.0).alias("p")))
    return b.agg(big(F.sum("y"), "ones"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_G}, a AS (SELECT avg(((p >= 0.5) = (y = 1))::INT) AS acc, sqrt(avg((y - p) ** 2)) AS rms FROM s), r AS (SELECT sum((n - pos) * (hits + pos / 2)) / (any_value(positives) * (any_value(total) - any_value(positives))) AS roc FROM g)
    SELECT round((acc + roc + 1 - rms) / 3, 6) AS sar FROM a, r""")
def sar(t: Tables) -> DataFrame:
    """The mean of accuracy, ROC area and 1 - RMS"""
    s = scored(t)
    one = me.rates(me.confusion(s, F.lit(0.5))).select("acc").crossJoin(me.errors(s).select("rms")).crossJoin(me.roc_area(me.tie_groups(s)))  # three tables of one row
    return one.select(r6((F.col("acc") + F.col("roc") + 1 - F.col("rms")) / 3, "sar"))
