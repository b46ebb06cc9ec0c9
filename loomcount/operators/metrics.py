"""Binary classification and ranking metrics over (y, p) rows, y in {0, 1}.

Everything that depends on order works on tie groups (one row for each different p), so a tie of any size is one row, and running sums are
taken in ranges (functions.ordered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcount.functions.ordered import numbered, running


def binarised(df: DataFrame) -> DataFrame:
    """y as 0 or 1 by the mean of the targets."""
    mean = df.agg(F.avg("y").alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn("y", (F.col("y") >= F.col("_mean")).cast("int")).drop("_mean")  # one row


def tie_groups(df: DataFrame, *by: str) -> DataFrame:
    """by..., p, n, pos and, in descending order of p, the sums before: seen, hits; with totals total, positives."""
    g = df.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("pos"))
    g = running(g, "p", {"seen": F.col("n"), "hits": F.col("pos")}, True, (), by)
    all_ = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum("y").cast("bigint").alias("positives"))
    if not by:
        return g.crossJoin(F.broadcast(all_))  # one row
    return g.join(all_, list(by))


def confusion(df: DataFrame, threshold: Column, *by: str) -> DataFrame:
    """tp, fn, fp, tn at p >= threshold."""
    up, pos = F.col("p") >= threshold, F.col("y") == 1
    return df.groupBy(*by).agg(F.count_if(up & pos).alias("tp"), F.count_if(~up & pos).alias("fn"), F.count_if(up & ~pos).alias("fp"), F.count_if(~up & ~pos).alias("tn"))


def rates(c: DataFrame) -> DataFrame:
    """Measures of a confusion table; null where a denominator is zero."""
    tp, fn, fp, tn = (F.col(x).cast("double") for x in ("tp", "fn", "fp", "tn"))
    n = tp + fn + fp + tn
    pre, rec = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return c.withColumns({
        "acc": F.try_divide(tp + tn, n), "ppv": pre, "npv": F.try_divide(tn, tn + fn), "sen": rec, "spc": F.try_divide(tn, tn + fp), "pre": pre, "rec": rec,
        "f1": F.try_divide(2 * pre * rec, pre + rec), "lift": F.try_divide(pre, F.try_divide(tp + fn, n)),
    })


def cost(c: DataFrame, a: float, b: float, cc: float, d: float) -> DataFrame:
    return c.withColumn("cost", F.col("tp") * a + F.col("fn") * b + F.col("fp") * cc + F.col("tn") * d)


def roc_area(g: DataFrame, *by: str) -> DataFrame:
    """Trapezoids over the tie groups."""
    area = F.sum((F.col("n") - F.col("pos")) * (F.col("hits") + F.col("pos") / 2)) / (F.first("positives") * (F.first("total") - F.first("positives"))).cast("double")
    return g.groupBy(*by).agg(area.alias("roc"))


def roc_n(g: DataFrame, negatives: int, integer: bool = True) -> DataFrame:
    """Area until `negatives` negatives have been seen, scaled by all negatives / negatives (an integer division unless told otherwise).
    Ties count as fractions; positions inside a tie group follow from its counts."""
    each = g.withColumn("k", F.explode(F.expr("sequence(1L, n)")))
    frac = F.col("pos") / F.col("n")
    neg_before = F.col("seen") - F.col("hits") + (F.col("k") - 1) * (1 - frac)
    pos_before = F.col("hits") + (F.col("k") - 1) * frac
    scale = F.expr(f"(first(total) - first(positives)) div {negatives}") if integer else (F.first("total") - F.first("positives")) / negatives
    neg_all = (F.first("total") - F.first("positives")).cast("double")
    inside = neg_before + (1 - frac) <= negatives + 1e-9
    return each.agg((F.sum(F.when(inside, (pos_before + frac / 2) * (1 - frac)).otherwise(0.0)) / F.first("positives") / neg_all * scale).alias("rocn"))


def average_precision(g: DataFrame, *by: str) -> DataFrame:
    """Mean precision at the positives, expected over the orders of tied rows: at place k of a group of n with r positives,
    a positive has (k - 1)(r - 1)/(n - 1) positives of its group before it on average."""
    each = g.filter("pos > 0").withColumn("k", F.explode(F.expr("sequence(1L, n)")))
    inside = F.when(F.col("n") > 1, (F.col("k") - 1) * (F.col("pos") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0)
    at = F.col("pos") / F.col("n") * (F.col("hits") + 1 + inside) / (F.col("seen") + F.col("k"))
    return each.groupBy(*by).agg((F.sum(at) / F.first("positives")).alias("apr"))


def break_even(g: DataFrame) -> DataFrame:
    """Recall among as many rows as there are positives; the group at the border counts by its fraction."""
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("positives") - F.col("seen")))
    return g.agg((F.sum(taken * F.col("pos") / F.col("n")) / F.first("positives")).alias("prb"))


def last_rank(g: DataFrame, *by: str) -> DataFrame:
    return g.filter("pos > 0").groupBy(*by).agg(F.max(F.col("seen") + F.col("n")).cast("bigint").alias("rkl"))


def top_n(g: DataFrame, n: int, name: str, *by: str) -> DataFrame:
    """1 if a positive must be among the first n (ties: the groups that begin before), 0 else."""
    return g.groupBy(*by).agg(F.max(((F.col("seen") < n) & (F.col("pos") > 0) & ((F.col("pos") == F.col("n")) | (F.col("seen") + F.col("n") <= n))).cast("int")).cast("bigint").alias(name))


def errors(df: DataFrame, *by: str, norm: float = 2.0) -> DataFrame:
    """Root mean square error, L-p norm and mean cross-entropy (bits; 9e99 where a certain prediction fails)."""
    e = F.abs(F.col("y") - F.col("p"))
    q = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    ce = F.when(q <= 0, 9e99).otherwise(-F.log2(F.when(q > 0, q).otherwise(1.0)))
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rms"), F.pow(F.avg(F.pow(e, F.lit(norm))), F.lit(1 / norm)).alias("lp"), F.avg(ce).alias("cxe"))


def slac_q(df: DataFrame, width: float) -> DataFrame:
    b = df.groupBy(F.floor(F.col("p") / (width + 1e-99)).alias("bin")).agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
    purity = F.greatest("t", F.col("n") - F.col("t")) / F.col("n")
    return b.agg((F.sum(F.col("n") * F.pow(2 * purity - 1, 2)) / F.sum("n")).alias("slq"))


def calibration_bins(df: DataFrame) -> DataFrame:
    """Mean absolute calibration error of the 19 bins [k/20, k/20 + 0.1], both ends included: every row meets at most three of them by a key."""
    k = F.floor(F.col("p") * 20 + 1e-9)
    some = df.withColumn("bin", F.explode(F.array(k - 2, k - 1, k))).filter("bin BETWEEN 0 AND 18 AND p >= bin * 0.05D AND p <= bin * 0.05D + 0.1D")
    b = some.groupBy("bin").agg(F.abs(F.avg("y") - F.avg("p")).alias("e"))
    return b.agg((F.sum("e") / 19).alias("ca1"))


def calibration_sliding(df: DataFrame, size: int = 100) -> DataFrame:
    """Mean absolute calibration error of all windows of `size` rows in ascending order of p (positives first among ties). A row adds to the windows
    in which it stands: running sums at both ends of each window give its error."""
    placed = running(numbered(df, "p", "at", False, ("neg",)) if "neg" in df.columns else numbered(df.withColumn("neg", -F.col("y")), "p", "at", False, ("neg",)), "at", {"sy": F.col("y"), "sp": F.col("p")})
    ends = placed.select("at", (F.col("sy") + F.col("y")).alias("y1"), (F.col("sp") + F.col("p")).alias("p1"))
    starts = placed.select((F.col("at") + size - 1).alias("at"), F.col("sy").alias("y0"), F.col("sp").alias("p0"))
    return ends.join(starts, "at").agg(F.avg(F.abs((F.col("y1") - F.col("y0")) - (F.col("p1") - F.col("p0"))) / size).alias("ca2"))


def thresholds(g: DataFrame) -> DataFrame:
    """For each tie group the counts when it and all above are predicted positive, and the threshold half way to the next lower p."""
    nxt = running(g.select("p").distinct(), "p", {"r": F.lit(1)}, True)
    below = nxt.select((F.col("r") - 1).alias("r"), F.col("p").alias("next_p"))
    return g.join(nxt, "p").join(below, "r", "left").select(
        "p", "next_p", ((F.col("p") + F.col("next_p")) / 2).alias("threshold"), (F.col("hits") + F.col("pos")).alias("tp"), (F.col("seen") + F.col("n") - F.col("hits") - F.col("pos")).alias("fp"),
        (F.col("positives") - F.col("hits") - F.col("pos")).alias("fn"), (F.col("total") - F.col("positives") - (F.col("seen") + F.col("n") - F.col("hits") - F.col("pos"))).alias("tn"), "total",
    )


def max_accuracy(t: DataFrame) -> DataFrame:
    """The first strict maximum, scanning down."""
    acc = (F.col("tp") + F.col("tn")) / F.col("total")
    return t.filter("threshold IS NOT NULL").agg(F.max_by(F.struct(F.col("threshold"), acc.alias("acc")), F.struct(F.round(acc, 12).alias("a"), F.col("p"))).alias("x")).select("x.threshold", "x.acc")


def min_cost(t: DataFrame, a: float, b: float, c: float, d: float) -> DataFrame:
    got = cost(t, a, b, c, d).filter("threshold IS NOT NULL")
    return got.agg(F.min_by(F.struct("threshold", "cost"), F.struct(F.round("cost", 9).alias("c"), (-F.col("p")).alias("p"))).alias("x")).select("x.threshold", "x.cost")


def frequency_threshold(df: DataFrame) -> DataFrame:
    """Half way between the predictions at which as many rows are predicted negative as are."""
    zeros = df.agg(F.count_if(F.col("y") == 0).alias("zeros"))
    placed = numbered(df.withColumn("neg", -F.col("y")), "p", "at", False, ("neg",)).crossJoin(F.broadcast(zeros))  # one row
    return placed.filter("at IN (zeros, zeros + 1)").agg(F.avg("p").alias("threshold"))
