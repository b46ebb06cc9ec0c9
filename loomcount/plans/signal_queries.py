"""Interpolation, least squares, convolution, correlation and transforms of the hourly series of each event type (survey 2.14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount.operators import fit, signal
from loomcount.plans.registry import Tables, query, r6

#: Hours since the first one of the table; an hour of a stream without events has null.
_HOURS = """e AS (SELECT event_type AS stream, floor(epoch(ts) / 3600)::BIGINT AS h, value FROM events), z AS (SELECT min(h) AS low, max(h) AS high FROM e),
    g AS (SELECT stream, unnest(range(0, high - low + 1)) AS t FROM (SELECT DISTINCT stream FROM e), z),
    s AS (SELECT g.stream, g.t, avg(value) AS x, count(value) AS n FROM g CROSS JOIN z LEFT JOIN e ON e.stream = g.stream AND e.h = g.t + z.low GROUP BY ALL)"""
KERNEL = [0.4, 0.3, 0.2, 0.1]


def hours(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_type").alias("stream"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("h"), "value")
    ends = e.agg(F.min("h").alias("low"), F.max("h").alias("high"))  # one row
    grid = e.select("stream").distinct().crossJoin(F.broadcast(ends)).select("stream", "low", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("high") - F.col("low"))).alias("t"))
    sums = e.groupBy(F.col("stream").alias("s"), "h").agg(F.avg("value").alias("x"), F.count("value").alias("n"))
    met = grid.join(sums, (F.col("stream") == F.col("s")) & (F.col("t") + F.col("low") == F.col("h")), "left")
    return met.select("stream", "t", "x", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {_HOURS}, b AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER w AS t0, last_value(x IGNORE NULLS) OVER w AS x0,
      first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER v AS t1, first_value(x IGNORE NULLS) OVER v AS x1 FROM s
      WINDOW w AS (PARTITION BY stream ORDER BY t), v AS (PARTITION BY stream ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT stream, t, x IS NULL AS missing, round(coalesce(x, x0 + (t - t0) / nullif(t1 - t0, 0) * (x1 - x0), x0, x1), 6) AS filled FROM b""")
def interpolate_linear(t: Tables) -> DataFrame:
    """2.14 linear interpolation; missing epochs of S08"""
    got = fit.linear(hours(t), ("stream",), "t", "x", "filled")
    return got.select("stream", "t", F.col("x").isNull().alias("missing"), r6("filled", "filled"))


@query(f"""WITH RECURSIVE {_HOURS}, k AS MATERIALIZED (SELECT stream, t, x, row_number() OVER w AS i, count(*) OVER (PARTITION BY stream) AS n, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1,
      (lead(x) OVER w - x) / (lead(t) OVER w - t) - (x - lag(x) OVER w) / (t - lag(t) OVER w) AS d FROM s WHERE x IS NOT NULL WINDOW w AS (PARTITION BY stream ORDER BY t)),
    l AS MATERIALIZED (SELECT stream, n, list(h0 ORDER BY i) AS h0, list(h1 ORDER BY i) AS h1, list(d ORDER BY i) AS d FROM k GROUP BY ALL),
    f AS (SELECT stream, 1::BIGINT AS i, 0::DOUBLE AS u, 0::DOUBLE AS r FROM l UNION ALL
      SELECT stream, i + 1, h1[i + 1] / (2 * (h0[i + 1] + h1[i + 1]) - h0[i + 1] * u), (6 * d[i + 1] - h0[i + 1] * r) / (2 * (h0[i + 1] + h1[i + 1]) - h0[i + 1] * u) FROM f JOIN l USING (stream) WHERE i + 1 < n),
    e2 AS MATERIALIZED (SELECT stream, list(u ORDER BY i) AS us, list(r ORDER BY i) AS rs FROM f GROUP BY ALL),
    b AS (SELECT stream, n AS i, 0::DOUBLE AS m FROM l UNION ALL SELECT stream, i - 1, rs[i - 1] - us[i - 1] * m FROM b JOIN e2 USING (stream) WHERE i > 1),
    c AS (SELECT s.stream, s.t, s.x, m FROM s LEFT JOIN k ON k.stream = s.stream AND k.t = s.t LEFT JOIN b ON b.stream = k.stream AND b.i = k.i),
    o AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER w AS t0, last_value(x IGNORE NULLS) OVER w AS x0, last_value(m IGNORE NULLS) OVER w AS m0,
      first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER v AS t1, first_value(x IGNORE NULLS) OVER v AS x1, first_value(m IGNORE NULLS) OVER v AS m1 FROM c
      WINDOW w AS (PARTITION BY stream ORDER BY t), v AS (PARTITION BY stream ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    p AS (SELECT *, (t1 - t) / nullif(t1 - t0, 0)::DOUBLE AS a, (t - t0) / nullif(t1 - t0, 0)::DOUBLE AS b FROM o)
    SELECT stream, t, x IS NULL AS missing, round(coalesce(x, a * x0 + b * x1 + ((a * a * a - a) * m0 + (b * b * b - b) * m1) * (t1 - t0) * (t1 - t0) / 6, x0, x1), 6) AS filled FROM p""")
def interpolate_cubic(t: Tables) -> DataFrame:
    """2.14 natural cubic spline"""
    got = fit.cubic(hours(t), ("stream",), "t", "x", "filled")
    return got.select("stream", "t", F.col("x").isNull().alias("missing"), r6("filled", "filled"))


@query("SELECT l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY ALL")
def linear_fit(t: Tables) -> DataFrame:
    """2.14 least squares, one variable"""
    got = fit.least_squares(t.lineitem, ("l_linestatus",), F.col("l_extendedprice"), [F.col("l_quantity")])
    return got.select("l_linestatus", "n", r6(F.col("slopes")[0], "slope"), r6("intercept", "intercept"), r6("r2", "r2"))


_TWO = """u AS (SELECT g, count(*) AS n, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS b_y, var_pop(y) AS yy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x GROUP BY ALL),
    c AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS p, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM u)"""


@query(f"WITH x AS (SELECT l_linestatus AS g, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem), {_TWO} SELECT g AS l_linestatus, n, round(p, 6) AS slope_quantity, round(q, 4) AS slope_discount, round(my - p * ma - q * mb, 4) AS intercept, round((p * ay + q * b_y) / yy, 6) AS r2 FROM c")
def multiple_fit(t: Tables) -> DataFrame:
    """2.14 least squares, several variables"""
    got = fit.least_squares(t.lineitem, ("l_linestatus",), F.col("l_extendedprice"), [F.col("l_quantity"), F.col("l_discount")])
    return got.select("l_linestatus", "n", r6(F.col("slopes")[0], "slope_quantity"), F.round(F.col("slopes")[1], 4).alias("slope_discount"), F.round("intercept", 4).alias("intercept"), r6("r2", "r2"))


@query(f"""WITH {_HOURS}, m AS (SELECT stream, avg(t) AS m, stddev_pop(t) AS d FROM s WHERE x IS NOT NULL GROUP BY ALL), x AS (SELECT stream AS g, (t - m) / d AS a, pow((t - m) / d, 2) AS b, x AS y FROM s JOIN m USING (stream) WHERE x IS NOT NULL), {_TWO}
    SELECT g AS stream, n, round(m, 6) AS centre, round(d, 6) AS width, round(my - p * ma - q * mb, 6) AS c0, round(p, 6) AS c1, round(q, 6) AS c2, round((p * ay + q * b_y) / yy, 6) AS r2 FROM c JOIN m ON m.stream = c.g""")
def polynomial_fit(t: Tables) -> DataFrame:
    """2.14 polynomial least squares (trend of degree 2)"""
    got = fit.polynomial(hours(t), ("stream",), F.col("t"), F.col("x"), 2)
    return got.select("stream", "n", r6("centre", "centre"), r6("width", "width"), r6("intercept", "c0"), r6(F.col("slopes")[0], "c1"), r6(F.col("slopes")[1], "c2"), r6("r2", "r2"))


@query(f"WITH {_HOURS}, w(k, w) AS (VALUES {', '.join(f'({k}, {w}::DOUBLE)' for k, w in enumerate(KERNEL))}) SELECT stream, t + k AS t, round(sum(n * w), 6) AS x FROM s, w GROUP BY ALL")
def convolution(t: Tables) -> DataFrame:
    """2.14 convolution (a weighted mean of the last hours' counts)"""
    return signal.convolve(hours(t), ("stream",), "t", "n", KERNEL).select("stream", "t", r6("x", "x"))


@query(f"WITH {_HOURS}, l AS (SELECT unnest(range(-24, 25)) AS lag) SELECT s.stream, lag, round(sum(s.n * s2.n), 6) AS value FROM s, l, s s2 WHERE s2.stream = s.stream AND s2.t = s.t + lag GROUP BY ALL")
def auto_correlation(t: Tables) -> DataFrame:
    """2.14 cross-correlation of a series with itself, a day to both sides"""
    return signal.cross_correlation(hours(t), ("stream",), "t", "n", "n", 24).select("stream", "lag", r6("value", "value"))


_PAIR = "MIN(stream) AS a, MAX(stream) AS b"


@query(f"""WITH {_HOURS}, p AS (SELECT {_PAIR} FROM s), j AS (SELECT x.t, x.n AS x, y.n AS y FROM p JOIN s x ON x.stream = a JOIN s y ON y.stream = b AND y.t = x.t), l AS (SELECT unnest(range(-24, 25)) AS lag)
    SELECT lag, round(sum(j.x * j2.y), 6) AS value FROM j, l, j j2 WHERE j2.t = j.t + lag GROUP BY ALL""")
def cross_correlation(t: Tables) -> DataFrame:
    """2.14 cross-correlation of two series"""
    h = hours(t)
    ends = h.agg(F.min("stream").alias("a"), F.max("stream").alias("b"))  # one row
    h = h.crossJoin(F.broadcast(ends)).filter("stream = a OR stream = b").groupBy("t").agg(F.sum(F.when(F.col("stream") == F.col("a"), F.col("n"))).alias("x"), F.sum(F.when(F.col("stream") == F.col("b"), F.col("n"))).alias("y"))
    return signal.cross_correlation(h, (), "t", "x", "y", 24).select("lag", r6("value", "value"))


@query(f"""WITH {_HOURS}, k AS (SELECT unnest(range(0, 1024)) AS k) SELECT stream, k, round(sum(n * cos(2 * pi() * ((k * t) % 1024) / 1024)), 5) + 0 AS re, round(-sum(n * sin(2 * pi() * ((k * t) % 1024) / 1024)), 5) + 0 AS im FROM s, k WHERE t < 1024 GROUP BY ALL""")
def fourier_transform(t: Tables) -> DataFrame:
    """2.14 fast Fourier transform of the hourly counts, 1,024 places"""
    got = signal.fourier(hours(t), ("stream",), "t", "n", 1_024)
    return got.select("stream", "k", (F.round("re", 5) + 0).alias("re"), (F.round("im", 5) + 0).alias("im"))
