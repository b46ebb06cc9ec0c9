"""Interpolation of missing values and least squares (survey 2.14).

Interpolation works on rows (by, x, y) with null for a missing y. The known places on both sides are carried between ranges of the order, so a series of any length
is spread over all tasks. A cubic spline's tridiagonal system is solved in chunks of CHUNK knots that see HALO knots of their neighbours: it is diagonally dominant, the influence of a knot
halves at least with each step, and after 64 steps is below the precision of a double.

Least squares are normal equations of sums that are combined before the shuffle; values are centred by the group's means first, so that sums of squares keep their digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcount.functions.ordered import bracketed, numbered

CHUNK, HALO = 4_096, 64


def linear(df: DataFrame, by: tuple[str, ...], x: str, y: str, name: str) -> DataFrame:
    """df with `name`: y, or where it is null the straight line between the known neighbours; beyond the first and last one their value; null if none is known."""
    got = bracketed(df, x, F.when(F.col(y).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))), by)
    x0, y0, x1, y1 = F.col("before.x"), F.col("before.y"), F.col("after.x"), F.col("after.y")
    line = y0 + (F.col(x) - x0) / F.when(x1 != x0, x1 - x0) * (y1 - y0)
    return got.withColumn(name, F.coalesce(F.col(y).cast("double"), line, y0, y1)).drop("before", "after")


def bends(knots: DataFrame, by: tuple[str, ...], x: str, y: str) -> DataFrame:
    """by, x, y, m of knots with different x: m is the second derivative of the natural cubic spline."""
    rows = numbered(knots.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "x", "_at", by=by)
    home = F.floor((F.col("_at") - 1) / CHUNK)
    offset = (F.col("_at") - 1) % CHUNK
    to = F.array_compact(F.array(home, F.when(offset < HALO, home - 1), F.when(offset >= CHUNK - HALO, home + 1)))
    rows = rows.withColumn("_home", home).withColumn("_chunk", F.explode(F.filter(to, lambda c: c >= 0)))
    names = [f.name for f in rows.schema if f.name in by]
    schema = rows.select(*names, "x", "y").schema.simpleString()[7:-1].replace(":", " ") + ", m double"

    def solve(part):
        import numpy as np

        part = part.sort_values("_at", ignore_index=True)
        x, y, n = part["x"].to_numpy(), part["y"].to_numpy(), len(part)
        m = np.zeros(n)
        if n > 2:
            h, slope = np.diff(x), np.diff(y) / np.diff(x)
            right, upper = 6 * np.diff(slope), np.zeros(n - 2)
            for i in range(n - 2):  # elimination, then back
                pivot = 2 * (h[i] + h[i + 1]) - (h[i] * upper[i - 1] if i else 0.0)
                upper[i] = h[i + 1] / pivot
                right[i] = (right[i] - (h[i] * right[i - 1] if i else 0.0)) / pivot
            for i in range(n - 3, -1, -1):
                m[i + 1] = right[i] - upper[i] * m[i + 2]
        return part.assign(m=m)[part["_home"] == part["_chunk"]][[*names, "x", "y", "m"]]

    return rows.groupBy(*by, "_chunk").applyInPandas(solve, schema)


def cubic(df: DataFrame, by: tuple[str, ...], x: str, y: str, name: str) -> DataFrame:
    """df with `name`: y, or where it is null the natural cubic spline through the known values; beyond the first and last one their value. Of a group's rows no two have the same x."""
    knots = bends(df.filter(F.col(y).isNotNull()), by, x, y)
    knots = knots.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.struct("x", "y", "m").alias("_knot"), F.col("x").alias("_kx"))
    met = df.join(knots, [df[c].eqNullSafe(F.col(f"_k_{c}")) for c in by] + [df[x].cast("double") == F.col("_kx")], "left").drop("_kx", *[f"_k_{c}" for c in by])
    got = bracketed(met, x, F.col("_knot"), by)
    x0, y0, m0, x1, y1, m1 = (F.col(f"{side}.{c}") for side in ("before", "after") for c in ("x", "y", "m"))
    h = F.when(x1 != x0, x1 - x0)
    a, b = (x1 - F.col(x)) / h, (F.col(x) - x0) / h
    curve = a * y0 + b * y1 + ((a * a * a - a) * m0 + (b * b * b - b) * m1) * h * h / 6
    return got.withColumn(name, F.coalesce(F.col(y).cast("double"), curve, y0, y1)).drop("before", "after", "_knot")


def least_squares(df: DataFrame, by: tuple[str, ...], y: Column, xs: list[Column], ridge: float = 0.0) -> DataFrame:
    """by, n, intercept, slopes, rss (sum of squared residuals), r2 of y on xs, for each group; ridge is added to the diagonal of the centred cross products. Rows with a null take no part; slopes are those of least norm
    if the xs depend on each other."""
    k = len(xs)
    rows = df.select(*by, y.cast("double").alias("_x0"), *[c.cast("double").alias(f"_x{i + 1}") for i, c in enumerate(xs)]).dropna(subset=[f"_x{i}" for i in range(k + 1)])
    means = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(k + 1)])
    named = means.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[f"_m{i}" for i in range(k + 1)])
    met = rows.join(named, [rows[c].eqNullSafe(named[f"_by_{c}"]) for c in by]) if by else rows.crossJoin(F.broadcast(named))  # one row
    d = [F.col(f"_x{i}") - F.col(f"_m{i}") for i in range(k + 1)]
    sums = [F.sum(d[i] * d[j]).alias(f"_s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    sums = met.groupBy(*by).agg(*sums).select(*[F.col(c).alias(f"_by_{c}") for c in by], *[f"_s{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)])
    both = means.join(sums, [means[c].eqNullSafe(sums[f"_by_{c}"]) for c in by] or F.lit(True)).drop(*[f"_by_{c}" for c in by])
    names = [f.name for f in both.schema if f.name in by]
    schema = (both.select(*names, "n").schema.simpleString()[7:-1].replace(":", " ")) + ", intercept double, slopes array<double>, rss double, r2 double"

    def solve(batches):
        import numpy as np

        for b in batches:
            out = b[[*names, "n"]].copy()
            got = []
            for r in b.to_dict("records"):
                s = np.array([[r[f"_s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                c = np.linalg.lstsq(s[1:, 1:] + ridge * np.eye(k), s[1:, 0], rcond=1e-12)[0]
                rss = max(0.0, s[0, 0] - 2 * c @ s[1:, 0] + c @ s[1:, 1:] @ c)
                got.append((r["_m0"] - sum(c[i] * r[f"_m{i + 1}"] for i in range(k)), c.tolist(), rss, 1 - rss / s[0, 0] if s[0, 0] > 0 else None))
            for i, name in enumerate(("intercept", "slopes", "rss", "r2")):
                out[name] = [g[i] for g in got]
            yield out

    return both.mapInPandas(solve, schema)


def polynomial(df: DataFrame, by: tuple[str, ...], x: Column, y: Column, degree: int, ridge: float = 0.0) -> DataFrame:
    """least_squares of y on the powers of u = (x - centre) / width of each group, whose mean and deviation are given as centre and width (width 1 where there is no deviation)."""
    rows = df.select(*by, x.cast("double").alias("_px"), y.cast("double").alias("_py")).dropna(subset=["_px", "_py"])
    scale = rows.groupBy(*by).agg(F.avg("_px").alias("centre"), F.coalesce(F.nullif(F.stddev_pop("_px"), F.lit(0.0)), F.lit(1.0)).alias("width"))
    named = scale.select(*[F.col(c).alias(f"_by_{c}") for c in by], "centre", "width")
    met = rows.join(named, [rows[c].eqNullSafe(named[f"_by_{c}"]) for c in by]) if by else rows.crossJoin(F.broadcast(named))  # one row
    u = (F.col("_px") - F.col("centre")) / F.col("width")
    powers = [u]
    for _ in range(degree - 1):
        powers.append(powers[-1] * u)
    got = least_squares(met.select(*by, "_py", *[p.alias(f"_u{i}") for i, p in enumerate(powers)]), by, F.col("_py"), [F.col(f"_u{i}") for i in range(degree)], ridge)
    return got.join(named, [got[c].eqNullSafe(named[f"_by_{c}"]) for c in by] or F.lit(True)).drop(*[f"_by_{c}" for c in by])
