"""Moments, hypothesis tests and matrices of covariance and correlation (survey 2.14).

Everything is a sum over rows, or over groups of ties, in groups `by`: partial sums are combined before the shuffle. Ranks come from counts of equal values, summed in
sampled ranges (`functions.ordered.running`), so neither a group of any size nor a value that many rows share is sorted in one task.
P-values: `both`, `left` (small if the statistic is too small) and `right`.

Null and non-finite values take no part. Statistics that need more rows than there are, or a spread where there is none, are null.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcount.functions import special as sp
from loomcount.functions.ordered import running

D = "decimal(38,0)"


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _values(df: DataFrame, by: tuple[str, ...], value: Column, *more: Column) -> DataFrame:
    return df.select(*by, value.cast("double").alias("x"), *more).filter(finite(F.col("x")))


def _per(x: Column, y: Column) -> Column:
    return x / F.when(y != 0, y)


def moments(df: DataFrame, by: tuple[str, ...], value: Column) -> DataFrame:
    """n, mean, variance (n - 1), skewness and kurtosis (excess) by the sample deviation, adev (mean absolute deviation); without spread the last three are 0."""
    rows = _values(df, by, value)
    n, share = F.count("x"), (F.count("x") - 1) / F.count("x")
    flat = F.coalesce(F.var_pop("x") == 0, F.lit(True))
    got = rows.groupBy(*by).agg(
        n.alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.when(flat, 0.0).otherwise(F.skewness("x") * F.pow(share, 1.5)).alias("skewness"),
        F.when(flat, 0.0).otherwise((F.kurtosis("x") + 3) * share * share - 3).alias("kurtosis"),
    )
    means = got.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("mean").alias("_m"))
    away = rows.join(means, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True)).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.avg(F.abs(F.col("x") - F.col("_m"))).alias("adev"))
    return got.join(away, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True)).drop(*[f"_{c}" for c in by])


def tails(cdf: Column) -> Column:
    """The struct both, left, right of a statistic with a continuous distribution."""
    return sp.bound(lambda v: F.struct(F.least(F.lit(1.0), 2 * F.least(v["p"], 1 - v["p"])).alias("both"), v["p"].alias("left"), (1 - v["p"]).alias("right")), p=cdf)


def _with_tails(df: DataFrame, cdf: Column) -> DataFrame:
    return df.withColumn("_tails", tails(cdf)).select(*df.columns, "_tails.*")


def t_one(df: DataFrame, by: tuple[str, ...], value: Column, mean: float) -> DataFrame:
    """n, t, df of the mean against a given one."""
    got = _values(df, by, value).groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    t = _per((F.col("m") - mean) * F.sqrt("n"), F.col("s"))
    got = got.select(*by, "n", t.alias("t"), (F.col("n") - 1).cast("double").alias("df"))
    return _with_tails(got, sp.student_cdf(F.col("t"), F.col("df")))


def _two(df: DataFrame, by: tuple[str, ...], value: Column, first: Column) -> DataFrame:
    """n, mean and variance of the rows for which `first` holds (1) and of the others (2); where it is null a row takes no part."""
    rows = _values(df, by, value, first.alias("first")).filter("first IS NOT NULL")
    pick = lambda k: F.when(F.col("first") if k == 1 else ~F.col("first"), F.col("x"))
    return rows.groupBy(*by).agg(*[f(pick(k)).alias(f"{name}{k}") for k in (1, 2) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])


def t_two(df: DataFrame, by: tuple[str, ...], value: Column, first: Column, pooled: bool) -> DataFrame:
    """t, df of the difference of two means: pooled variance, or unequal variances."""
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    if pooled:
        free = (n1 + n2 - 2).cast("double")
        error = _per((n1 - 1) * v1 + (n2 - 1) * v2, free) * (1 / n1 + 1 / n2)
    else:
        error = v1 / n1 + v2 / n2
        free = _per(error * error, F.pow(v1 / n1, 2) / (n1 - 1) + F.pow(v2 / n2, 2) / (n2 - 1))
    got = _two(df, by, value, first).filter("n1 > 1 AND n2 > 1")
    got = got.select(*by, "n1", "n2", _per(F.col("m1") - F.col("m2"), F.sqrt(error)).alias("t"), free.alias("df"))
    return _with_tails(got, sp.student_cdf(F.col("t"), F.col("df")))


def f_test(df: DataFrame, by: tuple[str, ...], value: Column, first: Column) -> DataFrame:
    """f of two variances."""
    got = _two(df, by, value, first).filter("n1 > 1 AND n2 > 1").select(*by, "n1", "n2", _per(F.col("v1"), F.col("v2")).alias("f"))
    return _with_tails(got, sp.fisher_cdf(F.col("f"), (F.col("n1") - 1).cast("double"), (F.col("n2") - 1).cast("double")))


def variance_test(df: DataFrame, by: tuple[str, ...], value: Column, variance: float) -> DataFrame:
    """chi2 of the variance against a given one."""
    got = _values(df, by, value).groupBy(*by).agg(F.count("x").alias("n"), ((F.count("x") - 1) * F.var_samp("x") / variance).alias("chi2")).filter("n > 1")
    return _with_tails(got, sp.chi2_cdf(F.col("chi2"), (F.col("n") - 1).cast("double")))


def jarque_bera(df: DataFrame, by: tuple[str, ...], value: Column) -> DataFrame:
    """jb and its asymptotic p (chi squared with two degrees of freedom)."""
    n = F.count("x")
    got = _values(df, by, value).groupBy(*by).agg(n.alias("n"), (n / 6 * (F.pow(F.skewness("x"), 2) + F.pow(F.kurtosis("x"), 2) / 4)).alias("jb"))
    return got.select("*", F.exp(-F.col("jb") / 2).alias("p"))


def _ties(rows: DataFrame, by: tuple[str, ...], marked: Column) -> DataFrame:
    """By value x: n (rows), a (marked rows), twice (twice the midrank)."""
    ties = rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"), F.sum(marked.cast("long")).alias("a"))
    ranked = running(ties, "x", {"before": F.col("n")}, by=by)
    return ranked.withColumn("twice", 2 * F.col("before") + F.col("n") + 1)


def _cubes() -> Column:
    n = F.col("n").cast(D)
    return F.sum((n * n * n - n).cast(D)).cast("double")


def mann_whitney(df: DataFrame, by: tuple[str, ...], value: Column, first: Column) -> DataFrame:
    """u of the first sample, z with the correction for ties, by the normal distribution."""
    ties = _ties(_values(df, by, value, first.alias("first")).filter("first IS NOT NULL"), by, F.col("first"))
    got = ties.groupBy(*by).agg(F.sum("n").alias("all"), F.sum("a").alias("n1"), F.sum((F.col("a").cast(D) * F.col("twice")).cast(D)).alias("ranks"), _cubes().alias("cubes"))
    n1, all_ = F.col("n1").cast("double"), F.col("all").cast("double")
    got = got.withColumn("n2", F.col("all") - F.col("n1")).withColumn("u", F.col("ranks").cast("double") / 2 - n1 * (n1 + 1) / 2)
    n2 = F.col("n2").cast("double")
    spread = F.sqrt(n1 * n2 / 12 * (all_ + 1 - _per(F.col("cubes"), all_ * (all_ - 1))))
    got = got.select(*by, "n1", "n2", "u", _per(F.col("u") - n1 * n2 / 2, spread).alias("z"))
    return _with_tails(got, sp.normal_cdf(F.col("z")))


def wilcoxon(df: DataFrame, by: tuple[str, ...], value: Column, median: float) -> DataFrame:
    """w, the sum of the ranks of |x - median| above the median; rows at the median are left out; z with the correction for ties."""
    away = (value.cast("double") - median).alias("d")
    rows = df.select(*by, away).filter(finite(F.col("d")) & (F.col("d") != 0)).withColumn("x", F.abs("d"))
    got = _ties(rows, by, F.col("d") > 0).groupBy(*by).agg(F.sum("n").alias("n"), F.sum((F.col("a").cast(D) * F.col("twice")).cast(D)).alias("ranks"), _cubes().alias("cubes"))
    n = F.col("n").cast("double")
    w = F.col("ranks").cast("double") / 2
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("cubes") / 48)
    got = got.select(*by, "n", w.alias("w"), _per(w - n * (n + 1) / 4, spread).alias("z"))
    return _with_tails(got, sp.normal_cdf(F.col("z")))


def sign_test(df: DataFrame, by: tuple[str, ...], value: Column, median: float) -> DataFrame:
    """above, below, and the exact binomial tails; rows at the median are left out."""
    got = _values(df, by, value).groupBy(*by).agg(F.count_if(F.col("x") > median).alias("above"), F.count_if(F.col("x") < median).alias("below"))
    n = F.col("above") + F.col("below")
    left, right = sp.binomial_cdf(F.col("above"), n), sp.binomial_cdf(F.col("below"), n)
    both = F.least(F.lit(1.0), 2 * sp.binomial_cdf(F.least("above", "below"), n))
    return got.select("*", both.alias("both"), left.alias("left"), right.alias("right"))


def significance(df: DataFrame, r: str) -> DataFrame:
    """df with t, both, left, right of its column r, the coefficient of correlation of n rows."""
    free = (F.col("n") - 2).cast("double")
    t = _per(F.col(r) * F.sqrt(free), F.sqrt(F.when(F.abs(r) < 1, 1 - F.col(r) * F.col(r))))
    return _with_tails(df.withColumn("t", t), sp.student_cdf(F.col("t"), free))


def gram(df: DataFrame, vector: Column) -> DataFrame:
    """i, j, n, si, sj, sij, for i <= j (from 0): the number of rows, and the sums of the components and of their products, each less a first estimate of its mean, which is taken from
    one row. One pass: a task sums its rows in matrix products and gives a row for each pair of components, whatever the number of its rows.
    Vectors that are null, hold null or non-finite components, or have another length than the longest one's, take no part."""
    v = vector.cast("array<double>")
    rows = df.select(v.alias("v")).filter((F.size("v") > 0) & F.forall("v", finite))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return df.sparkSession.createDataFrame([], "i int, j int, n long, si double, sj double, sij double")
    rows = rows.filter(F.size("v") == width)
    about = rows.first()[0]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n, one, two = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, width) - np.array(about)
            n += len(x)
            one += x.sum(0)
            two += x.T @ x
        if n:
            i, j = (x.astype(np.int32) for x in np.triu_indices(width))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, np.full(len(i), n, dtype=np.int64), one[i], one[j], two[i, j])], names=["i", "j", "n", "si", "sj", "sij"])

    part = rows.mapInArrow(run, "i int, j int, n long, si double, sj double, sij double")
    return part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def covariances(df: DataFrame, vector: Column) -> DataFrame:
    """i, j, n, cov (n - 1) and pearson of all pairs of components, i <= j."""
    g = gram(df, vector).withColumn("c", F.col("sij") - F.col("si") * F.col("sj") / F.col("n"))
    own = g.filter("i = j").select(F.col("i").alias("k"), F.col("c").alias("own"))  # a row for each component
    two = g.join(F.broadcast(own.toDF("i", "vi")), "i").join(F.broadcast(own.toDF("j", "vj")), "j")
    r = _per(F.col("c"), F.sqrt(F.col("vi") * F.col("vj")))
    return two.select("i", "j", "n", _per(F.col("c"), F.col("n") - 1).alias("cov"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("pearson"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, n, spearman of all pairs of columns by their place, i <= j: Pearson's coefficient of the midranks. Rows with a null or non-finite value in one of them take no part."""
    from loomcount.sources.tables import written

    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).filter(F.forall("v", finite))
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    rows = written(rows.select("id", F.posexplode("v").alias("c", "x")), "spearman-values")
    ranks = _ties(rows, ("c",), F.lit(True)).select("c", "x", (F.col("twice") / 2).alias("rank"))
    ranked = rows.join(ranks, ["c", "x"])  # values of many rows: AQE splits their partitions
    vectors = ranked.groupBy("id").agg(*[F.max(F.when(F.col("c") == k, F.col("rank"))).alias(f"r{k}") for k in range(len(columns))])
    vectors = written(vectors, "spearman-ranks")
    return covariances(vectors, F.array(*[f"r{k}" for k in range(len(columns))])).select("i", "j", "n", F.col("pearson").alias("spearman"))
