"""Moments, tests and matrices of covariance and correlation (survey 2.14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount.operators import stats as st
from loomcount.plans.registry import Tables, query, r6


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c, c) if c in names else F.col(c) for c in df.columns])


# Distribution functions in DuckDB, by the same definitions with its own lgamma: series of as many terms as the tests' arguments need.
def _gamma_p(a: str, x: str) -> str:
    return f"(CASE WHEN ({x}) <= 0 THEN 0 WHEN ({x}) > ({a}) + 40 * sqrt({a}) + 400 THEN 1 ELSE least(1, list_sum(list_transform(range(0, 4000), lambda k: exp(({a} + k) * ln({x}) - ({x}) - lgamma({a} + k + 1))))) END)"


def _normal(z: str) -> str:
    return f"(0.5 + sign({z}) * {_gamma_p('0.5', f'({z}) * ({z}) / 2')} / 2)"


def _beta_i(x: str, a: str, b: str) -> str:
    side = lambda x, a, b: f"(CASE WHEN ({x}) <= 0 THEN 0 ELSE list_sum(list_transform(range(0, 4000), lambda k: exp(({a} + k) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma({a} + {b} + k) - lgamma({a} + k + 1) - lgamma({b})))) END)"
    return f"(CASE WHEN ({x}) > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {side(f'1 - ({x})', b, a)} ELSE {side(x, a, b)} END)"


def _student(t: str, df: str) -> str:
    y = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    return f"(0.5 + sign({t}) / 2 * (CASE WHEN ({t}) = 0 THEN 0 ELSE list_sum(list_transform(range(0, 4000), lambda k: exp((0.5 + k) * ln({y}) + ({df}) / 2 * ln(1 - {y}) + lgamma(0.5 + ({df}) / 2 + k) - lgamma(1.5 + k) - lgamma(({df}) / 2)))) END))"


def _tails(cdf: str) -> str:
    return f"round(least(1, 2 * least({cdf}, 1 - {cdf})), 6) AS both, round({cdf}, 6) AS left, round(1 - {cdf}, 6) AS right"


_P = ("both", "left", "right")
_EVENTS = "x AS (SELECT event_type, value AS x, extract('hour' FROM ts) < 12 AS first FROM events WHERE value IS NOT NULL AND isfinite(value))"
_TWO = "two AS (SELECT event_type, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, avg(x) FILTER (first) AS m1, avg(x) FILTER (NOT first) AS m2, var_samp(x) FILTER (first) AS v1, var_samp(x) FILTER (NOT first) AS v2 FROM x GROUP BY ALL)"


def _morning() -> F.Column:
    return F.hour("ts") < 12


@query(f"""WITH {_EVENTS}, m AS (SELECT event_type, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY ALL)
    SELECT event_type, count(*) AS n, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance, round(avg(pow((x - m) / s, 3)), 6) AS skewness, round(avg(pow((x - m) / s, 4)) - 3, 6) AS kurtosis, round(avg(abs(x - m)), 6) AS adev
    FROM x JOIN m USING (event_type) GROUP BY ALL""")
def sample_moments(t: Tables) -> DataFrame:
    """2.14 moments, mean absolute deviation"""
    return _rounded(st.moments(t.events, ("event_type",), F.col("value")), "mean", "variance", "skewness", "kurtosis", "adev")


@query("SELECT lang, round(median(n_chars), 6) AS p50, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY ALL")
def sample_percentiles(t: Tables) -> DataFrame:
    """2.14 median, percentile (linear between neighbours)"""
    return t.documents.groupBy("lang").agg(r6(F.percentile("n_chars", 0.5), "p50"), r6(F.percentile("n_chars", 0.05), "p05"), r6(F.percentile("n_chars", 0.99), "p99"))


@query(f"WITH {_EVENTS}, a AS (SELECT event_type, count(*) AS n, (avg(x) - 50) * sqrt(count(*)) / stddev_samp(x) AS t, (count(*) - 1)::DOUBLE AS df FROM x GROUP BY ALL) SELECT event_type, n, round(t, 6) AS t, df, {_tails(_student('t', 'df'))} FROM a")
def t_test_one_sample(t: Tables) -> DataFrame:
    """2.14 t-test of a mean"""
    return _rounded(st.t_one(t.events, ("event_type",), F.col("value"), 50.0), "t", *_P)


@query(f"""WITH {_EVENTS}, {_TWO}, a AS (SELECT event_type, n1, n2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM two)
    SELECT event_type, n1, n2, round(t, 6) AS t, df, {_tails(_student('t', 'df'))} FROM a""")
def t_test_pooled(t: Tables) -> DataFrame:
    """2.14 t-test of two means, equal variances"""
    return _rounded(st.t_two(t.events, ("event_type",), F.col("value"), _morning(), True), "t", *_P)


@query(f"""WITH {_EVENTS}, {_TWO}, a AS (SELECT event_type, n1, n2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM two)
    SELECT event_type, n1, n2, round(t, 6) AS t, round(df, 6) AS df, {_tails(_student('t', 'df'))} FROM a""")
def t_test_unequal(t: Tables) -> DataFrame:
    """2.14 t-test of two means, unequal variances"""
    return _rounded(st.t_two(t.events, ("event_type",), F.col("value"), _morning(), False), "t", "df", *_P)


@query(f"WITH {_EVENTS}, {_TWO}, a AS (SELECT event_type, n1, n2, v1 / v2 AS f, (n1 - 1)::DOUBLE AS d1, (n2 - 1)::DOUBLE AS d2 FROM two) SELECT event_type, n1, n2, round(f, 6) AS f, {_tails(_beta_i('d1 * f / (d1 * f + d2)', 'd1 / 2', 'd2 / 2'))} FROM a")
def f_test_variances(t: Tables) -> DataFrame:
    """2.14 F-test of two variances"""
    return _rounded(st.f_test(t.events, ("event_type",), F.col("value"), _morning()), "f", *_P)


@query(f"WITH {_EVENTS}, a AS (SELECT event_type, count(*) AS n, (count(*) - 1) * var_samp(x) / 2500 AS chi2 FROM x GROUP BY ALL) SELECT event_type, n, round(chi2, 6) AS chi2, {_tails(_gamma_p('(n - 1) / 2', 'chi2 / 2'))} FROM a")
def variance_test(t: Tables) -> DataFrame:
    """2.14 chi-squared test of a variance"""
    return _rounded(st.variance_test(t.events, ("event_type",), F.col("value"), 2500.0), "chi2", *_P)


@query("""WITH x AS (SELECT l_linestatus, l_extendedprice::DOUBLE AS x FROM lineitem), m AS (SELECT l_linestatus, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY ALL),
    a AS (SELECT l_linestatus, count(*) AS n, count(*) / 6 * (pow(avg(pow((x - m) / s, 3)), 2) + pow(avg(pow((x - m) / s, 4)) - 3, 2) / 4) AS jb FROM x JOIN m USING (l_linestatus) GROUP BY ALL)
    SELECT l_linestatus, n, round(jb, 4) AS jb, round(exp(-jb / 2), 6) AS p FROM a""")
def jarque_bera(t: Tables) -> DataFrame:
    """2.14 Jarque-Bera test"""
    return st.jarque_bera(t.lineitem, ("l_linestatus",), F.col("l_extendedprice")).select("l_linestatus", "n", F.round("jb", 4).alias("jb"), r6("p", "p"))


@query(f"""WITH x AS (SELECT l_linestatus, l_quantity::DOUBLE AS x, l_returnflag = 'R' AS first FROM lineitem WHERE l_returnflag IN ('A', 'R')),
    r AS (SELECT *, rank() OVER (PARTITION BY l_linestatus ORDER BY x) + (count(*) OVER (PARTITION BY l_linestatus, x) - 1) / 2 AS rank, count(*) OVER (PARTITION BY l_linestatus, x)::DOUBLE AS tie FROM x),
    s AS (SELECT l_linestatus, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, sum(rank) FILTER (first) AS ranks, sum(tie * tie - 1) AS cubes FROM r GROUP BY ALL),
    a AS (SELECT l_linestatus, n1, n2, ranks - n1 * (n1 + 1) / 2 AS u, (ranks - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - cubes / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s)
    SELECT l_linestatus, n1, n2, u, round(z, 6) AS z, {_tails(_normal('z'))} FROM a""")
def mann_whitney(t: Tables) -> DataFrame:
    """2.14 Mann-Whitney test, midranks of ties"""
    first = F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_returnflag") == "R")
    return _rounded(st.mann_whitney(t.lineitem, ("l_linestatus",), F.col("l_quantity"), first), "z", *_P)


_WILCOXON = """r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2 AS rank, count(*) OVER (PARTITION BY g, abs(d))::DOUBLE AS tie FROM x),
    s AS (SELECT g, count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w, sum(tie * tie - 1) AS cubes FROM r GROUP BY ALL),
    a AS (SELECT g, n, w, (w - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - cubes / 48) AS z FROM s)"""


@query(f"WITH x AS (SELECT l_linestatus AS g, l_quantity::DOUBLE - 25.0::DOUBLE AS d FROM lineitem WHERE l_quantity <> 25), {_WILCOXON} SELECT g AS l_linestatus, n, w, round(z, 6) AS z, {_tails(_normal('z'))} FROM a")
def wilcoxon_signed_rank(t: Tables) -> DataFrame:
    """2.14 Wilcoxon signed-rank test, midranks of ties"""
    return _rounded(st.wilcoxon(t.lineitem, ("l_linestatus",), F.col("l_quantity"), 25.0), "z", *_P)


@query(f"""WITH a AS (SELECT event_type, count(*) FILTER (value > 50) AS above, count(*) FILTER (value < 50) AS below FROM events GROUP BY ALL),
    b AS (SELECT *, above + below AS n, least(above, below) AS low FROM a), c AS (SELECT *, {_beta_i("0.5::DOUBLE", "(n - low)::DOUBLE", "(low + 1)::DOUBLE")} AS tail,
    {_beta_i("0.5::DOUBLE", "(n - above)::DOUBLE", "(above + 1)::DOUBLE")} AS l, {_beta_i("0.5::DOUBLE", "(n - below)::DOUBLE", "(below + 1)::DOUBLE")} AS r FROM b)
    SELECT event_type, above, below, round(least(1, 2 * tail), 6) AS both, round(l, 6) AS left, round(r, 6) AS right FROM c""")
def sign_test(t: Tables) -> DataFrame:
    """2.14 sign test of a median"""
    return _rounded(st.sign_test(t.events, ("event_type",), F.col("value"), 50.0), *_P)


@query("""WITH v AS (SELECT vec_id, unnest(range(0, len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT a.k::INTEGER AS i, b.k::INTEGER AS j, count(*) AS n, round(covar_samp(a.x, b.x), 6) AS cov, round(corr(a.x, b.x), 6) AS pearson FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY ALL""")
def covariance_matrix(t: Tables) -> DataFrame:
    """2.14 covariance and Pearson matrices of all pairs of embedding dimensions"""
    return _rounded(st.covariances(t.embeddings, F.col("embedding")), "cov", "pearson")


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(f"""WITH l AS (SELECT row_number() OVER () AS id, * FROM lineitem), v AS (SELECT id, unnest(range(0, 5)) AS k, unnest([{', '.join(f'{c}::DOUBLE' for c in _COLUMNS)}]) AS x FROM l),
    r AS (SELECT id, k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2 AS r FROM v),
    c AS (SELECT a.k::INTEGER AS i, b.k::INTEGER AS j, count(*) AS n, corr(a.r, b.r) AS s FROM r a JOIN r b ON a.id = b.id AND a.k < b.k GROUP BY ALL),
    d AS (SELECT *, s * sqrt((n - 2) / (1 - s * s)) AS t, (n - 2)::DOUBLE AS df FROM c)
    SELECT i, j, n, round(s, 6) AS spearman, round(t, 4) AS t, {_tails(_student('t', 'df'))} FROM d""")
def spearman_matrix(t: Tables) -> DataFrame:
    """2.14 Spearman matrix of midranks, with the significance of each coefficient"""
    got = st.significance(st.spearman(t.lineitem, _COLUMNS).filter("i < j"), "spearman")
    return got.select("i", "j", "n", r6("spearman", "spearman"), F.round("t", 4).alias("t"), *[r6(c, c) for c in _P])


@query(f"""WITH d AS (SELECT event_type AS stream, date_trunc('day', ts) AS day, avg(value) AS x FROM events GROUP BY ALL),
    c AS (SELECT a.stream AS a, b.stream AS b, count(*) AS n, corr(a.x, b.x) AS r FROM d a JOIN d b ON a.day = b.day AND a.stream < b.stream GROUP BY ALL),
    e AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS df FROM c) SELECT a, b, n, round(r, 6) AS r, round(t, 6) AS t, {_tails(_student('t', 'df'))} FROM e""")
def correlation_significance(t: Tables) -> DataFrame:
    """2.14 Pearson correlation of the daily means of two streams, with its significance"""
    d = t.events.groupBy(F.col("event_type").alias("stream"), F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("x"))
    pairs = d.select(F.col("stream").alias("a"), "day", F.col("x").alias("x")).join(d.select(F.col("stream").alias("b"), "day", F.col("x").alias("y")), "day").filter("a < b")  # streams of a day are few
    got = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
    return _rounded(st.significance(got, "r"), "r", "t", *_P)
