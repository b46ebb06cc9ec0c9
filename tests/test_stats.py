"""Distribution functions against numeric integration and exact sums; tests and matrices on groups with ties, nulls and no spread."""

import math
import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcount.functions import special as sp
from loomcount.operators import stats as st


def integral(f, a, z, n=200_001):
    x = np.linspace(a, z, n)
    y = f(x)
    return float((y[:-1] + y[1:]).sum() / 2 * (x[1] - x[0]))


def test_distributions(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    want, columns = [], []
    for z in (-3.2, -1.0, 0.0, 0.3, 2.5, 40.0):
        want.append(0.5 * math.erfc(-z / math.sqrt(2)))
        columns.append(sp.normal_cdf(*lit(z)))
    for t, df in ((-2.1, 7), (0.4, 1), (1.9, 300), (3.0, 200_000)):
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        want.append(0.5 + integral(lambda x: scale * np.exp(-(df + 1) / 2 * np.log1p(x * x / df)), 0, t))
        columns.append(sp.student_cdf(*lit(t, df)))
    for x, df in ((0.0, 3), (2.5, 4), (90.0, 100), (5_100.0, 5_000), (1e6, 10)):
        scale = math.lgamma(df / 2) + df / 2 * math.log(2)
        want.append(1.0 if x == 1e6 else integral(lambda v: np.exp((df / 2 - 1) * np.log(np.maximum(v, 1e-300)) - v / 2 - scale), 0, x))
        columns.append(sp.chi2_cdf(*lit(x, df)))
    for f, a, b in ((0.8, 10, 12), (1.3, 400, 900), (5.0, 3, 3)):
        scale = math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)
        want.append(integral(lambda v: np.exp(scale + (a / 2 - 1) * np.log(np.maximum(v, 1e-300)) + (b / 2 - 1) * np.log1p(-v)), 0, a * f / (a * f + b)))
        columns.append(sp.fisher_cdf(*lit(f, a, b)))
    for k, n in ((0, 5), (3, 10), (480, 1_000), (7, 7), (-1, 3)):
        want.append(sum(comb(n, i) for i in range(k + 1)) / 2**n)
        columns.append(sp.binomial_cdf(*lit(k, n)))
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    assert list(got) == pytest.approx(want, abs=2e-6)


def midranks(x):
    x = np.array(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_rank_tests_and_edges(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(rng.randint(0, 6)), rng.random() < 0.4) for _ in range(300)] + [("a", None, True), ("a", float("nan"), False), ("b", 3.0, None), ("one", 2.0, True), ("flat", 1.0, True), ("flat", 1.0, False), (None, 5.0, True), (None, 7.0, False)]
    df = spark.createDataFrame(rows, "g string, v double, first boolean")
    good = [(g, v, f) for g, v, f in rows if v is not None and v == v]
    got = {r["g"]: r for r in st.mann_whitney(df, ("g",), F.col("v"), F.col("first")).collect()}
    for g in ("a", "b", None):
        own = [(v, f) for k, v, f in good if k == g and f is not None]
        ranks = midranks([v for v, _ in own])
        n1 = sum(f for _, f in own)
        assert got[g]["u"] == ranks[[f for _, f in own]].sum() - n1 * (n1 + 1) / 2
    assert got["flat"]["z"] is None and got["one"]["n2"] == 0 and got["one"]["z"] is None
    got = {r["g"]: r for r in st.wilcoxon(df, ("g",), F.col("v"), 3.0).collect()}
    for g in ("a", "b"):
        d = np.array([v - 3 for k, v, _ in good if k == g and v != 3])
        assert got[g]["w"] == midranks(abs(d))[d > 0].sum() and got[g]["n"] == len(d)
    got = {r["g"]: r for r in st.moments(df, ("g",), F.col("v")).collect()}
    assert (got["flat"]["skewness"], got["flat"]["kurtosis"], got["flat"]["adev"]) == (0, 0, 0) and got["one"]["variance"] is None and got[None]["adev"] == 1
    assert {r["g"]: r["t"] for r in st.t_one(df, ("g",), F.col("v"), 2.0).collect()}["flat"] is None
    assert {r["g"] for r in st.t_two(df, ("g",), F.col("v"), F.col("first"), True).collect()} == {"a", "b"}
    assert st.mann_whitney(df.limit(0), ("g",), F.col("v"), F.col("first")).count() == 0


def test_matrices(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3)) + 1e6  # far from zero: sums of squares alone would lose the variance
    x[:, 2] = np.round(x[:, 0] - 1e6, 1)
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([1.0, None, 2.0],), ([float("inf"), 1.0, 1.0],), ([1.0],)], "v array<double>").repartition(5)
    got = {(r["i"], r["j"]): r for r in st.covariances(df, F.col("v")).collect()}
    for i, j in ((0, 0), (0, 1), (0, 2), (1, 2)):
        assert got[i, j]["n"] == 400 and got[i, j]["cov"] == pytest.approx(np.cov(x[:, i], x[:, j])[0, 1], rel=1e-9, abs=1e-9) and got[i, j]["pearson"] == pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1], abs=1e-9)
    wide = df.filter("size(v) = 3").select(*[F.col("v")[k].alias(f"c{k}") for k in range(3)])
    ranks = [midranks(x[:, k]) for k in range(3)]
    got = {(r["i"], r["j"]): r["spearman"] for r in st.spearman(wide, ["c0", "c1", "c2"]).collect()}
    assert got[0, 2] == pytest.approx(np.corrcoef(ranks[0], ranks[2])[0, 1]) and got[0, 1] == pytest.approx(np.corrcoef(ranks[0], ranks[1])[0, 1])
    assert st.covariances(df.limit(0), F.col("v")).count() == 0
