"""Splines, fits, convolution and transforms against numpy on series that cross ranges, chunks and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcount.operators import fit, signal


def natural(x, y):
    n = len(x)
    h = np.diff(x)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    return np.linalg.solve(a, r)


def test_interpolation(spark, monkeypatch):
    monkeypatch.setattr(fit, "CHUNK", 150)
    rng = np.random.default_rng(2)
    rows, known = [], {}
    for s, n in (("a", 900), ("b", 40), ("c", 3), (None, 7)):
        x = np.cumsum(rng.uniform(0.1, 3, n))
        y = np.where(rng.random(n) < 0.3, None, rng.standard_normal(n))
        rows += [(s, float(p), v) for p, v in zip(x, y)]
        known[s] = [(p, v) for p, v in zip(x, y) if v is not None]
    rows += [("empty", 1.0, None), ("empty", 2.0, None), ("one", 1.0, 5.0), ("one", 4.0, None)]
    df = spark.createDataFrame(rows, "s string, x double, y double").selectExpr("*", "1 as before_", "'k' as m")
    straight = {(r["s"], r["x"]): r["f"] for r in fit.linear(df, ("s",), "x", "y", "f").collect()}
    curve = {(r["s"], r["x"]): r["f"] for r in fit.cubic(df, ("s",), "x", "y", "f").collect()}
    assert len(straight) == len(curve) == len(rows)
    assert straight["empty", 1.0] is None and curve["empty", 2.0] is None and straight["one", 4.0] == curve["one", 4.0] == 5.0
    for s, k in known.items():
        kx, ky = (np.array([p[i] for p in k], float) for i in (0, 1))
        m = natural(kx, ky) if len(k) > 2 else np.zeros(len(k))
        for g, x, v in rows:
            if g != s or not len(k):
                continue
            assert straight[s, x] == pytest.approx(np.interp(x, kx, ky), abs=1e-9)
            want = v
            if v is None:
                i = np.searchsorted(kx, x)
                if 0 < i < len(kx):
                    h = kx[i] - kx[i - 1]
                    a, b = (kx[i] - x) / h, (x - kx[i - 1]) / h
                    want = a * ky[i - 1] + b * ky[i] + ((a**3 - a) * m[i - 1] + (b**3 - b) * m[i]) * h * h / 6
                else:
                    want = ky[0] if i == 0 else ky[-1]
            assert curve[s, x] == pytest.approx(want, abs=1e-8)


def test_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 3)) * [1, 10, 1] + [1e6, 0, 5]
    y = 3 + x @ [2, -1, 0.5] + rng.standard_normal(500)
    rows = [("g", *map(float, r), float(v)) for r, v in zip(x, y)] + [("flat", 1.0, 1.0, 1.0, 2.0)] * 3 + [("g", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double")
    got = {r["g"]: r for r in fit.least_squares(df, ("g",), F.col("y"), [F.col("a"), F.col("b"), F.col("c")]).collect()}
    assert got["g"]["n"] == 500 and got["flat"]["slopes"] == [0, 0, 0] and got["flat"]["intercept"] == 2 and got["flat"]["r2"] is None
    rest = y - got["g"]["intercept"] - x @ got["g"]["slopes"]
    assert np.abs((x - x.mean(0)).T @ rest).max() < 1e-3 and got["g"]["rss"] == pytest.approx(rest @ rest, rel=1e-6)  # residuals are orthogonal to the variables
    less = fit.least_squares(df.filter("g = 'g'"), (), F.col("y"), [F.col("a")], ridge=1e9).first()
    assert abs(less["slopes"][0]) < 1e-5
    curve = fit.polynomial(df.filter("g = 'g'"), (), F.col("b"), F.pow("b", 3) - F.col("b"), 3).first()
    assert curve["r2"] == pytest.approx(1)


def test_convolution_and_correlation(spark, monkeypatch):
    monkeypatch.setattr(signal, "BLOCK", 37)
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((2, 400))
    gaps = rng.random(400) < 0.2
    kernel = rng.standard_normal(90)
    df = spark.createDataFrame([("s", t, float(a), float(b)) for t, (a, b, g) in enumerate(zip(x, y, gaps)) if not g] + [("short", -5, 2.0, 1.0)], "s string, t long, x double, y double")
    dense = np.where(gaps, 0, x)
    for fft in (True, False):
        got = signal.convolve(df, ("s",), "t", "x", kernel.tolist(), fft).collect()
        own = {r["t"]: r["x"] for r in got if r["s"] == "s"}
        want = np.convolve(dense, kernel)
        assert [own.get(t, 0.0) for t in range(len(want))] == pytest.approx(want.tolist(), abs=1e-9)
        assert {r["t"]: r["x"] for r in got if r["s"] == "short"} == pytest.approx({k - 5: 2 * w for k, w in enumerate(kernel)})
    other = np.where(gaps, 0, y)
    for lags in (0, 5, 36):
        got = {r["lag"]: r["value"] for r in signal.cross_correlation(df.filter("s = 's'"), (), "t", "x", "y", lags).collect()}
        assert sorted(got) == list(range(-lags, lags + 1))
        for lag, v in got.items():
            assert v == pytest.approx(sum(dense[t] * other[t + lag] for t in range(400) if 0 <= t + lag < 400), abs=1e-9)


def test_fourier(spark):
    rng = np.random.default_rng(5)
    for size in (1, 2, 128, 512):
        x = rng.standard_normal(min(size, 300))
        df = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(x)], "s string, t long, x double")
        got = signal.fourier(df, ("s",), "t", "x", size)
        z = np.zeros(size, complex)
        for r in got.collect():
            z[r["k"]] = r["re"] + 1j * r["im"]
        assert np.abs(z - np.fft.fft(x, size)).max() < 1e-9
    back = {r["k"]: r["re"] for r in signal.fourier(got, ("s",), "k", "re", size, True, "im").collect()}
    assert [back[t] for t in range(300)] == pytest.approx(x.tolist())  # there and back
