"""Convolution, cross-correlation and Fourier transform of signals (survey 2.14).

A signal are rows (by, t, x), t integer, places without a row are zero. It is cut into blocks of BLOCK places, whatever its length: convolution adds the blocks' overlapping
partial results, correlation sums partial products by lag, and the transform of N = N1 * N2 places is made of N2 transforms of N1 strided places, a turn, and N1 transforms of N2 values (the four-step form), so that a
task holds about sqrt(N) values at once. Blocks are transformed by numpy's FFT where that is cheaper than the direct sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, KERNEL = 8_192, 1 << 16


def _schema(df: DataFrame, by: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)


def convolve(df: DataFrame, by: tuple[str, ...], t: str, x: str, kernel: list[float], fft: bool | None = None) -> DataFrame:
    """by, t, x: at t the sum over k of kernel[k] times the signal at t - k, for all t that a row of the signal reaches. The kernel has KERNEL places at most; fft: force or forbid the transform."""
    if not 0 < len(kernel) <= KERNEL:
        raise ValueError(f"a kernel has 1 to {KERNEL} places")
    rows = df.select(*by, F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x")).dropna(subset=["t", "x"])
    rows = rows.withColumn("_block", F.floor(F.col("t") / BLOCK))
    use_fft = len(kernel) > 64 if fft is None else fft

    def partial(part):
        import numpy as np
        import pandas as pd

        start, k = int(part["t"].min()), np.array(kernel)
        at = (part["t"] - start).to_numpy()
        dense, here = np.zeros(at.max() + 1), np.zeros(at.max() + 1)
        np.add.at(dense, at, part["x"].to_numpy())
        here[at] = 1
        n = len(dense) + len(k) - 1
        made = np.fft.irfft(np.fft.rfft(dense, n) * np.fft.rfft(k, n), n) if use_fft else np.convolve(dense, k)
        reached = np.cumsum(np.concatenate([here, np.zeros(len(k) - 1)]))
        reached[len(k) :] -= reached[: -len(k)].copy() if n > len(k) else 0
        some = np.flatnonzero(reached > 0.5)
        return pd.DataFrame({c: part[c].iloc[0] for c in by} | {"t": start + some, "x": made[some]})

    made = rows.groupBy(*by, "_block").applyInPandas(partial, _schema(df, by) + "t long, x double")
    return made.groupBy(*by, "t").agg(F.sum("x").alias("x"))


def cross_correlation(df: DataFrame, by: tuple[str, ...], t: str, x: str, y: str, lags: int) -> DataFrame:
    """by, lag, value: the sum over t of x(t) y(t + lag), for lags from -lags to lags. One row for each t of a group; nulls count as zero."""
    if not 0 <= lags <= BLOCK:
        raise ValueError(f"at most {BLOCK} lags")
    rows = df.select(*by, F.col(t).cast("long").alias("t"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in ((x, "x"), (y, "y"))])
    home = F.floor(F.col("t") / BLOCK)
    low, high = F.floor((F.col("t") - lags) / BLOCK), F.floor((F.col("t") + lags) / BLOCK)
    rows = rows.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(low, high)))

    def partial(part):
        import numpy as np
        import pandas as pd

        own = (part["_home"] == part["_block"]).to_numpy()
        start = int(part["_block"].iloc[0]) * BLOCK
        at = (part["t"] - start).to_numpy()
        a, b = np.zeros(BLOCK), np.zeros(BLOCK + 2 * lags)
        np.add.at(a, at[own], part["x"].to_numpy()[own])
        np.add.at(b, at + lags, part["y"].to_numpy())
        return pd.DataFrame({c: part[c].iloc[0] for c in by} | {"lag": np.arange(-lags, lags + 1), "value": np.correlate(b, a, "valid")})

    made = rows.groupBy(*by, "_block").applyInPandas(partial, _schema(df, by) + "lag long, value double")
    return made.groupBy(*by, "lag").agg(F.sum("value").alias("value"))


def fourier(df: DataFrame, by: tuple[str, ...], t: str, x: str, size: int, inverse: bool = False, imaginary: str | None = None) -> DataFrame:
    """by, k, re, im for k below `size` (a power of two): the sum over t from 0 to size - 1 of (x + i * imaginary) e^(-2 pi i k t / size); inverse: e^(+...), divided by size."""
    if size < 1 or size & (size - 1):
        raise ValueError("the size is a power of two")
    n1 = 1 << (size.bit_length() // 2)
    n2 = size // n1
    rows = df.select(*by, F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("re"), (F.col(imaginary).cast("double") if imaginary else F.lit(0.0)).alias("im"))
    rows = rows.filter(F.col("t").between(0, size - 1)).fillna(0.0, ["re", "im"])
    sign = 1 if inverse else -1

    def transformed(part, place, length):
        import numpy as np

        z = np.zeros(length, dtype=complex)
        np.add.at(z, part[place].to_numpy(), part["re"].to_numpy() + 1j * part["im"].to_numpy())
        return np.fft.ifft(z) if inverse else np.fft.fft(z)

    def columns(part):
        import numpy as np
        import pandas as pd

        t2 = int(part["t2"].iloc[0])
        z = transformed(part, "t1", n1) * np.exp(sign * 2j * np.pi * np.arange(n1) * t2 / size)
        return pd.DataFrame({c: part[c].iloc[0] for c in by} | {"k1": np.arange(n1), "t2": t2, "re": z.real, "im": z.imag})

    def rows_(part):
        import numpy as np
        import pandas as pd

        z = transformed(part, "t2", n2)
        return pd.DataFrame({c: part[c].iloc[0] for c in by} | {"k": int(part["k1"].iloc[0]) + n1 * np.arange(n2), "re": z.real, "im": z.imag})

    placed = rows.withColumn("t1", F.expr(f"t div {n2}L")).withColumn("t2", F.expr(f"t % {n2}L"))
    turned = placed.groupBy(*by, "t2").applyInPandas(columns, _schema(df, by) + "k1 long, t2 long, re double, im double")
    return turned.groupBy(*by, "k1").applyInPandas(rows_, _schema(df, by) + "k long, re double, im double")
