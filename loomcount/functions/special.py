"""Special functions and densities as column expressions (F15-F24): no Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b); a null argument stands for the logarithm of zero."""
    both = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def log_subtract(a: Column, b: Column) -> Column:
    """ln(e^a - e^b), null where that is not positive."""
    return F.when(a > b, a + F.log(-F.expm1(F.when(a > b, b - a).otherwise(F.lit(-1.0)))))


def log_to_prob(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def log_to_perplexity(x: Column) -> Column:
    return F.pow(F.lit(10.0), -x)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def lgamma(x: Column, shift: int = 9) -> Column:
    """ln of the gamma function for x > 0: recurrence up by `shift`, then Stirling's series."""
    z = x + shift
    product = x
    for k in range(1, shift):
        product = product * (x + k)
    inv = 1 / z
    series = inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv * (1 / 1260 - inv * inv * (1 / 1680 - inv * inv / 1188))))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def digamma(x: Column, shift: int = 7) -> Column:
    """Derivative of lgamma for x > 0: recurrence up by `shift`, then the asymptotic series."""
    z = x + shift
    below = 1 / x
    for k in range(1, shift):
        below = below + 1 / (x + k)
    inv2 = 1 / (z * z)
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return F.log(z) - 0.5 / z - series - below


def log_factorial(n: Column) -> Column:
    return lgamma(n + 1)


def choose(n: Column, k: Column) -> Column:
    return F.exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0))


def log_beta(x: Column, a: Column, b: Column) -> Column:
    return (a - 1) * F.log(x) + (b - 1) * F.log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)


def log_gamma(x: Column, shape: Column, scale: Column) -> Column:
    return (shape - 1) * F.log(x) - x / scale - lgamma(shape) - shape * F.log(scale)


def log_dirichlet(xs: list[Column], alphas: list[Column]) -> Column:
    total, out = alphas[0], (alphas[0] - 1) * F.log(xs[0]) - lgamma(alphas[0])
    for x, a in zip(xs[1:], alphas[1:], strict=True):
        total, out = total + a, out + (a - 1) * F.log(x) - lgamma(a)
    return out + lgamma(total)


def geometric(n: Column, p: Column) -> Column:
    return F.pow(1 - p, n - 1) * p


def log_geometric(n: Column, p: Column) -> Column:
    return (n - 1) * F.log(1 - p) + F.log(p)


def log_poisson(n: Column, rate: Column) -> Column:
    return n * F.log(rate) - rate - lgamma(n + 1.0)


def gaussian(x: Column, mean: Column, variance: Column) -> Column:
    """The density; the third argument is the variance."""
    return F.exp(-F.pow(x - mean, 2) / (2 * variance)) / F.sqrt(2 * 3.14159 * variance)


def ratio(x: Column, y: Column) -> Column:
    """x / y, with 0 / 0 = 1 and x / 0 = 0."""
    return F.when(y != 0, x / F.nullif(y, F.lit(0))).when(x == 0, 1.0).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bound(f, /, **values: Column) -> Column:
    """f of a struct of the values, each of them evaluated once however often f uses it."""
    box = F.array(F.struct(*[c.cast("double").alias(name) for name, c in values.items()]))
    return F.get(F.transform(box, f), F.lit(0))


def _series(terms: Column, first: dict[str, Column], factor) -> Column:
    """1 and the sum of so many more terms, each the one before times factor(constants, k), k = 1, 2, ..."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), *[c.alias(name) for name, c in first.items()])

    def add(s: Column, k: Column) -> Column:
        grown = s["term"] * factor(s, k)
        return F.struct(grown.alias("term"), (s["sum"] + grown).alias("sum"), *[s[name].alias(name) for name in first])

    return F.aggregate(F.sequence(F.lit(1), F.ceil(terms).cast("int")), start, add)["sum"]


def gamma_p(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function for a > 0, x >= 0: the series of positive terms, as many as the arguments ask for; 1 far beyond a."""

    def value(v: Column) -> Column:
        a, x = v["a"], v["x"]
        total = _series(200 + 20 * F.sqrt(x) + 3 * F.greatest(x - a, F.lit(0.0)), {"a": a, "x": x}, lambda s, k: s["x"] / (s["a"] + k))
        inside = F.least(F.lit(1.0), total * F.exp(a * F.log(x) - x - lgamma(a + 1)))
        return F.when(x <= 0, 0.0).when(x > a + 40 * F.sqrt(a) + 400, 1.0).when(x > 0, inside)

    return bound(value, a=a, x=x)


def normal_cdf(z: Column) -> Column:
    return bound(lambda v: 0.5 + F.signum(v["z"]) * gamma_p(F.lit(0.5), v["z"] * v["z"] / 2) / 2, z=z)


def chi2_cdf(x: Column, df: Column) -> Column:
    return gamma_p(df / 2, x / 2)


def _beta_terms(x: Column, a: Column, b: Column) -> Column:
    """About how many terms the series of the incomplete beta function takes: those up to its largest one, then until they fade. m terms beyond the largest one they have fallen by
    exp((1 - x) m^2 / (2 (a + over + m))) at least; a series that falls from its start on falls by its first ratio at least."""
    rest = F.greatest(1 - x, F.lit(1e-300))
    over = F.greatest(x * (a + b) - a, F.lit(0.0)) / rest
    near = 80 / rest + F.sqrt(80 / rest * (a + over))
    fade = F.when(over <= 0, 40 / F.greatest(1 - F.greatest(x, x * (a + b) / a), F.lit(1e-300)))
    return F.when(over > 1_000, 1e18).otherwise(over + F.least(near, fade))


def beta_i(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function for 0 <= x <= 1, null unless a, b > 0: a series of positive terms for x or for 1 - x, whichever takes fewer."""

    def side(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]
        total = _series(30 + 1.5 * v["terms"], {"a": a, "b": b, "x": x}, lambda s, k: s["x"] * (s["a"] + s["b"] + k - 1) / (s["a"] + k))
        half = (a * F.log(x) + b * F.log1p(-x) + lgamma(a + b) - lgamma(a + 1) - lgamma(b)) / 2
        inside = bound(lambda w: F.least(F.lit(1.0), F.exp(w["half"]) * w["total"] * F.exp(w["half"])), half=half, total=total)
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < 1, inside)

    def value(v: Column) -> Column:
        x, a, b, turn = v["x"], v["a"], v["b"], v["other"] < v["own"]
        pick = lambda y, z: F.when(turn, y).otherwise(z)
        got = bound(side, x=pick(1 - x, x), a=pick(b, a), b=pick(a, b), terms=F.least(v["own"], v["other"]))
        return bound(lambda w: F.when(w["turn"] > 0, 1 - w["got"]).otherwise(w["got"]), turn=turn.cast("int"), got=got)

    return bound(lambda v: bound(value, x=v["x"], a=v["a"], b=v["b"], own=_beta_terms(v["x"], v["a"], v["b"]), other=_beta_terms(1 - v["x"], v["b"], v["a"])), x=x, a=F.when(a > 0, a), b=F.when(b > 0, b))


def student_cdf(t: Column, df: Column) -> Column:
    def value(v: Column) -> Column:
        return bound(lambda w: F.when(w["t"] < 0, w["tail"]).otherwise(1 - w["tail"]), t=v["t"], tail=beta_i(v["df"] / (v["df"] + v["t"] * v["t"]), v["df"] / 2, F.lit(0.5)) / 2)

    return bound(value, t=t, df=F.when(df > 0, df))


def fisher_cdf(f: Column, d1: Column, d2: Column) -> Column:
    return bound(lambda v: beta_i(v["d1"] * v["f"] / (v["d1"] * v["f"] + v["d2"]), v["d1"] / 2, v["d2"] / 2), f=f, d1=d1, d2=d2)


def binomial_cdf(k: Column, n: Column) -> Column:
    """Of n throws of a fair coin, at most k heads."""
    inside = lambda v: beta_i(F.lit(0.5), F.greatest(v["n"] - v["k"], F.lit(1.0)), F.greatest(v["k"] + 1, F.lit(1.0)))
    return bound(lambda v: F.when(v["k"] >= v["n"], 1.0).when(v["k"] < 0, 0.0).otherwise(inside(v)), k=k, n=n)
