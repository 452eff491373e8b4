"""Special functions as Columns: log-gamma and its derivatives, tails of the normal and of Student's t; Gauss 2F1."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Lanczos coefficients for g = 7, n = 9 (published table).
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """Natural log of the gamma function for positive ``x``."""
    z = x - F.lit(1.0)
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + F.lit(float(i)))
    t = z + F.lit(LANCZOS_G + 0.5)
    return (
        F.lit(0.5 * math.log(2 * math.pi)) + (z + F.lit(0.5)) * F.ln(t) - t + F.ln(series)
    )


# Terms of the asymptotic series of digamma, and of its derivative: Bernoulli numbers over their place.
_DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
_TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)
# Both series are read this far above their argument, where six terms leave nothing.
_ABOVE = 8


def digamma(x: Column) -> Column:
    """First derivative of ``lgamma`` for positive ``x``."""
    y = x + F.lit(float(_ABOVE))
    square = F.lit(1.0) / (y * y)
    series = F.lit(0.0)
    for c in reversed(_DIGAMMA):
        series = (series + F.lit(c)) * square
    below = sum((F.lit(1.0) / (x + F.lit(float(i))) for i in range(_ABOVE)), F.lit(0.0))
    return F.ln(y) - F.lit(0.5) / y + series - below


def trigamma(x: Column) -> Column:
    """Second derivative of ``lgamma`` for positive ``x``."""
    y = x + F.lit(float(_ABOVE))
    square = F.lit(1.0) / (y * y)
    series = F.lit(0.0)
    for c in reversed(_TRIGAMMA):
        series = (series + F.lit(c)) * square
    below = sum((F.lit(1.0) / ((x + F.lit(float(i))) * (x + F.lit(float(i)))) for i in range(_ABOVE)), F.lit(0.0))
    return F.lit(1.0) / y + F.lit(0.5) * square + series / y + below


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


# Nodes and weights of Gauss' rule on eight points, on sixteen panels of the interval from 0 to 1.
_PANELS = 16
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(8)
_RULE = [((i + (x + 1) / 2) / _PANELS, w / 2 / _PANELS) for i in range(_PANELS) for x, w in zip(_NODES.tolist(), _WEIGHTS.tolist(), strict=True)]


def _integral(f: Callable[[Column], Column], width: Column) -> Column:
    """Integral of ``f`` from 0 to ``width``, for functions that fall smoothly over it."""
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _RULE])
    return width * F.aggregate(nodes, F.lit(0.0), lambda total, n: total + n["w"] * f(n["x"] * width))


def normal_two_sided_p(z: Column) -> Column:
    """P(|Z| > |z|) of the standard normal, to some 13 digits in the tail too."""
    size = F.abs(z)
    # Beyond this the density has fallen by a factor of exp(-40).
    width = F.least(F.lit(9.0), F.lit(40.0) / F.greatest(size, F.lit(1e-9)))
    tail = _integral(lambda y: F.exp(-y * (size + y / 2)), width)
    return F.least(F.exp(-size * size / 2) * tail * F.lit(math.sqrt(2 / math.pi)), F.lit(1.0))


def _half_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)): from ``lgamma``, and by its expansion where both are large."""
    inverse = F.lit(1.0) / a
    square = inverse * inverse
    far = F.lit(0.5) * F.ln(a) - inverse * (F.lit(1 / 8) - square * (F.lit(1 / 192) - square * (F.lit(1 / 640) - square * F.lit(17 / 14336))))
    return F.when(a > 30, far).otherwise(lgamma(a + F.lit(0.5)) - lgamma(a))


def student_density(t: Column, df: Column) -> Column:
    ratio = F.lit(1.0) + t * t / df
    return F.exp(_half_step(df / 2) - F.lit(0.5) * F.ln(df * F.lit(math.pi)) - (df + F.lit(1.0)) / 2 * F.ln(ratio))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def student_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t with ``df`` >= 1 degrees of freedom, for any number of these.

    With t = sqrt(df) tan(angle) the tail is the integral of cos(angle) ** (df - 1), taken over angles beyond that of t,
    relative to the value there, as far as it matters.
    """
    root, power = F.sqrt(df), df - F.lit(1.0)

    def tail(k: Column) -> Column:
        slope = k["size"] / root
        fall = F.greatest(k["size"] * power / df, F.lit(1e-9))
        width = F.least(root * (F.lit(math.pi / 2) - F.atan(slope)), F.lit(9.0) + F.lit(40.0) / root, F.lit(40.0) / fall)

        def density(y: Column) -> Column:
            # cos(angle + h) / cos(angle) = 1 - 2 sin(h / 2) ** 2 - slope sin(h)
            half = F.sin(y / root / 2)
            less = F.lit(2.0) * half * half + slope * F.sin(y / root)
            return F.exp(power * F.log1p(-F.least(less, F.lit(1 - 1e-16))))

        scale = F.exp(_half_step(df / 2) - power / 2 * F.log1p(slope * slope)) * F.lit(2.0 / math.sqrt(math.pi)) / root
        area = _let(width, lambda w: _integral(density, w))
        return F.when(k["size"] == 0, F.lit(1.0)).otherwise(F.least(scale * area, F.lit(1.0)))

    return _let(F.struct(F.abs(t).alias("size")), tail)


def student_quantile(p: float, df: Column, steps: int = 30) -> Column:
    """Quantile for ``p`` > 0.5 and ``df`` >= 1, by Newton's steps on the logarithm of the tail; an error if these do
    not end there."""
    tail = 2.0 * (1.0 - p)

    def looked_at(t: Column) -> Column:
        return F.struct(t.alias("t"), student_two_sided_p(t, df).alias("p"))

    def step(at: Column) -> Column:
        moved = at["t"] + at["p"] * F.ln(at["p"] / F.lit(tail)) / (F.lit(2.0) * student_density(at["t"], df))
        return _let(F.least(F.greatest(moved, at["t"] / 2), at["t"] * 2), looked_at)

    start = looked_at(F.lit(normal_quantile(p)))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda at, _: step(at))
    wrong = F.raise_error(F.lit("no convergence of the quantile of Student's t")).cast("double")
    return _let(found, lambda at: F.when(df.isNull(), F.lit(None)).when(F.abs(at["p"] - F.lit(tail)) <= 1e-10 * tail, at["t"]).otherwise(wrong))


def hyp2f1_array(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Gauss hypergeometric series for 0 <= z < 1, summed until the terms vanish."""
    term = np.ones_like(z)
    total = np.ones_like(z)
    active = np.ones_like(z, dtype=bool)
    for n in range(200_000):
        term = np.where(active, term * (a + n) * (b + n) / ((c + n) * (n + 1.0)) * z, 0.0)
        total = total + term
        active = active & (np.abs(term) > 1e-13 * np.abs(total))
        if not active.any():
            return total
    raise ArithmeticError("the 2F1 series did not converge; its argument is too near 1")


@F.pandas_udf(DoubleType())
def hyp2f1(a: pd.Series, b: pd.Series, c: pd.Series, z: pd.Series) -> pd.Series:
    args = [s.to_numpy(dtype=float) for s in (a, b, c, z)]
    return pd.Series(hyp2f1_array(*args))
