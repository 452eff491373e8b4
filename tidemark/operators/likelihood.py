"""Maximum likelihood with exact derivatives: each step is one sum over the rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALLEST = 1e-6


class NotConverged(ArithmeticError):
    """The slope was still away from zero when the steps ran out."""


@dataclass(frozen=True)
class Derivatives:
    """A row's log-likelihood with its first and second derivatives by the parameters (upper triangle, zeros left out)."""

    value: Column
    first: Sequence[Column]
    second: Mapping[tuple[int, int], Column]


Parameters = Sequence[float | Column]
Model = Callable[[Parameters], Derivatives]


def as_column(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


class Totals:
    """Weighted sums of a model's likelihood and derivatives over rows, at any parameters.

    The expressions are built once. They read the parameters from columns that each call fills, by a place that depends
    on the row: so the values are no part of the code that is compiled, and steps share it.
    """

    def __init__(self, rows: DataFrame, model: Model, size: int, weight: str):
        self.rows, self.size = rows, size
        self.place = F.pmod(F.col(weight).cast("int"), F.lit(1))
        at = model([F.col(f"param_{i}") for i in range(size)])
        w = F.col(weight).cast("double")
        self.pairs = list(at.second)
        self.sums = [F.sum(w * at.value).alias("value"), F.sum(w).alias("weight")]
        self.sums += [F.sum(w * c).alias(f"d{i}") for i, c in enumerate(at.first)]
        self.sums += [F.sum(w * at.second[i, j]).alias(f"d{i}_{j}") for i, j in self.pairs]

    def at(self, params: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Value, slope and curvature by the parameters, and the weights themselves."""
        held = F.array(*[F.lit(float(p)) for p in params])
        found = self.rows.withColumns({f"param_{i}": F.get(held, self.place + i) for i in range(self.size)}).agg(*self.sums).first()
        slope = np.array([found[f"d{i}"] or 0.0 for i in range(self.size)])
        curve = np.zeros((self.size, self.size))
        for i, j in self.pairs:
            curve[i, j] = curve[j, i] = found[f"d{i}_{j}"] or 0.0
        return found["value"] or 0.0, slope, curve, found["weight"] or 0.0


def totals(rows: DataFrame, model: Model, params: Sequence[float], weight: str) -> tuple[float, np.ndarray, np.ndarray, float]:
    """``Totals`` at one point."""
    return Totals(rows, model, len(params), weight).at(params)


def _step(slope: np.ndarray, curve: np.ndarray, radius: float) -> np.ndarray:
    """Uphill step of at most ``radius``: Newton's where the function bends down, along the slope where it does not."""
    bends, axes = np.linalg.eigh(curve)
    along = axes.T @ slope
    down = np.maximum(-bends, 0.0)
    low, high = 0.0, 1.0

    def at(shift: float) -> np.ndarray:
        size = down + np.maximum(shift, 1e-12 * max(np.abs(bends).max(), 1.0))
        return axes @ (along / size)

    if np.linalg.norm(at(0.0)) <= radius:
        return at(0.0)
    while np.linalg.norm(at(high)) > radius:
        high *= 4.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.linalg.norm(at(mid)) > radius else (low, mid)
    return at(high)


def maximise(
    rows: DataFrame, model: Model, start: Sequence[float], weight: str = "n", steps: int = 200, tolerance: float = 1e-6
) -> np.ndarray:
    """The parameters, all above SMALLEST, at which the likelihood's slope is zero.

    Steps are taken in logs within a trust region. The search ends when the slope per unit of weight is at most
    ``tolerance`` in each log parameter (at SMALLEST, uphill only); when it does not get there, NotConverged says so.
    Without rows the start is returned.
    """
    floor = np.log(SMALLEST)
    at = np.log(np.asarray(start, dtype=float))
    sums = Totals(rows, model, len(start), weight)

    def look(u: np.ndarray):
        params = np.exp(u)
        value, slope, curve, n = sums.at([float(p) for p in params])
        return value, slope * params, curve * np.outer(params, params) + np.diag(slope * params), n

    value, slope, curve, n = look(at)
    if n == 0:
        return np.exp(at)
    radius, left = 1.0, np.inf
    for _ in range(steps):
        free = (at > floor) | (slope > 0)
        left = np.abs(slope[free]).max(initial=0.0) / n
        if left <= tolerance:
            return np.exp(at)
        step = np.zeros(len(at))
        step[free] = _step(slope[free] / n, curve[np.ix_(free, free)] / n, radius)
        to = np.maximum(at + step, floor)
        moved = to - at
        hoped = (slope @ moved + moved @ curve @ moved / 2) / n
        new = look(to)
        gained = (new[0] - value) / n
        noise = 1e-13 * (abs(value) / n + 1.0)
        better = gained > 0 or (gained > -noise and np.abs(new[1]).max() < np.abs(slope).max())
        good = better and (gained >= 0.25 * hoped or abs(gained) <= noise)
        radius = min(radius * 2, 8.0) if good else max(min(radius, np.linalg.norm(moved)) / 4, 1e-12)
        if better:
            at, (value, slope, curve, n) = to, new
    raise NotConverged(f"slope {left:.3g} per row after {steps} steps, at {np.exp(at).tolist()}")
