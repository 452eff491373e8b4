"""Exact order statistics without sorting or collecting the data.

A rank is looked up by narrowing: approximate quantiles give a band around it, one
aggregate counts the rows below the band, and the band shrinks until its distinct
values fit a fixed limit. All ranks of all columns share each pass. Only counts and at
most that many values per band reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binning import distinct_edges

VALUE_LIMIT = 50_000
ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY

Ranks = Callable[[int], Sequence[int]]


@dataclass(frozen=True)
class Point:
    """A value with the number of rows below it and equal to it."""

    value: float
    below: int
    equal: int


@dataclass(frozen=True)
class Band:
    """Where the row of one rank must be: values between two bounds, after ``below`` rows."""

    column: str
    rank: int
    rows: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False

    def holds(self) -> Column:
        v, cond = F.col(f"`{self.column}`"), F.col(f"`{self.column}`").isNotNull()
        if self.low is not None:
            cond = cond & ((v > self.low) if self.low_open else (v >= self.low))
        if self.high is not None:
            cond = cond & ((v < self.high) if self.high_open else (v <= self.high))
        return cond

    def shrink(self, low: float, high: float, under: int, upto: int) -> Band:
        """The part of the band left once the counts around ``low`` and ``high`` are known."""
        if self.rank < under:
            return replace(self, high=low, high_open=True, rows=under - self.below)
        if self.rank >= upto:
            rows = self.below + self.rows - upto
            return replace(self, low=high, low_open=True, below=upto, rows=rows)
        return replace(
            self, low=low, high=high, low_open=False, high_open=False, below=under, rows=upto - under
        )


def _locate(counts: list[tuple[float, int]], rank: int, below: int) -> Point:
    for value, n in counts:
        if below + n > rank:
            return Point(value, below, n)
        below += n
    raise ValueError("rank outside the data")


def _narrow(values: DataFrame, bands: list[Band]) -> tuple[list[Band], dict[Band, Point]]:
    """One round for every band: cut by approximate quantiles, count, keep what is left."""
    shared: dict[str, list[Band]] = {}
    for band in bands:
        shared.setdefault(f"{band.column}:{band.low}:{band.high}", []).append(band)
    probes = []
    for group in shared.values():
        inside = F.when(group[0].holds(), F.col(f"`{group[0].column}`"))
        spots = []
        for band in group:
            at = (band.rank - band.below) / max(band.rows - 1, 1)
            spots += [max(at - MARGIN, 0.0), min(at + MARGIN, 1.0)]
        probes.append(F.percentile_approx(inside, spots, ACCURACY))
    row = values.agg(*[p.alias(f"c{i}") for i, p in enumerate(probes)]).first()
    cuts: dict[Band, tuple[float, float]] = {}
    for i, group in enumerate(shared.values()):
        for j, band in enumerate(group):
            cuts[band] = tuple(row[i][2 * j : 2 * j + 2])
    counts = []
    for i, band in enumerate(bands):
        v, (low, high) = F.col(f"`{band.column}`"), cuts[band]
        counts += [F.count_if(v < low).alias(f"u{i}"), F.count_if(v <= high).alias(f"t{i}")]
    seen = values.agg(*counts).first()
    rest, found = [], {}
    for i, band in enumerate(bands):
        (low, high), under, upto = cuts[band], seen[f"u{i}"], seen[f"t{i}"]
        if low == high and under <= band.rank < upto:
            found[band] = Point(low, under, upto - under)
        rest.append(band.shrink(low, high, under, upto))
    return rest, found


def _resolve(values: DataFrame, bands: list[Band]) -> dict[Band, Point]:
    """Points of bands whose distinct values are few: count them, bring the counts home."""
    cells = [
        F.when(
            band.holds(),
            F.struct(F.lit(i).alias("band"), F.col(f"`{band.column}`").alias("v")),
        )
        for i, band in enumerate(bands)
    ]
    near = reduce(or_, [band.holds() for band in bands])
    pairs = values.where(near).select(F.inline(F.array_compact(F.array(*cells))))
    rows = pairs.groupBy("band", "v").count().collect()
    counts: dict[int, list[tuple[float, int]]] = {}
    for row in rows:
        counts.setdefault(row["band"], []).append((row["v"], row["count"]))
    return {
        band: _locate(sorted(counts[i]), band.rank, band.below) for i, band in enumerate(bands)
    }


def order_points(
    df: DataFrame,
    columns: Mapping[str, Column],
    ranks: Ranks | Mapping[str, Ranks],
    limit: int = VALUE_LIMIT,
    as_type: str = "double",
) -> dict[str, tuple[int, dict[int, Point]]]:
    """Row count and points at ``ranks(row count)`` for each column, NULL and NaN left out."""
    names = list(columns)
    cast = {c: columns[c].cast(as_type) for c in names}
    if as_type in ("double", "float"):
        cast = {c: F.when(~F.isnan(v), v) for c, v in cast.items()}
    values = df.select(*[v.alias(c) for c, v in cast.items()])
    stats = values.agg(
        *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)],
        *[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)],
    ).first()
    size = {c: stats[f"n{i}"] for i, c in enumerate(names)}
    distinct = {c: stats[f"d{i}"] for i, c in enumerate(names)}
    result: dict[str, tuple[int, dict[int, Point]]] = {c: (size[c], {}) for c in names}
    few, many = [], []
    for c in names:
        wanted = (ranks[c] if isinstance(ranks, Mapping) else ranks)(size[c]) if size[c] else []
        bands = [Band(c, r, size[c]) for r in sorted(set(wanted))]
        (few if distinct[c] <= limit else many).extend(bands)
    if few:
        # One band per column is enough: all its ranks are read off the same counts.
        whole = {b.column: b for b in few}
        cells = F.array(
            *[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in whole]
        )
        rows = values.select(F.inline(cells)).where("v IS NOT NULL").groupBy("c", "v").count()
        counts: dict[str, list[tuple[float, int]]] = {c: [] for c in whole}
        for row in rows.collect():
            counts[row["c"]].append((row["v"], row["count"]))
        ordered = {c: sorted(pairs) for c, pairs in counts.items()}
        for band in few:
            result[band.column][1][band.rank] = _locate(ordered[band.column], band.rank, 0)
    while many:
        many, found = _narrow(values, many)
        for band, point in found.items():
            result[band.column][1][band.rank] = point
        many = [b for b in many if b.rank not in result[b.column][1]]
        if not many:
            break
        ready = [b for b in many if b.rows <= limit]
        crowded = [b for b in many if b.rows > limit]
        if crowded:
            kinds = [F.approx_count_distinct(F.when(b.holds(), F.col(f"`{b.column}`"))) for b in crowded]
            sizes = values.agg(*[k.alias(f"d{i}") for i, k in enumerate(kinds)]).first()
            ready += [b for i, b in enumerate(crowded) if sizes[i] <= limit]
        if ready:
            for band, point in _resolve(values, ready).items():
                result[band.column][1][band.rank] = point
        many = [b for b in many if b not in ready]
    return result


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Sequence[float],
    limit: int = VALUE_LIMIT,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column; an empty list for a column without values."""
    found = order_points(df, columns, quantile_ranks(probs), limit)
    return {name: quantile_values(probs, *points) for name, points in found.items()}


def quantile_ranks(probs: Sequence[float]) -> Ranks:
    """Ranks needed to interpolate the quantiles."""

    def ranks(n: int) -> list[int]:
        spots = [(n - 1) * q for q in probs]
        return sorted({f(s) for s in spots for f in (math.floor, math.ceil)})

    return ranks


def quantile_values(probs: Sequence[float], n: int, points: Mapping[int, Point]) -> list[float]:
    edges = []
    for q in probs if n else []:
        spot = (n - 1) * q
        low, high = points[math.floor(spot)].value, points[math.ceil(spot)].value
        edges.append(low + (high - low) * (spot - math.floor(spot)))
    return edges


def inner_quantile_edges(
    df: DataFrame, columns: Mapping[str, Column], bins: int, limit: int = VALUE_LIMIT
) -> dict[str, list[float]]:
    """Edges between ``bins`` equal-count bins, outer edges and repeats dropped."""
    probs = [i / bins for i in range(bins + 1)]
    quantiles = exact_quantiles(df, columns, probs, limit)
    return {name: distinct_edges(edges)[1:-1] for name, edges in quantiles.items()}


def key_cuts(
    df: DataFrame,
    values: Mapping[str, Column],
    tie: Column,
    positions: Ranks | Mapping[str, Ranks],
    limit: int = VALUE_LIMIT,
) -> dict[str, dict[int, tuple[float, int]]]:
    """The ``(value, tie)`` key at each 0-based position of the rows sorted by it.

    ``tie`` is a unique integer key, so rows sharing one value are still ordered; a value
    held by very many rows is narrowed by its ties in the same way.
    """
    rows = df.select(
        *[c.cast("double").alias(n) for n, c in values.items()], tie.cast("bigint").alias("_t")
    )
    found = order_points(rows, {n: F.col(f"`{n}`") for n in values}, positions, limit)
    cuts: dict[str, dict[int, tuple[float, int]]] = {}
    small: dict[str, dict[float, list[int]]] = {}
    for name, (_, points) in found.items():
        crowd = {p.value: p.equal for p in points.values()}
        if sum(crowd.values()) <= limit:
            small[name] = {v: [] for v in crowd}
    if any(small.values()):
        cells = [
            F.when(
                F.col(f"`{n}`").isin(*held),
                F.struct(F.lit(n).alias("n"), F.col(f"`{n}`").alias("v"), F.col("_t").alias("t")),
            )
            for n, held in small.items()
            if held
        ]
        for row in rows.select(F.inline(F.array_compact(F.array(*cells)))).collect():
            small[row["n"]][row["v"]].append(row["t"])
    for name, (_, points) in found.items():
        cuts[name] = {}
        for position, point in points.items():
            inner = position - point.below
            if name in small:
                key = sorted(small[name][point.value])[inner]
            else:
                same = rows.where(F.col(f"`{name}`") == point.value)
                ties = order_points(same, {"t": F.col("_t")}, lambda _, r=inner: [r], limit, "bigint")
                key = ties["t"][1][inner].value
            cuts[name][position] = (point.value, key)
    return cuts
