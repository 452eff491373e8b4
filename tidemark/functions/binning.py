"""Bins from literal edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_edges(edges: Sequence[float]) -> list[float]:
    """Ascending edges without repeats."""
    return sorted(set(edges))


def bin_right(value: Column, inner_edges: Sequence[float]) -> Column:
    """Index of the right-closed bin ``(a, b]``: the number of inner edges below ``value``."""
    if not inner_edges:
        return F.when(value.isNotNull(), F.lit(0))
    return reduce(add, [(value > F.lit(e)).cast("int") for e in inner_edges])


def bin_left(value: Column, inner_edges: Sequence[float]) -> Column:
    """Index of the left-closed bin ``[a, b)``: the number of inner edges at or below ``value``."""
    if not inner_edges:
        return F.when(value.isNotNull(), F.lit(0))
    return reduce(add, [(value >= F.lit(e)).cast("int") for e in inner_edges])


def labelled_ranges(value: Column, bounds: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the right-closed range ``(low, high]`` holding ``value``; NULL outside all."""
    expr = None
    for low, high, label in bounds:
        cond = (value > F.lit(low)) & (value <= F.lit(high))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def key_after(cols: Sequence[Column], cut: Sequence) -> Column:
    """True where the key ``cols`` sorts strictly after ``cut`` in lexicographic order."""
    expr = F.lit(False)
    for col, point in zip(reversed(cols), reversed(cut), strict=True):
        literal = F.lit(point)
        expr = (col > literal) | ((col == literal) & expr)
    return expr
