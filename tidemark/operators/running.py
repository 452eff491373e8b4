"""Running totals and carried values that never put one key, or all rows, in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

SLICE_ROWS = 2_000_000


def in_ranges(df: DataFrame, order: Sequence[Column], rows: int, slice_rows: int) -> DataFrame:
    """``df`` with ``_part``, the number of the range of ``order`` a row lies in.

    Ranges hold some ``slice_rows`` rows each, wherever the values crowd: a key with a third of all rows spans a third
    of the ranges. The table is written once, so that ranges stay as they are when a task is repeated.
    """
    parts = max(math.ceil(rows / slice_rows), 1)
    return settle(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _scan(
    ranged: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], lasts: Mapping[str, Column], end: int
) -> DataFrame:
    """Running sums and last values per key over ranges: within each range, moved up by what earlier ranges left.

    What a range leaves of a key is one row; keys within a single range need none. It meets the rows by key and range.
    """
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    columns = {n: F.sum(e).over(inside) for n, e in sums.items()}
    columns |= {n: F.last(e, ignorenulls=True).over(inside) for n, e in lasts.items()}

    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    marked = ranged.withColumn("_place", place) if lasts else ranged
    left = marked.groupBy(*keys, "_part").agg(
        *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()],
        *[F.max_by(F.struct(e.alias("v")), F.when(e.isNotNull(), F.col("_place"))).alias(f"_t_{n}") for n, e in lasts.items()],
    )
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = left.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_at"),
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before)["v"].alias(f"_o_{n}") for n in lasts],
    ).where("_earlier > 0")
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = ranged.withColumns(columns).join(offsets, same, "left")
    final = {
        n: F.when(
            F.col(n).isNotNull() | F.col(f"_o_{n}").isNotNull(),
            F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)),
        )
        for n in sums
    }
    final |= {n: F.coalesce(F.col(n), F.col(f"_o_{n}")) for n in lasts}
    spare = ["_part", "_at", "_earlier", *[f"_k_{k}" for k in keys], *[f"_o_{n}" for n in [*sums, *lasts]]]
    return joined.withColumns(final).drop(*spare)


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    descending: bool = False,
    by: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add inclusive running sums along ``order``, a column unique per row (of each group)."""
    at = [F.col(order).desc() if descending else F.col(order).asc()]
    rows = df.count()
    if rows > slice_rows:
        ranged = in_ranges(df, [*[F.col(k).asc() for k in by], *at], rows, slice_rows)
        return _scan(ranged, list(by), at, sums, {}, Window.currentRow)
    upto = Window.partitionBy(*by or [F.lit(0)]).orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({n: F.sum(e).over(upto) for n, e in sums.items()})


def running_by_key(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    slice_rows: int = SLICE_ROWS,
    before_row: bool = False,
) -> DataFrame:
    """Add running sums and last non-NULL values per key, in ``order``.

    They cover the rows up to and including each row, or only those before it. Where a key has
    more rows than a slice holds, all rows are cut into ranges of key and order, and keys that
    lie in several ranges are put together from these. Only whether there is such a key, and
    the number of rows, come to the driver.
    """
    sums, lasts = sums or {}, lasts or {}
    end = -1 if before_row else Window.currentRow
    crowded = df.groupBy(key).count().where(F.col("count") > slice_rows)
    if crowded.isEmpty():
        upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        columns = {n: F.sum(e).over(upto) for n, e in sums.items()}
        return df.withColumns(columns | {n: F.last(e, ignorenulls=True).over(upto) for n, e in lasts.items()})
    at = [F.col(c).asc() for c in order]
    ranged = in_ranges(df, [F.col(key).asc(), *at], df.count(), slice_rows)
    return _scan(ranged, [key], at, sums, lasts, end)


def carry_last(
    df: DataFrame, key: str, order: Sequence[str], column: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Fill ``column`` with its last non-NULL value along ``order``."""
    carried = running_by_key(df, key, order, lasts={"_carried": F.col(column)}, slice_rows=slice_rows)
    return carried.withColumn(column, F.col("_carried")).drop("_carried")
