"""Synthetic minority rows between real ones and their nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of one side of a tile of minority rows that are compared.
TILE_ROWS = 4_096
NEIGHBOURS = 5


def _nearest(table: pa.Table, width: int, k: int) -> pa.Table:
    """The ``k`` nearest rows of the tile's right side for each row of its left side, itself left out."""
    left = table.column("left").to_numpy(zero_copy_only=False)
    key = table.column("row").to_numpy()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    one, two = np.flatnonzero(left), np.flatnonzero(~left)
    rows, near, apart = [], [], []
    for low in range(0, len(one) if len(two) else 0, 256):
        part = one[low : low + 256]
        gap = np.zeros((len(part), len(two)))
        for d in range(width):
            gap += (x[part, d, None] - x[two, d]) ** 2
        gap[key[part, None] == key[two]] = np.inf
        # Ties by the smaller row, so that a repeated task gives the same.
        order = np.lexsort((np.broadcast_to(key[two], gap.shape), gap), axis=1)[:, :k]
        found = np.take_along_axis(gap, order, axis=1)
        i, j = np.nonzero(np.isfinite(found))
        rows.append(key[part[i]])
        near.append(key[two[order[i, j]]])
        apart.append(found[i, j])
    names = {"row": pa.int64(), "near": pa.int64(), "apart": pa.float64()}
    if not rows:
        return pa.schema(names).empty_table()
    return pa.table({"row": np.concatenate(rows), "near": np.concatenate(near), "apart": np.concatenate(apart)})


def nearest_rows(points: DataFrame, width: int, k: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``row, near, place`` of ``points`` (``row`` long and unique, ``x`` array of ``width`` doubles): the ``k`` nearest others.

    Rows are dealt into blocks by hash and each pair of blocks is a tile of one task, which gives only the best k of
    each of its left rows; so neither all rows nor all pairs meet anywhere. Equal distances go to the smaller row.
    """
    blocks = max(-(-points.count() // tile_rows), 1)
    own = F.pmod(F.xxhash64("row"), F.lit(blocks))
    dealt = points.select("row", "x", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("other"))
    left = dealt.select(F.col("own").alias("one"), F.col("other").alias("two"), F.lit(True).alias("left"), "row", "x")
    right = dealt.select(F.col("other").alias("one"), F.col("own").alias("two"), F.lit(False).alias("left"), "row", "x")
    tiles = left.unionByName(right).groupBy("one", "two")
    found = tiles.applyInArrow(lambda t: _nearest(t, width, k), "row bigint, near bigint, apart double")
    place = F.row_number().over(Window.partitionBy("row").orderBy("apart", "near"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("row", "near", "place")


def synthetic_rows(
    df: DataFrame, label: str, key: str, columns: Sequence[str], k: int = NEIGHBOURS, tile_rows: int = TILE_ROWS, seed: int = 42
) -> DataFrame:
    """``label`` and ``columns`` of as many new rows as the smaller class lacks.

    Each lies between a row of the smaller class and one of its ``k`` nearest rows of that class (by Euclidean distance
    over ``columns``, which hold doubles). A row bears the whole part of what is lacking per row, and one more by a hash
    of its key; the neighbour and the place between are hashes of the key and the copy's number. A class of fewer than
    two rows, or two even classes, give none. ``key`` is a whole number and unique.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect() if r[label] is not None}
    names = [label, *columns]
    few = min(counts, key=lambda c: (counts[c], -c)) if len(counts) == 2 else None
    lacking = max(counts.values()) - counts[few] if few is not None else 0
    if not lacking or counts[few] < 2:
        return df.select(*names).where("false")
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    points = df.where(F.col(label) == few).select(F.col(key).cast("bigint").alias("row"), F.array(*values).alias("x"))
    near = nearest_rows(points, len(columns), k, tile_rows)
    whole, part = divmod(lacking, counts[few])
    more = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < int(part / counts[few] * (1 << 30))
    copies = points.select("row", "x", F.explode(F.sequence(F.lit(1), F.lit(whole) + more.cast("int"))).alias("copy")) if whole else points.where(more).withColumn("copy", F.lit(1))
    sized = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "near")))["near"].alias("others"))
    drawn = copies.join(sized, "row")
    pick = F.pmod(F.xxhash64("row", "copy", F.lit(seed + 1)), F.size("others")).cast("int")
    drawn = drawn.select("row", "x", "copy", F.get("others", pick).alias("near"))
    other = points.select(F.col("row").alias("near"), F.col("x").alias("y"))
    # A place between 0 and 1 of both keys and the copy's number.
    along = F.pmod(F.xxhash64("row", "near", "copy", F.lit(seed + 2)), F.lit(1 << 40)) / float(1 << 40)
    met = drawn.join(other, "near").withColumn("along", along)
    between = F.transform(F.arrays_zip("x", "y"), lambda p: p["x"] + F.col("along") * (p["y"] - p["x"]))
    out = met.select(between.alias("z"))
    return out.select(F.lit(few).cast(df.schema[label].dataType).alias(label), *[F.get("z", F.lit(i)).alias(c) for i, c in enumerate(columns)])
