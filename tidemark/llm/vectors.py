"""Near-duplicate vectors by tiles compared in order of principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import settle

# Vectors of one side of a tile; a tile's products take its square.
TILE = 1024
# Room for rounding between rotated sums and the cosine that decides.
SLACK = 1e-9


def unit_moments(vectors: DataFrame, width: int) -> np.ndarray:
    """Second moments of the unit vectors, added up per task and then over tasks: ``width`` squared numbers."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])

    rows = vectors.select("v").mapInArrow(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(width * width)
    for r in rows.collect():
        out[r["cell"]] = r["value"]
    return out.reshape(width, width)


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, filled up with zeros on the right.

    Each row is divided by the power of two below its largest component, which no cosine notices: so squares of tiny
    and of huge components neither vanish nor overflow.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    top = np.frexp(np.abs(out).max(axis=1, initial=0))[1] - 1
    return np.ldexp(out, -top[:, None])


def linked(left: np.ndarray, right: np.ndarray, threshold: float, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rotated unit rows whose product may reach ``threshold``.

    The leading dimensions are added up first. After each step what is left of a product is at most the product of the
    norms of the two suffixes; pairs that cannot reach the threshold go, and only the rest takes the next dimensions.
    """
    edges = [0, *steps]
    tails = [(np.linalg.norm(left[:, s:], axis=1), np.linalg.norm(right[:, s:], axis=1)) for s in steps]
    total = left[:, : steps[0]] @ right[:, : steps[0]].T
    i, j = np.nonzero(total + np.outer(*tails[0]) >= threshold - SLACK)
    total = total[i, j]
    for k in range(1, len(steps)):
        part = slice(edges[k], edges[k + 1])
        total = total + np.einsum("ij,ij->i", left[i, part], right[j, part])
        keep = total + tails[k][0][i] * tails[k][1][j] >= threshold - SLACK
        i, j, total = i[keep], j[keep], total[keep]
    return i, j


def _roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that links lead to, for each index of a tile."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def near_vectors(rows: DataFrame, key: str, vector: str, label: str, threshold: float = 0.98) -> DataFrame:
    """One row per row of ``rows``: ``key, n_links, component_id, kept``.

    Two rows are linked when their labels are equal and not null, their lengths are equal and the cosine of their
    vectors, in double precision, is at least ``threshold``. Rows whose vector is null or zero or holds a null or
    non-finite component, or whose label is null, link with nothing. ``n_links`` counts other rows, repeated ones
    included; ``component_id`` is the smallest key that links reach (keys are long; a null key is larger than any
    other). Empty tables give no rows, other columns are ignored.

    Equal vectors of a label are one vector with a count, however many there are. A unit vector's distance from
    another with cosine c is sqrt(2 - 2c), so only vectors whose first two principal coordinates differ by no more
    can be linked: cells of that width meet their neighbours alone, block by block of some ``TILE`` vectors. A tile
    sends one row for each vector with links, not one for each link.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    base = rows.select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")
    )
    large = F.lit(float("inf"))
    sane = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < large)) & F.exists("v", lambda x: x != 0)
    sane = F.col("label").isNotNull() & F.coalesce(sane, F.lit(False))
    same = F.struct("label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    base = base.select("id", F.when(sane, same).alias("same"))
    base = base.withColumn("h", F.when(F.col("same").isNotNull(), F.xxhash64("same")))
    grouped = base.where("same is not null").groupBy("h", "same").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = settle(grouped.withColumn("cid", F.monotonically_increasing_id()), "vectors")

    vectors = classes.select("cid", "n", F.col("same.label").alias("label"), F.col("same.v").alias("v"))
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    if width:
        counts = settle(_tile_links(vectors, width, threshold), "tile-links")
    else:
        counts = base.sparkSession.createDataFrame([], "cid bigint, links bigint, root bigint")
    links = counts.groupBy("cid").agg(F.sum("links").alias("links"))
    reached = components(counts.select(F.col("cid").alias("a"), F.col("root").alias("b")), "a", "b")
    totals = settle(
        classes.join(links, "cid", "left")
        .join(reached.select(F.col("id").alias("cid"), "component"), "cid", "left")
        .select("h", "same", "low", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "vector-totals",
    )
    lows = settle(totals.groupBy("component").agg(F.min("low").alias("component_id")), "component-ids")
    totals = totals.join(lows, "component").select("h", "same", "n_links", "component_id")
    out = base.join(settle(totals, "vector-totals"), ["h", "same"], "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _tile_links(vectors: DataFrame, width: int, threshold: float) -> DataFrame:
    """``cid, links, root`` of each tile: how many rows a vector is linked with there, and the least id they lead to."""
    basis = np.linalg.eigh(unit_moments(vectors, width))[1][:, ::-1].copy()
    steps = sorted({s for s in (8, 16, 32) if s < width} | {width})
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ basis[:, :2]
            cells = [pa.array(np.floor(c / reach).astype(np.int64)) for c in (x[:, 0], x[:, -1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], [*batch.schema.names, "cx", "cy"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    placed = vectors.mapInArrow(place, schema + ", cx bigint, cy bigint").withColumn("size", F.size("v"))
    placed = settle(placed, "placed-vectors")
    cell = ["label", "size", "cx", "cy"]
    blocks = settle(placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("bigint").alias("blocks")), "cells")
    placed = placed.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).drop("blocks")

    # A vector goes to one tile for each block of its own cell and of the eight around it. The smaller of the two
    # blocks, by cell and number, is the left side; a block with itself has a left side only.
    shifts = [F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    sent = placed.withColumn("s", F.explode(F.array(*shifts)))
    sent = sent.select(*placed.columns, (F.col("cx") + F.col("s.dx")).alias("tx"), (F.col("cy") + F.col("s.dy")).alias("ty"))
    there = blocks.select("label", "size", F.col("cx").alias("tx"), F.col("cy").alias("ty"), "blocks")
    sent = sent.join(there, ["label", "size", "tx", "ty"]).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    here, far = F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("block").alias("k")), F.struct(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("other").alias("k"))
    tile = F.struct(F.least(here, far).alias("one"), F.greatest(here, far).alias("two"))
    sent = sent.select("label", "size", tile.alias("tile"), (here <= far).alias("left"), "cid", "n", "v")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy()
        table = table.take(pa.array(np.argsort(~side, kind="stable")))
        split = int(side.sum())
        x = _matrix(table.column("v"), width)
        norms = np.linalg.norm(x, axis=1)
        unit = (x / norms[:, None]) @ basis
        two = slice(split, None) if split < len(x) else slice(0, None)
        shift = split if split < len(x) else 0
        left, right = [], []
        for low in range(0, split, 256):
            i, j = linked(unit[low : min(low + 256, split)], unit[two], threshold, steps)
            i, j = i + low, j + shift
            if not shift:
                i, j = i[i < j], j[i < j]
            close = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j]) >= threshold
            left.append(i[close])
            right.append(j[close])
        i, j = np.concatenate(left), np.concatenate(right)
        n = table.column("n").to_numpy()
        cid = table.column("cid").to_numpy()
        links = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
        order = np.argsort(cid)
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        root = cid[order][_roots(len(x), rank[i], rank[j])][rank]
        rows = np.flatnonzero(links)
        return pa.table({"cid": cid[rows], "links": links[rows].astype(np.int64), "root": root[rows]})

    return sent.groupBy("label", "size", "tile").applyInArrow(compare, "cid bigint, links bigint, root bigint")
