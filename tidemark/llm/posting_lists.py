"""Nearest vectors by balanced posting lists whose centroids a neighbour graph searches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

# Bytes of the sample that centroids are fitted on, as doubles: the driver holds no more vectors.
SAMPLE_BYTES = 64 << 20
# Vectors of the sample for one list.
PER_LIST = 512
# Vectors of one side of a tile.
PIECE = 4096


@dataclass
class Index:
    """Centroids, their neighbour graph and the ratios of distance that decide which lists a vector goes to.

    ``edge`` is the ratio to the nearest centroid up to which a vector is on the boundary and copied, to ``copies``
    lists at most; ``reach`` the ratio up to which a query reads lists.
    """

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    edge: float
    copies: int
    reach: float = 1.0


def balanced_leaves(x: np.ndarray, per_list: int, rng) -> list[np.ndarray]:
    """Rows of ``x`` cut at the median along the line between two means, again and again, until no part holds more
    than ``per_list``: all parts hold equally many rows, give or take one per cut."""
    done, open_parts = [], [np.arange(len(x))]
    while open_parts:
        rows = open_parts.pop()
        if len(rows) <= per_list:
            done.append(rows)
            continue
        part = x[rows]
        one, two = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(5):
            along = part @ (one - two)
            side = along > np.median(along)
            if side.all() or not side.any():
                break
            one, two = part[side].mean(0), part[~side].mean(0)
        order = np.argsort(part @ (one - two), kind="stable")
        half = len(order) // 2
        open_parts += [rows[order[:half]], rows[order[half:]]]
    return done


def neighbour_graph(centroids: np.ndarray, degree: int = 16) -> np.ndarray:
    """Nearest neighbours of each centroid, and a ring through all of them so that every one can be reached."""
    n = len(centroids)
    degree = min(degree, n - 1)
    ring = np.roll(np.arange(n), -1)[:, None]
    if degree < 1:
        return ring
    squares = (centroids**2).sum(1)
    near = np.empty((n, degree), np.int64)
    for low in range(0, n, 1024):
        part = centroids[low : low + 1024]
        apart = squares - 2 * part @ centroids.T
        apart[np.arange(len(part)), low + np.arange(len(part))] = np.inf
        near[low : low + 1024] = np.argpartition(apart, degree - 1, axis=1)[:, :degree]
    return np.concatenate([near, ring], axis=1)


def search_graph(index: Index, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x``, centroids and distances of those the graph finds within ``ratio`` of each row's nearest.

    All rows walk side by side: in each round every centroid seen and not yet left that lies within the ratio of the
    nearest seen so far hands on its neighbours.
    """
    n, k = len(x), len(index.centroids)
    seen = np.zeros((n, k), bool)
    apart = np.full((n, k), np.inf)
    left = np.zeros((n, k), bool)
    row = np.repeat(np.arange(n), len(index.entries))
    to = np.tile(index.entries, n)
    while len(row):
        cell = np.unique(row * k + to)
        cell = cell[~seen.ravel()[cell]]
        seen.ravel()[cell] = True
        r, c = np.divmod(cell, k)
        for low in range(0, len(cell), 1 << 16):
            s = slice(low, low + (1 << 16))
            gap = x[r[s]] - index.centroids[c[s]]
            apart[r[s], c[s]] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        r, c = np.nonzero(~left & (apart <= ratio * apart.min(axis=1, keepdims=True)))
        left[r, c] = True
        row = np.repeat(r, index.graph.shape[1])
        to = index.graph[c].ravel()
    r, c = np.nonzero(apart <= ratio * apart.min(axis=1, keepdims=True))
    return r, c, apart[r, c]


def lists_of(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their lists: that of the nearest centroid, and for boundary rows further ones, ``copies`` at most."""
    r, c, apart = search_graph(index, x, index.edge)
    order = np.lexsort((c, apart, r))
    r, c = r[order], c[order]
    begin = np.searchsorted(r, np.arange(len(x)))
    kept = np.arange(len(r)) - begin[r] < index.copies
    return r[kept], c[kept]


def fit_index(sample: np.ndarray, per_list: int, edge: float, copies: int, k: int, recall: float) -> Index:
    """The index of a sample of vectors, filled up with zeros to one width.

    ``reach`` is the ratio at which the sample's own ``k`` nearest of some 500 of its rows are found with the wished
    ``recall``. The whole table lies denser than the sample, so its nearest vectors need no larger ratio.
    """
    rng = np.random.default_rng(13)
    centroids = np.array([sample[rows].mean(0) for rows in balanced_leaves(sample, per_list, rng)])
    n = len(centroids)
    entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
    index = Index(centroids, neighbour_graph(centroids), entries, edge, copies)
    if n == 1:
        return index
    asked = np.sort(rng.choice(len(sample), min(len(sample), 512), replace=False))
    squares = (sample**2).sum(1)
    near = np.empty((len(asked), min(k, len(sample) - 1)), np.int64)
    for low in range(0, len(asked), 64):
        part = asked[low : low + 64]
        apart = squares - 2 * sample[part] @ sample.T
        apart[np.arange(len(part)), part] = np.inf
        near[low : low + 64] = np.argpartition(apart, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    members = np.unique(near)
    r, c = lists_of(index, sample[members])
    gap = np.sqrt(np.maximum(((sample[asked] ** 2).sum(1)[:, None] + (centroids**2).sum(1)) - 2 * sample[asked] @ centroids.T, 0))
    gap /= np.maximum(gap.min(axis=1, keepdims=True), 1e-300)
    first = np.searchsorted(r, np.arange(len(members)))
    needed = np.empty(near.shape)
    for i, row in enumerate(near):
        at = np.searchsorted(members, row)
        needed[i] = np.minimum.reduceat(gap[i, c], first)[at]
    index.reach = float(np.quantile(needed, recall)) * (1 + 1e-9)
    return index


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix of doubles filled up with zeros, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return out, lengths


def nearest_in_tile(asked: np.ndarray, asked_size: np.ndarray, held: np.ndarray, held_size: np.ndarray, low: np.ndarray, k: int):
    """For each asked row its ``k`` nearest held rows of equal length by distance, then ``low``: rows, places, distances.

    Products rule rows out, with room for their rounding; differences, summed in order of components, decide.
    """
    squares, own = (held**2).sum(1), (asked**2).sum(1)
    rows, places, found = [], [], []
    for begin in range(0, len(asked), 256):
        part = slice(begin, begin + 256)
        rough = own[part, None] + squares - 2 * asked[part] @ held.T
        rough[asked_size[part, None] != held_size] = np.inf
        top = np.partition(rough, min(k, len(held)) - 1, axis=1)[:, min(k, len(held)) - 1]
        room = 1e-9 * (own[part] + squares.max())
        i, j = np.nonzero((rough <= (top + room)[:, None]) & np.isfinite(rough))
        i = i + begin
        total = np.zeros(len(i))
        for d in range(asked.shape[1]):
            total += (asked[i, d] - held[j, d]) ** 2
        apart = np.sqrt(total)
        order = np.lexsort((low[j], apart, i))
        i, j, apart = i[order], j[order], apart[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        rows.append(i[kept])
        places.append(j[kept])
        found.append(apart[kept])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(found)


def _tile(table: pa.Table, width: int, k: int) -> pa.Table:
    query = table.column("id").is_valid().to_numpy(zero_copy_only=False)
    x, sizes = _matrix(table.column("v"), width)
    # A power of two, so that large and small components keep all their digits.
    scale = 2.0 ** np.floor(np.log2(np.abs(x).max(initial=1e-300)))
    x /= scale
    asked, held = np.flatnonzero(query), np.flatnonzero(~query)
    empty = {"id": pa.int64(), "h": pa.int64(), "near": pa.int64(), "score": pa.float64()}
    if not len(asked) or not len(held):
        return pa.schema(empty).empty_table()
    ids = table.column("ids").combine_chunks().take(pa.array(held))
    counts = ids.value_lengths().to_numpy(zero_copy_only=False)
    flat, first = ids.flatten().to_numpy(), np.cumsum(counts) - counts
    i, j, apart = nearest_in_tile(x[asked], sizes[asked], x[held], sizes[held], flat[first], k)
    at = np.repeat(np.arange(len(i)), counts[j])
    near = flat[np.repeat(first[j] - np.cumsum(counts[j]) + counts[j], counts[j]) + np.arange(len(at))]
    i, apart = i[at], apart[at]
    order = np.lexsort((near, apart, i))
    i, near, apart = i[order], near[order], apart[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    taken = pa.array(asked[i[kept]])
    return pa.table(
        {"id": table.column("id").take(taken), "h": table.column("h").take(taken), "near": near[kept], "score": apart[kept] * scale}
    )


def nearest_vectors(
    rows: DataFrame,
    key: str,
    vector: str,
    every: int = 100,
    k: int = 10,
    recall: float = 0.97,
    edge: float = 1.05,
    copies: int = 2,
    per_list: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose key ``every`` divides.

    Nearness is the Euclidean distance of the original vectors in double precision, ties go to the smaller key, and a
    key's own rows are no results of it. Vectors that are null, empty or zero or hold null or non-finite components
    take no part, nor do rows with a null key; only vectors of equal length are compared. Repeated rows count once; of
    a key with several vectors each is searched, and it is a result at the nearest of them. Fewer candidates than
    ``k`` give fewer rows, empty tables none; other columns are ignored.

    Centroids of balanced lists are fitted on a sample of SAMPLE_BYTES at most; every vector is then put on the list
    of its nearest centroid and, within ``edge`` of it, on ``copies`` in all. Queries read the lists whose centroid
    lies within the index' ``reach``, fitted to the wished ``recall``. Equal vectors are one with its k + 1 smallest
    keys. Long lists and lists asked often are cut into tiles of PIECE rows a side, so no task holds a whole list.
    """
    spark = rows.sparkSession
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"
    base = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    large = F.lit(float("inf"))
    sane = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < large)) & F.exists("v", lambda x: x != 0)
    base = base.where(F.col("id").isNotNull() & F.coalesce(sane, F.lit(False))).withColumn("h", F.xxhash64("v"))
    # Of equal vectors the k + 1 smallest keys are enough: a query leaves out its own only.
    order = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))
    first = base.withColumn("place", order).where(F.col("place") <= k + 1).groupBy("h", "v")
    points = settle(first.agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids")), "points")
    count, width = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    most = max(1, SAMPLE_BYTES // (8 * width))
    share = F.lit(int(min(1.0, most / count) * 2**32))
    sample = points.where(F.pmod(F.xxhash64("h"), F.lit(1 << 32)) < share).select("h", "v").limit(most).toArrow()
    if not sample.num_rows:
        sample = points.select("h", "v").limit(most).toArrow()
    sample = sample.take(pa.array(np.argsort(sample.column("h").to_numpy(), kind="stable")))
    x = _matrix(sample.column("v"), width)[0]
    index = fit_index(x / np.abs(x).max(), per_list or PER_LIST, edge, copies, k, recall)
    scale = float(np.abs(x).max())

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                row, to = lists_of(index, _matrix(batch.column("v"), width)[0] / scale)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to), *(batch.column(c).take(taken) for c in ("ids", "v"))], ["list", "ids", "v"])

    def route(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                row, to, _ = search_graph(index, _matrix(part.column("v"), width)[0] / scale, index.reach)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to), *(part.column(c).take(taken) for c in ("id", "h", "v"))], ["list", "id", "h", "v"])

    postings = settle(points.select("ids", "v").mapInArrow(put, f"list bigint, ids array<bigint>, v array<{kind}>"), "postings")
    asked = base.where(F.col("id") % every == 0).dropDuplicates(["id", "h", "v"])
    asked = settle(asked.mapInArrow(route, f"list bigint, id bigint, h bigint, v array<{kind}>"), "probes")

    def cut(lists: DataFrame, name: str) -> DataFrame:
        return lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("bigint").alias(name))

    # One row per list: no more than the sample's vectors.
    cuts = F.broadcast(settle(cut(postings, "pieces").join(cut(asked, "blocks"), "list"), "list-cuts"))

    def spread(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias(name[:-1])

    held = postings.join(cuts, "list").withColumn("piece", F.pmod(F.xxhash64("ids"), F.col("pieces")))
    held = held.select("list", "piece", spread("blocks"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("h"), "ids", "v")
    tiles = asked.join(cuts, "list").withColumn("block", F.pmod(F.xxhash64("id", "h"), F.col("blocks")))
    tiles = tiles.select("list", spread("pieces"), "block", "id", "h", F.lit(None).cast("array<bigint>").alias("ids"), "v")
    found = (
        held.unionByName(tiles)
        .groupBy("list", "piece", "block")
        .applyInArrow(lambda t: _tile(t, width, k + 1), "id bigint, h bigint, near bigint, score double")
    )
    # Copies on several lists are found several times.
    found = found.where("near <> id").groupBy("id", "h", "near").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("id", "h").orderBy("score", "near")).alias("rank")
    return found.select(F.col("id").alias("query_id"), place, F.col("near").alias("vec_id"), "score").where(F.col("rank") <= k)
