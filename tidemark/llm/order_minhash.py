"""Near-duplicate documents by Order MinHash and banded alignment."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.alignment import within
from tidemark.llm.columns import byte_slices, fresh_names, hashed_words, mix, ragged_ranges, shingle_hashes, text_buffer
from tidemark.llm.components import components
from tidemark.session import settle

SHINGLE = 5
# Words of the shingles that are sketched: of longer ones, pairs at a similarity of 0.8 share too few.
SKETCHED = 2
REPEATS = 32
# Stands before and after the words of a text.
EDGE = np.uint64(0x9E3779B97F4A7C15)
# Buckets of the word counts that bound a distance from below.
COUNTS = 256
# Members of one side of a tile of a large bucket.
TILE = 512
# Pairs of a tile aligned together, before those go that their links have connected.
ALIGNED = 256
# Rows found in tiles that are given at once.
HELD = 10_000

_SEEDS = np.random.default_rng(0x0D3).integers(1, 2**62, (REPEATS, 2), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(2**64 - 1)


def labelled_shingles(words: np.ndarray, rows: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, with the number of earlier equal ones in the text, and each text's offset.

    A text of fewer words than ``size``, but not none, has one shingle of all of them.
    """
    counts = np.diff(rows)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(len(counts)), shingles)
    at = rows[:-1][row] + np.arange(offsets[-1]) - offsets[row]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    hashes = shingle_hashes(padded, size)[at]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        short = np.concatenate([words[rows[r] : rows[r + 1]], np.zeros(size - counts[r], np.uint64)])
        hashes[offsets[r]] = shingle_hashes(short, size)[0]
    key = mix(hashes + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    repeat = np.zeros(len(key), bool)
    same = key[order[1:]] == key[order[:-1]]
    repeat[order[1:][same]] = repeat[order[:-1][same]] = True
    seen = np.flatnonzero(repeat)
    if len(seen):
        seen = seen[np.argsort(key[seen], kind="stable")]
        new = np.concatenate([[True], key[seen[1:]] != key[seen[:-1]]])
        start = np.flatnonzero(new)
        number = np.arange(len(seen)) - start[np.cumsum(new) - 1]
        # The first copy keeps its hash, so that it equals that of a text with one.
        seen, number = seen[number > 0], number[number > 0]
        hashes[seen] = mix(hashes[seen] + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return hashes, offsets


def edged(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with EDGE before and after each, so that an edit changes as much of a short text wherever it falls."""
    return np.insert(words, np.repeat(rows, 2)[1:-1], EDGE), rows + 2 * np.arange(len(rows))


def order_sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """REPEATS keys per text: each of its two least labelled shingles under one hash order, told apart by text order."""
    filled = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, REPEATS), np.uint64)
    if not len(filled):
        return out
    starts = offsets[:-1][filled]
    sizes = np.diff(offsets)[filled]
    for r, (factor, shift) in enumerate(_SEEDS):
        value = hashes * factor + shift
        least = np.minimum.reduceat(value, starts)
        first = value == np.repeat(least, sizes)
        value[first] = _LAST
        second = np.minimum.reduceat(value, starts)
        where = np.flatnonzero(first)
        one = where[np.searchsorted(where, starts)]
        where = np.flatnonzero(value == np.repeat(second, sizes))
        two = where[np.searchsorted(where, starts)]
        swap = one > two
        a, b = np.where(swap, second, least), np.where(swap, least, second)
        out[filled, r] = mix(mix(a + np.uint64(r)) + b)
    return out


def word_counts(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each text's words counted in COUNTS buckets, up to 255: counts of texts differ by two per edit at most."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    cell = row * COUNTS + (words >> np.uint64(40)).astype(np.int64) % COUNTS
    return np.minimum(np.bincount(cell, minlength=(len(rows) - 1) * COUNTS), 255).astype(np.uint8).reshape(-1, COUNTS)


def _sketch(batches):
    for batch in byte_slices(batches, "text"):
        words, rows = hashed_words(batch.column("text"))
        keys = order_sketches(*labelled_shingles(*edged(words, rows), SKETCHED))
        counts = word_counts(words, rows)
        data, at = text_buffer(batch.column("text"))
        # Equal texts are one class; texts with words are equal when their words are.
        same = []
        for i in range(batch.num_rows):
            own = words[rows[i] : rows[i + 1]]
            same.append(hashlib.blake2b(own.tobytes() if len(own) else b"-" + data[at[i] : at[i + 1]].tobytes(), digest_size=16).digest())
        flat = pa.array(keys.astype(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, REPEATS, dtype=np.int32)), flat)
        columns = [batch.column("row"), pa.array(same, pa.binary()), pa.array(np.diff(rows)), lists, pa.array([c.tobytes() for c in counts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "same", "n_words", "keys", "counts"])


def _limit(longest, similarity: float):
    """Most edits of a pair whose longer text has ``longest`` words."""
    return np.floor((1 - similarity) * np.asarray(longest) + 1e-9).astype(np.int64)


def _verify(similarity: float):
    def run(batches):
        for half in byte_slices(batches, "text_a"):
            for part in byte_slices([half], "text_b"):
                words_a, rows_a = hashed_words(part.column("text_a"))
                words_b, rows_b = hashed_words(part.column("text_b"))
                pairs = [(words_a[rows_a[i] : rows_a[i + 1]], words_b[rows_b[i] : rows_b[i + 1]]) for i in range(part.num_rows)]
                close = within(pairs, _limit(np.maximum(np.diff(rows_a), np.diff(rows_b)), similarity))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(close))

    return run


def _plausible(similarity: float):
    """Drop pairs whose lengths or word counts differ too much for the similarity."""

    def run(batches):
        for batch in batches:
            limit = _limit(np.maximum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()), similarity)
            left, right = (_counts(batch.column(c)) for c in ("counts_a", "counts_b"))
            keep = np.abs(left - right).sum(axis=1) <= 2 * limit
            keep &= np.abs(batch.column("n_a").to_numpy() - batch.column("n_b").to_numpy()) <= limit
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _counts(column) -> np.ndarray:
    data, _ = text_buffer(column)
    return data.reshape(-1, COUNTS).astype(np.int16)


def _marks(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sixteen bits of the hash of each word, told apart from its earlier copies in the text."""
    return (labelled_shingles(words, rows, 1)[0] >> np.uint64(48)).astype(np.uint16)


def _shared_marks(marks: np.ndarray, offsets: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """At least the number of words that text ``i`` shares with each of ``others``, which have words."""
    known = np.zeros(1 << 16, bool)
    known[marks[offsets[i] : offsets[i + 1]]] = True
    sizes = offsets[others + 1] - offsets[others]
    hits = known[marks[ragged_ranges(offsets[others], sizes)]]
    return np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes) - sizes)


def _tile_links(similarity: float):
    """Verified pairs that connect what is similar among a tile's left and right members (or left ones, alone).

    Only members of different components are compared, a pair in the first of its common buckets only, and where the
    words that both have leave room for the similarity. Links join components at once, so a tile gives fewer links
    than it has members, and the likeliest pairs are aligned first.
    """

    def links(batch: pa.RecordBatch):
        left = batch.column("left").to_numpy(zero_copy_only=False)
        repeat = batch.column("repeat")[0].as_py()
        cid = batch.column("cid").to_numpy()
        component = np.unique(batch.column("component").to_numpy(), return_inverse=True)[1]
        keys = batch.column("keys").flatten().to_numpy().reshape(-1, REPEATS)
        words, rows = hashed_words(batch.column("text"))
        n, marks = np.diff(rows), _marks(words, rows)
        counts = word_counts(words, rows).astype(np.int16)
        one = np.flatnonzero(left)
        two = np.flatnonzero(~left) if not left.all() else one
        found = [np.zeros((3, 0), np.int64)]
        for i in one:
            j = two[two > i] if two is one else two
            j = j[component[j] != component[i]]
            j = j[(keys[j, :repeat] != keys[i, :repeat]).all(axis=1)]
            limit = _limit(np.maximum(n[i], n[j]), similarity)
            keep = (np.abs(n[i] - n[j]) <= limit) & (np.abs(counts[j] - counts[i]).sum(axis=1) <= 2 * limit)
            j, limit = j[keep], limit[keep]
            if len(j):
                room = _shared_marks(marks, rows, i, j) - np.maximum(n[i], n[j]) + limit
                found.append(np.stack([np.full(len(j), i), j, room])[:, room >= 0])
        left, right, room = np.concatenate(found, axis=1)
        order = np.argsort(-room, kind="stable")
        left, right = left[order], right[order]
        out = []
        while len(left):
            # The likeliest pairs, one for two components.
            ends = np.sort([component[left], component[right]], axis=0)
            some = np.sort(np.unique(ends[0] * len(n) + ends[1], return_index=True)[1])[:ALIGNED]
            pairs = [(words[rows[i] : rows[i + 1]], words[rows[j] : rows[j + 1]]) for i, j in zip(left[some], right[some], strict=True)]
            close = some[within(pairs, _limit(np.maximum(n[left[some]], n[right[some]]), similarity))]
            for i, j in zip(left[close], right[close], strict=True):
                if component[i] != component[j]:
                    out.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
                    component[component == component[j]] = component[i]
            rest = component[left] != component[right]
            rest[some] = False
            left, right = left[rest], right[rest]
        return out

    def run(batches):
        found = []
        for tile in _by_tile(batches):
            found += links(tile)
            if len(found) >= HELD:
                yield _pair_batch(found)
                found = []
        yield _pair_batch(found)

    return run


def _by_tile(batches):
    """Slices of the sorted ``batches``, one for each tile; what is held of a batch that has passed is its last tile."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = np.stack([batch.column(k).to_numpy() for k in ("repeat", "key", "one", "two")], axis=1)
        new = np.ones(len(tile), bool)
        new[1:] = (tile[1:] != tile[:-1]).any(axis=1)
        new[0] = last is None or (tile[0] != last).any()
        last = tile[-1].copy()
        heads = np.flatnonzero(new)
        if not len(heads):
            held.append(batch)
            continue
        if held:
            yield _joined([*held, batch.slice(0, heads[0])])
        yield from (batch.slice(a, b - a) for a, b in zip(heads[:-1], heads[1:], strict=True))
        held = [batch.take(pa.array(np.arange(heads[-1], len(tile))))]
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _tile_members(similarity: float):
    """Rows of tiles, without counts, that lengths and word counts let be similar to one of another component there."""

    def run(batches):
        held, rows = [], 0
        for tile in _by_tile(batches):
            left = tile.column("left").to_numpy(zero_copy_only=False)
            component, n, counts = tile.column("component").to_numpy(), tile.column("n_words").to_numpy(), _counts(tile.column("counts"))
            one = np.flatnonzero(left)
            two = np.flatnonzero(~left) if not left.all() else one
            keep = np.zeros(tile.num_rows, bool)
            for i in one:
                j = two[two > i] if two is one else two
                limit = _limit(np.maximum(n[i], n[j]), similarity)
                near = (component[j] != component[i]) & (np.abs(n[i] - n[j]) <= limit)
                j, limit = j[near], limit[near]
                j = j[np.abs(counts[j] - counts[i]).sum(axis=1) <= 2 * limit]
                keep[j] = True
                keep[i] |= len(j) > 0
            if keep.any():
                held.append(tile.select(["repeat", "key", "one", "two", "left", "cid", "component"]).filter(pa.array(keep)))
                rows += held[-1].num_rows
            if rows >= HELD:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _pair_batch(found) -> pa.RecordBatch:
    found = sorted(set(found))
    return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_documents(docs: DataFrame, key: str, text: str, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``: the written rows of ``docs`` with a row number, and the group of each.

    ``rows`` has all columns of ``docs`` and ``groups.columns[0]``, a number that is unique and fixed once written.
    ``groups`` has that number, ``key``, ``class_id`` (the least key of the group, nulls last), ``kept`` (one row of each
    group: of the least key, and of its rows one) and ``n_words``.

    Texts are words, runs of ASCII letters (folded) and digits and of other non-ASCII characters. Two texts are linked
    when their edit distance in words is at most ``1 - similarity`` of the longer one's words and when they share a
    bucket: under one of REPEATS hash orders the same two least shingles of two words (or a word and an edge of the
    text), each told apart from its earlier copies in the text, in the same text order. Buckets are drawn by hash: an
    isolated pair that shares none stays apart, which becomes likely only well below a similarity of 0.8 (the README has
    figures). Groups are what links connect. Texts with equal words are always
    linked; texts without words (null ones count as empty) only when they are equal. Any columns may be null, rows may
    repeat, and an empty table gives empty results.

    Equal texts are one class from the start. Each class is first compared with one other, the least of most of its
    buckets; only where verified links leave a bucket in several components are all its members compared across these,
    in tiles that hold their texts: pairs with too few words in common go, others are aligned. So a group of any size costs a pair per member,
    and no pair of different texts that share a bucket is lost that is not connected already.
    """
    row, = fresh_names(docs.columns, "row")
    work = settle(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    picked = work.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    schema = "row bigint, same binary, n_words bigint, keys array<bigint>, counts binary"
    sketches = settle(picked.mapInArrow(_sketch, schema), "sketches")
    classes = settle(
        sketches.groupBy("same").agg(
            F.min("row").alias("cid"), F.any_value("n_words").alias("n_words"), F.any_value("keys").alias("keys"), F.any_value("counts").alias("counts")
        ),
        "text-classes",
    )
    links = _links(classes, picked, similarity)
    reached = components(links, "a", "b").select(F.col("id").alias("cid"), "component")
    named = settle(
        classes.select("same", "cid").join(reached, "cid", "left").select("same", F.coalesce("component", "cid").alias("component")), "class-components"
    )
    ids = work.select(F.col(row).alias("row"), F.col(key).alias("id"))
    member = settle(sketches.select("row", "same", "n_words").join(named, "same").join(ids, "row").select("row", "id", "n_words", "component"), "members")
    first = settle(
        member.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).select(
            "component", F.col("first.id").alias("class_id"), F.col("first.row").alias("first_row")
        ),
        "firsts",
    )
    groups = member.join(first, "component").select(
        F.col("row").alias(row), F.col("id").alias(key), "class_id", (F.col("row") == F.col("first_row")).alias("kept"), "n_words"
    )
    return work, groups


def _links(classes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified pairs ``a < b`` of classes that connect all candidates which are similar enough."""
    slim = classes.select("cid", "n_words", "counts")
    keyed = classes.where("n_words > 0").select("cid", "n_words", F.posexplode("keys").alias("repeat", "key"))
    shared = settle(
        keyed.groupBy("repeat", "key").agg(F.min("cid").alias("anchor"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets"
    )
    members = settle(keyed.join(shared, ["repeat", "key"]).select("repeat", "key", "anchor", "n", "cid", "n_words"), "bucket-members")
    # All texts move once; what follows reads those of bucket members only.
    texts = settle(texts.join(members.select(F.col("cid").alias("row")).distinct().hint("merge"), "row", "left_semi"), "member-texts")

    # One pair for each class: with the least class of most of its buckets.
    stars = members.where("cid <> anchor").groupBy("cid").agg(F.mode("anchor", True).alias("a")).select("a", F.col("cid").alias("b"))
    for side in ("a", "b"):
        stars = stars.join(slim.select(F.col("cid").alias(side), F.col("n_words").alias(f"n_{side}"), F.col("counts").alias(f"counts_{side}")), side)
    close = stars.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(_plausible(similarity), "a bigint, b bigint")
    close = settle(close, "star-pairs")
    first = settle(_verified(close, texts, similarity), "star-links")

    reached = components(first, "a", "b").select(F.col("id").alias("cid"), "component")
    split = settle(members.join(reached, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "bucket-components")
    mixed = settle(
        split.groupBy("repeat", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("repeat", "key"), "mixed-buckets"
    )
    split = settle(split.join(mixed, ["repeat", "key"], "left_semi"), "mixed-members")
    # A bucket of n members has ceil(n / TILE) blocks, and a tile for each pair of them: the smaller number is left.
    blocks = split.withColumn("blocks", F.ceil(F.col("n") / TILE).cast("bigint"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    tile = ["repeat", "key", "one", "two"]
    tiles = blocks.select(
        "repeat", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
        (F.col("own") <= F.col("other")).alias("left"), "cid", "component", "n_words",
    )
    # Texts join only the members that word counts do not rule out.
    tiles = tiles.join(slim.select("cid", "counts").hint("merge"), "cid").repartition(*tile).sortWithinPartitions(*tile)
    schema = "repeat int, key bigint, one bigint, two bigint, left boolean, cid bigint, component bigint"
    tiles = settle(tiles.select(*tile, "left", "cid", "component", "n_words", "counts").mapInArrow(_tile_members(similarity), schema), "tile-members")
    held = texts.withColumnRenamed("row", "cid").join(tiles.select("cid").distinct().hint("merge"), "cid", "left_semi")
    held = held.join(classes.select("cid", "keys").hint("merge"), "cid")
    tiles = tiles.join(held.hint("merge"), "cid").repartition(*tile).sortWithinPartitions(*tile)
    more = settle(tiles.mapInArrow(_tile_links(similarity), "a bigint, b bigint"), "tile-links")
    return first.unionByName(more)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts are similar enough."""
    # Sorted joins at every size: what they move then grows with the input, and Spark splits a hot class.
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("row").alias(side), F.col("text").alias(f"text_{side}")).hint("merge"), side)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verify(similarity), "a bigint, b bigint")


def keep_first(docs: DataFrame, key: str, text: str, similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``near_documents``, with the columns of ``docs``."""
    work, groups = near_documents(docs, key, text, similarity)
    kept = groups.where("kept").select(groups.columns[0]).hint("merge")
    return work.join(kept, groups.columns[0], "left_semi").select(*docs.columns)
