"""Removal of repeated passages by suffix arrays of shards that are merged across shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import BYTE_CODES, mix, powers, ragged_ranges, segment_sums, span_hashes, text_buffer
from tidemark.llm.packets import narrow, pack, unpack

# Bytes of the text that one shard holds, about, and of the piece of it that is hashed at once.
SHARD_BYTES = 4 << 20
SEGMENT = 1 << 19
# A byte no UTF-8 text holds.
SEPARATOR = 0xFF


# --- suffix arrays -------------------------------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by Larsson and Sadakane's refinement.

    Suffixes are sorted by eight bytes first. Every round doubles the sorted length: only groups of suffixes that still
    tie are sorted again, by the rank of the suffix that many bytes on.
    """
    n = len(data)
    key = _words(data)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def ranks_of(new: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Position of each element's group head; ``start`` is each element's place in the whole order."""
        return start[np.flatnonzero(new)][np.cumsum(new) - 1]

    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    rank[order] = ranks_of(new, np.arange(n)) if n else rank
    tied = ~(new & np.append(new[1:], True)) if n else new
    places = np.flatnonzero(tied)
    h = 8
    while len(places):
        suffixes = order[places]
        ahead = suffixes + h
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[suffixes] * (n + 1) + following
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[places] = suffixes
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffixes] = ranks_of(new, places)
        places = places[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix, in order, with the one before it (0 for the first).

    Kasai's observation: in text order a length is at most one below that of the position before. Where the bytes
    before a suffix and before its neighbour agree, it is exactly one below; only the other positions are compared.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    has = before >= 0
    position = np.arange(n)
    follows = has & (position > 0) & (before > 0)
    follows[follows] = data[position[follows] - 1] == data[before[follows] - 1]
    fresh = np.flatnonzero(has & ~follows)
    length = np.zeros(n, np.int64)
    words = _words(data)
    active, a, b = fresh, fresh, before[fresh]
    while len(active):
        same = (a + 8 <= n) & (b + 8 <= n)
        same[same] = words[a[same]] == words[b[same]]
        ends = np.flatnonzero(~same)
        if len(ends):  # byte by byte in the last word, all such suffixes at once
            x, y = a[ends], b[ends]
            extra = np.zeros(len(ends), np.int64)
            going = np.ones(len(ends), bool)
            for k in range(8):
                going &= (x + k < n) & (y + k < n)
                going[going] = data[x[going] + k] == data[y[going] + k]
                extra += going
            length[active[ends]] += extra
        length[active[same]] += 8
        active, a, b = active[same], a[same] + 8, b[same] + 8
    # A following position is one below the one before it, on from the last compared (or first) position.
    anchor = np.maximum.accumulate(np.where(follows, -1, position))
    length = np.where(follows, length[anchor] - (position - anchor), length)
    out = length[order]
    out[:1] = 0
    return out


def repeat_groups(data: np.ndarray, size: int) -> np.ndarray:
    """A number for each position that is the same where the next ``size`` bytes are."""
    order = suffix_array(data)
    groups = np.empty(len(data), np.int64)
    groups[order] = np.cumsum(common_prefixes(data, order) < size)
    return groups


# --- windows and their anchors -------------------------------------------------------------------------------------


def window_runs(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs ``(first, last, place, hash)`` of neighbouring windows of ``size`` bytes, inside one text, with one anchor.

    A window's anchor is the place in it where a third of it has the least hash (the leftmost of equals): equal windows
    have equal anchors at the same distance, wherever they are. Memory is bounded by SEGMENT, not by the text.
    """
    gram = max(1, size // 3)
    span = size - gram + 1
    valid = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= size)
    valid[offsets[long]] += 1
    valid[offsets[long + 1] - size + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for low in range(0, len(data), SEGMENT):
        high = min(low + SEGMENT, len(data) - size + 1)
        if high <= low or not valid[low:high].any():
            continue
        piece = data[low : high + size - 1]
        up, down = powers(len(piece))
        prefix = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE_CODES[piece] * up[: len(piece)], out=prefix[1:])
        count = len(piece) - gram + 1
        value = (prefix[gram:] - prefix[:count]) * down[:count]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        least = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + low
        starts = np.flatnonzero(valid[low:high])
        place = place[starts]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(starts)) - 1
        anchors = place[heads]
        hashes = mix(value[anchors - low])
        for out, x in zip(parts, (starts[heads] + low, starts[tails] + low, anchors, hashes), strict=True):
            out.append(x)
    first, last, anchor = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts[:3])
    hashes = np.concatenate(parts[3]) if parts[3] else np.zeros(0, np.uint64)
    if len(first):  # a run cut by the end of a segment is one
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1)])
        heads = np.flatnonzero(new)
        last = last[np.append(heads[1:], len(first)) - 1]
        first, anchor, hashes = first[heads], anchor[heads], hashes[heads]
    return first, last, anchor, hashes


class Shard:
    """The texts of a shard in order, as one run of bytes."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table, [("id", "ascending"), ("tie", "ascending")], null_placement="at_start")
        self.table = table.take(order)
        self.data, self.offsets = text_buffer(self.table.column("text"))

    def order_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """What texts are ordered by across shards: the id, null as the smallest number, and the hash of row and text."""
        ids = pc.fill_null(self.table.column("id"), -(2**63)).to_numpy().astype("<i8")
        return ids, self.table.column("tie").to_numpy().astype("<i8")


def local_repeats(data: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Starts, among those of the given runs, whose window also starts earlier in one of the runs."""
    if not len(first):
        return np.zeros(0, np.int64)
    # Stretches of text that the runs' windows cover, behind one another with a separator between.
    begin, end = first, last + size
    gap = np.concatenate([[True], begin[1:] > np.maximum.accumulate(end)[:-1]])
    heads = np.flatnonzero(gap)
    begins, ends = begin[heads], np.maximum.accumulate(end)[np.append(heads[1:], len(end)) - 1]
    lengths = ends - begins
    at = np.cumsum(lengths + 1) - lengths - 1
    text = np.full(int((lengths + 1).sum()), SEPARATOR, np.uint8)
    text[ragged_ranges(at, lengths)] = data[ragged_ranges(begins, lengths)]
    groups = repeat_groups(text, size)
    starts = ragged_ranges(first, last - first + 1)
    home = np.searchsorted(begins, starts, side="right") - 1
    group = groups[starts - begins[home] + at[home]]
    _, leader = np.unique(group, return_index=True)  # the first occurrence: starts ascend
    earliest = np.zeros(len(starts), bool)
    earliest[leader] = True
    return starts[~earliest]


def _intervals(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as runs: first numbers and lengths."""
    if not len(values):
        return values, values
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1] + 1]))
    return values[heads], np.diff(np.append(heads, len(values)))


# --- tasks ---------------------------------------------------------------------------------------------------------

PACKET = "place string, shard bigint, body binary"


def _packets(places, shard: int, bodies) -> pa.Table:
    return pa.table({"place": pa.array(places, pa.string()), "shard": pa.array([shard] * len(bodies), pa.int64()), "body": pa.array(bodies, pa.binary())})


def _bucketed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and each bucket's edges in it."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _send_anchors(size: int, buckets: int):
    """From a shard to each bucket: the anchor hashes the shard has there, each once."""

    def run(key, table):
        shard = Shard(table)
        hashes = np.unique(window_runs(shard.data, shard.offsets, size)[3])
        order, edges = _bucketed(hashes, buckets)
        used = np.flatnonzero(np.diff(edges))
        return _packets([str(b) for b in used], key[0].as_py(), [pack(hashes[order[edges[b] : edges[b + 1]]]) for b in used])

    return run


def _shared_anchors():
    """From a bucket to each shard: which of its anchors another shard has too."""

    def run(key, table):
        sent = [next(unpack(b.as_py())) for b in table.column("body")]
        _, at, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        shared = np.split(counts[at] > 1, np.cumsum([len(s) for s in sent])[:-1])
        bodies = [pack(np.packbits(s)) for s in shared]
        return pa.table({"shard": table.column("shard"), "bucket": pa.array([int(key[0].as_py())] * len(bodies)), "body": pa.array(bodies, pa.binary())})

    return run


def _send_windows(size: int, buckets: int):
    """Find repeats inside a shard; send what may repeat elsewhere to the buckets, in order of its bytes.

    The shard itself gets a packet with the starts that repeat an earlier one inside it and with the places of what was
    sent. Only the first occurrence in a shard goes out, so a passage costs as many rows as there are shards.
    """

    def run(key, table, replies):
        number = key[0].as_py()
        shard = Shard(table)
        first, last, anchor, hashes = window_runs(shard.data, shard.offsets, size)
        known, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = np.zeros(len(known), bool)
        order, edges = _bucketed(known, buckets)
        for b, body in zip(replies.column("bucket").to_numpy(), replies.column("body"), strict=True):
            mine = order[edges[b] : edges[b + 1]]
            shared[mine] = np.unpackbits(next(unpack(body.as_py())), count=len(mine)).astype(bool)
        twice = counts[at] > 1
        later = local_repeats(shard.data, first[twice], last[twice], size)
        # Of each run with a shared anchor, the stretch from its first to its last start that is not a repeat already.
        sent = np.flatnonzero(shared[at])
        starts = ragged_ranges(first[sent], (last - first + 1)[sent])
        owner = np.repeat(np.arange(len(sent)), (last - first + 1)[sent])
        where = np.searchsorted(later, starts)
        new = ~(np.append(later, -1)[where] == starts)
        low, high = np.full(len(sent), np.iinfo(np.int64).max), np.full(len(sent), -1)
        np.minimum.at(low, owner[new], starts[new])
        np.maximum.at(high, owner[new], starts[new])
        has = high >= 0
        sent, low, high = sent[has], low[has], high[has]
        text = np.searchsorted(shard.offsets, low, side="right") - 1
        ids, ties = shard.order_keys()
        order, edges = _bucketed(hashes[sent], buckets)
        places, bodies = [], []
        for b in np.flatnonzero(np.diff(edges)):
            mine = order[edges[b] : edges[b + 1]]
            k = sent[mine]
            docs, doc = np.unique(text[mine], return_inverse=True)
            lengths = high[mine] - low[mine] + size
            bodies.append(
                pack(
                    hashes[k], narrow(doc), ids[docs], ties[docs], narrow(anchor[k] - low[mine] + size), narrow(lengths),
                    shard.data[ragged_ranges(low[mine], lengths)],
                )
            )
            places.append(str(b))
        bodies.append(pack(*map(narrow, _intervals(later)), narrow(low[order]), narrow((high - low + 1)[order]), narrow(edges)))
        return _packets([*places, f"shard {number}"], number, bodies)

    return run


def merge_sorted(lists: list[np.ndarray]) -> np.ndarray:
    """Different values of sorted lists, merged two by two: binary search finds where one list's values go in the other."""
    lists = [x for x in lists if len(x)] or [np.zeros(0, np.uint64)]
    while len(lists) > 1:
        merged = []
        for a, b in zip(lists[::2], lists[1::2], strict=False):
            at = np.searchsorted(a, b)
            extra = np.append(a, 0)[at] != b if len(a) else np.ones(len(b), bool)
            extra |= at == len(a)
            merged.append(np.insert(a, at[extra], b[extra]))
        if len(lists) % 2:
            merged.append(lists[-1])
        lists = merged
    return lists[0]


def _merge_windows(size: int):
    """In a bucket: which of the windows that shards sent start earlier in another; packets for shards pass through.

    A stretch that several shards sent alike counts once, with its earliest text: the sorted lists of the shards'
    stretches are merged by binary search. Anchors with one stretch left are done; the windows of the others are told
    apart by a suffix array over these stretches.
    """

    def run(key, table):
        place = key[0].as_py()
        if place.startswith("shard"):
            return pa.table({"shard": table.column("shard"), "bucket": pa.array([-1] * table.num_rows), "body": table.column("body")})
        order = np.argsort(table.column("shard").to_numpy())
        shards = table.column("shard").to_numpy()[order]
        anchors, ids, ties, distance, lengths, texts, sizes = [], [], [], [], [], [], []
        for i in order:
            h, doc, own_ids, own_ties, own_distance, own_lengths, text = unpack(table.column("body")[int(i)].as_py())
            anchors.append(h)
            ids.append(own_ids[doc])
            ties.append(own_ties[doc])
            distance.append(own_distance.astype(np.int64))
            lengths.append(own_lengths.astype(np.int64))
            texts.append(text)
            sizes.append(len(h))
        anchor, id_, tie, away, length, text = (np.concatenate(x) for x in (anchors, ids, ties, distance, lengths, texts))
        ends = np.cumsum(length)
        starts = ends - length
        content = mix(span_hashes(text, starts, ends) + anchor * np.uint64(3) + away.astype(np.uint64))
        edges = np.cumsum([0, *sizes])
        pool = merge_sorted([np.unique(content[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        same = np.searchsorted(pool, content)
        # Texts by rank; the earliest of each class of equal stretches.
        rank = np.empty(len(id_), np.int64)
        by = np.lexsort((tie, id_))
        step = np.concatenate([[False], (id_[by][1:] != id_[by][:-1]) | (tie[by][1:] != tie[by][:-1])])
        rank[by] = np.cumsum(step)
        earliest = np.full(len(pool), np.iinfo(np.int64).max)
        np.minimum.at(earliest, same, rank)
        example = np.empty(len(pool), np.int64)
        example[same] = np.arange(len(same))
        windows = length[example] - size + 1
        at = np.cumsum(windows) - windows
        best = np.repeat(earliest, windows)  # for every window of every class
        _, which, members = np.unique(anchor[example], return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(members[which] > 1)
        if len(mixed):
            long = length[example[mixed]]
            begin = np.cumsum(long + 1) - long - 1
            joined = np.full(int((long + 1).sum()), SEPARATOR, np.uint8)
            joined[ragged_ranges(begin, long)] = text[ragged_ranges(starts[example[mixed]], long)]
            groups = repeat_groups(joined, size)[ragged_ranges(begin, windows[mixed])]
            mine = ragged_ranges(at[mixed], windows[mixed])
            _, group = np.unique(groups, return_inverse=True)
            low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, group, best[mine])
            best[mine] = low[group]
        own = length - size + 1
        marked = np.repeat(rank, own) > best[ragged_ranges(at[same], own)]
        cuts = np.cumsum([0, *segment_sums(own, edges)])
        bodies = [pack(np.packbits(marked[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"shard": shards, "bucket": pa.array([int(place)] * len(bodies)), "body": pa.array(bodies, pa.binary())})

    return run


def _cut(size: int, key: str):
    """Remove marked windows from a shard's texts."""

    def run(_, table, marks):
        shard = Shard(table)
        bucket = marks.column("bucket").to_numpy()
        own = int(np.flatnonzero(bucket == -1)[0])
        first, count, low, number, edges = (x.astype(np.int64) for x in unpack(marks.column("body")[own].as_py()))
        cover = np.zeros(len(shard.data) + 1, np.int64)

        def mark(starts):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + size, -1)

        mark(ragged_ranges(first, count))
        for i in np.flatnonzero(bucket >= 0):
            mine = slice(edges[bucket[i]], edges[bucket[i] + 1])
            starts = ragged_ranges(low[mine], number[mine])
            bits = np.unpackbits(next(unpack(marks.column("body")[int(i)].as_py())), count=len(starts)).astype(bool)
            mark(starts[bits])
        gone = np.cumsum(cover[:-1]) > 0
        before = np.zeros(len(gone), bool)
        before[1:] = gone[:-1]
        inner = shard.offsets[:-1][shard.offsets[:-1] < len(gone)]
        before[inner] = False
        removed, spans = segment_sums(gone, shard.offsets), segment_sums(gone & ~before, shard.offsets)
        sizes = np.diff(shard.offsets)
        kept = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(kept), pa.py_buffer(shard.data[~gone])])
        return pa.table(
            {key: shard.table.column("id"), "kept": texts.cast(pa.binary()), "n_bytes": sizes, "n_removed": removed, "n_spans": spans}
        )

    return run


def remove_repeats(docs: DataFrame, key: str, text: str, size: int = 100, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row: ``key`` (long), ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``.

    Texts are UTF-8 bytes, null ones empty. A byte is removed when a string of ``size`` bytes inside one text that covers
    it also starts earlier: in a text of a smaller key, or earlier in the same text; strings are judged on the input.
    ``kept`` holds the rest, which need not be whole characters; ``n_spans`` counts removed stretches. A null key is
    smaller than any other; rows of one key are ordered by a hash of key and text, equal rows in any one order, so of
    repeated rows one is the first. Other columns are ignored; an empty table gives no rows.

    Texts are dealt to shards of some ``shard_bytes``. A shard finds its own repeats by its suffix array. Across shards a
    window is known by its anchor, the place in it of least hash, so equal windows meet in one bucket; shards first send
    anchor hashes and learn which of them others have, then the stretches around those. Texts are shuffled once.
    """
    picked = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    placed = picked.withColumn("tie", F.xxhash64("id", "text")).select(F.pmod("tie", F.lit(shards)).alias("shard"), "id", "tie", "text")
    texts = placed.groupBy("shard")
    anchors = texts.applyInArrow(_send_anchors(size, shards), PACKET)
    shared = anchors.groupBy("place").applyInArrow(_shared_anchors(), "shard bigint, bucket bigint, body binary")
    windows = texts.cogroup(shared.groupBy("shard")).applyInArrow(_send_windows(size, shards), PACKET)
    marks = windows.groupBy("place").applyInArrow(_merge_windows(size), "shard bigint, bucket bigint, body binary")
    schema = f"`{key}` bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
    return texts.cogroup(marks.groupBy("shard")).applyInArrow(_cut(size, key), schema)
