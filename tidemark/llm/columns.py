"""Texts of Arrow batches as flat numpy arrays: bytes, words, hashes, segment reductions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes worked on at once; temporary arrays take some ten to forty times as much.
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(0x5EED)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

# Letters and digits of folded ASCII, and every byte of a longer UTF-8 sequence.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True

# All but the six ASCII white-space bytes.
VISIBLE_BYTES = np.ones(256, bool)
VISIBLE_BYTES[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the splitmix finaliser), one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """``names`` with leading underscores until none is taken, whatever the case."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name = "_" + name
        out.append(name)
    return out


def byte_slices(batches, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of the batches that hold at most ``limit`` text bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(length + 1, _BASE), np.full(length + 1, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least up to ``length``."""
    return _powers(1 << max(20, int(length).bit_length()))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes have equal hashes, anywhere."""
    up, down = powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _BASE)


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, which end with their row, and each row's first word."""
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(column, member: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the ASCII-folded texts, and the offset of each row's first.

    Rows of SLICE_BYTES are worked on at once, as temporary arrays and tables of powers grow with them.
    """
    raw, offsets = text_buffer(column)
    words, rows, low = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1)
        data = FOLD[raw[offsets[low] : offsets[high]]]
        starts, ends, first = word_spans(data, offsets[low : high + 1] - offsets[low], member)
        words.append(span_hashes(data, starts, ends))
        rows.append(first[1:] + rows[-1][-1])
        low = high
    return np.concatenate(words), np.concatenate(rows)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive words from each position; windows may cross rows."""
    count = max(0, len(words) - size + 1)
    total = np.zeros(count, np.uint64)
    for i, factor in enumerate(powers(size)[0][:size]):
        total += words[i : i + count] * factor
    return mix(total)


def ragged_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``counts[0]`` values, then the next start, and so on."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, counts)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment ``values[offsets[i]:offsets[i + 1]]``; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
