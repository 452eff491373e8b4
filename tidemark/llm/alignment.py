"""Edit distances of many pairs of integer sequences at once, by banded alignment."""

from __future__ import annotations

import numpy as np

# Cells of the band of one row, over all pairs aligned together.
_CELLS = 1 << 17
_FAR = np.int32(1 << 29)


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences without their common start and end, which no best alignment needs."""
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    low = int(diff[0]) if len(diff) else n
    a, b = a[low:], b[low:]
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    high = int(diff[0]) if len(diff) else n
    return a[: len(a) - high], b[: len(b) - high]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two multisets."""
    values, counts = np.unique(a, return_counts=True)
    other, more = np.unique(b, return_counts=True)
    at = np.searchsorted(other, values)
    at[at == len(other)] = 0
    same = other[at] == values if len(other) else np.zeros(len(values), bool)
    return int(np.minimum(counts[same], more[at[same]]).sum())


def possible(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether counts leave room for a distance of at most ``limit``: an edit changes one word and two word pairs."""
    longest = max(len(a), len(b))
    if abs(len(a) - len(b)) > limit:
        return False
    if longest - _shared(a, b) > limit:
        return False
    factor = np.uint64(0x9E3779B97F4A7C15)
    return longest - 1 - _shared(a[:-1] * factor + a[1:], b[:-1] * factor + b[1:]) <= 2 * limit


def _band(pairs: list[tuple[np.ndarray, np.ndarray]], half: int) -> np.ndarray:
    """Distances of the pairs, right where they are at most ``half``; cells within ``half`` of the diagonal only."""
    count, width = len(pairs), 2 * half + 1
    rows = np.array([len(a) for a, _ in pairs])
    columns = np.array([len(b) for _, b in pairs])
    most = int(rows.max(initial=0))
    left = np.zeros((count, most), np.uint64)
    right = np.zeros((count, most + width), np.uint64)
    gap_left = np.ones((count, most), bool)
    gap_right = np.ones((count, most + width), bool)
    for p, (a, b) in enumerate(pairs):
        left[p, : len(a)], gap_left[p, : len(a)] = a, False
        stop = min(len(b), most + width - half)
        right[p, half : half + stop], gap_right[p, half : half + stop] = b[:stop], False
    step = np.arange(width, dtype=np.int32)
    now = np.where(step < half, _FAR, step - half)[None].repeat(count, axis=0).astype(np.int32)
    end = np.clip(columns - rows + half, 0, width - 1)
    out = np.full(count, _FAR)
    out[rows == 0] = now[np.flatnonzero(rows == 0), end[rows == 0]]
    after = np.full((count, width), _FAR, np.int32)
    for i in range(most):
        differ = (left[:, i, None] != right[:, i : i + width]) | gap_left[:, i, None] | gap_right[:, i : i + width]
        after[:, :-1] = now[:, 1:] + 1
        now = np.minimum(now + differ, after) - step
        now = np.minimum.accumulate(now, axis=1) + step
        done = np.flatnonzero(rows == i + 1)
        if len(done):
            out[done] = now[done, end[done]]
    out[np.abs(columns - rows) > half] = _FAR
    return out


def within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its limit.

    Pairs that counts rule out go first. The others are aligned within a narrow band, side by side with pairs of like
    length; where a band does not settle a pair, it is doubled until it covers the limit.
    """
    limits = np.asarray(limits, np.int64)
    result = np.zeros(len(pairs), bool)
    cut, todo = {}, []
    for p, (a, b) in enumerate(pairs):
        a, b = trimmed(a, b)
        if not len(a) or not len(b):
            result[p] = max(len(a), len(b)) <= limits[p]
        elif possible(a, b, int(limits[p])):
            cut[p] = (a, b)
            todo.append(p)
    half = 4
    while todo:
        half = half * 2
        todo.sort(key=lambda p: len(cut[p][0]))
        room = max(1, _CELLS // (2 * half + 1))
        left = []
        for low in range(0, len(todo), room):
            group = todo[low : low + room]
            distance = _band([cut[p] for p in group], half)
            for p, d in zip(group, distance.tolist(), strict=True):
                if d <= half or half >= limits[p]:
                    result[p] = d <= min(half, limits[p])
                else:
                    left.append(p)
        todo = left
    return result
