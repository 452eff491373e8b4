"""Numpy arrays in binary cells: what one task sends another in few rows."""

from __future__ import annotations

import struct

import numpy as np

_CODES = {c: np.dtype(c) for c in ("u1", "<u2", "<u4", "<u8", "<i8", "<f8")}
_KINDS = list(_CODES)


def narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type that holds all of them."""
    top = int(values.max(initial=0))
    return values.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def split_small(values: np.ndarray) -> list[np.ndarray]:
    """Non-negative integers of which most are small: one byte each, and places and values of those above 254."""
    large = np.flatnonzero(values > 254)
    return [np.minimum(values, 255).astype("u1"), narrow(large), narrow(values[large])]


def join_small(parts) -> np.ndarray:
    small, at, large = (next(parts) for _ in range(3))
    out = small.astype(np.int64)
    out[at.astype(np.int64)] = large
    return out


def pack(*arrays: np.ndarray) -> bytes:
    head = [struct.pack("<H", len(arrays))]
    for a in arrays:
        head.append(struct.pack("<BQ", _KINDS.index(next(k for k, t in _CODES.items() if t == a.dtype)), len(a)))
    return b"".join([*head, *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(body: bytes):
    """Iterate over the arrays of ``pack``."""
    count, = struct.unpack_from("<H", body)
    at = 2 + 9 * count
    for k in range(count):
        kind, size = struct.unpack_from("<BQ", body, 2 + 9 * k)
        dtype = _CODES[_KINDS[kind]]
        yield np.frombuffer(body, dtype, size, at)
        at += size * dtype.itemsize
