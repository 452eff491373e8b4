from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.llm import vectors
from tidemark.llm.vectors import linked, near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, cid bigint, size int, tile string"


def brute(rows, threshold):
    def sane(r):
        v = r[1]
        return r[2] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sane(rows[i]) and sane(rows[j]) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    big = 1 << 62
    low = [min((rows[j][0] if rows[j][0] is not None else big) for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))]
    return sorted((str(r[0]), n, str(None if c == big else c), r[0] == (None if c == big else c)) for r, n, c in zip(rows, links, low, strict=True))


@pytest.mark.parametrize("tile", [3, 1024])
def test_matches_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(9)
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(6, 20))
        for k in range(40):
            v = centres[k % 6] + rng.normal(size=20) * (0.02 if k % 2 else 0.16)
            rows.append((len(rows) * 5 % 211, v.astype(np.float32).tolist(), label))
    same = rows[3][1]
    rows += [(900 + i, same, 0) for i in range(9)]  # equal vectors
    rows += [(950, None, 0), (951, [0.0] * 20, 0), (952, [*same[:-1], None], 0), (953, [*same[:-1], float("nan")], 0), (954, [float("inf")] * 20, 1)]
    rows += [(955, same[:10], 0), (956, same[:10], 0), (None, same, 0), (957, [2 * x for x in same], 0), (957, same, 1), (958, [], 1)]
    frame = spark.createDataFrame([(*r, 1, 1, "t") for r in rows], SCHEMA).repartition(3)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in near_vectors(frame, "vec_id", "embedding", "label").collect())
    assert got == brute(rows, 0.98)


def test_nothing_to_compare(spark):
    frame = spark.createDataFrame([(1, None, 0, 1, 1, ""), (2, [0.0], 0, 1, 1, "")], SCHEMA)
    assert sorted(near_vectors(frame, "vec_id", "embedding", "label").collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors(frame.where("false"), "vec_id", "embedding", "label").count() == 0


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 24)) * np.linspace(2, 0.1, 24)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = linked(x, x, 0.8, [4, 8, 24])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {tuple(p) for p in np.argwhere(x @ x.T >= 0.8).tolist()}


def test_tiny_and_huge_vectors_link(spark):
    """Neither squares that vanish nor squares that overflow decide."""
    pairs = [([1e-200, 2e-200], [1.01e-200, 2e-200]), ([1e200, 2e200], [1e200, 2.01e200]), ([5e-324, 0.0], [1e-310, 0.0]), ([1.7e308, -1.7e308], [1.6e308, -1.7e308])]
    rows = [(10 * i + j, v, i) for i, pair in enumerate(pairs) for j, v in enumerate(pair)] + [(90, [4.0, 3.0], 0), (91, [1e-200, -2e-200], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(frame, "vec_id", "embedding", "label").collect()}
    for i in range(len(pairs)):
        assert got[10 * i][0] == got[10 * i + 1][0] == 1 and got[10 * i + 1][1] == 10 * i
    assert got[90] == (0, 90) and got[91] == (0, 91)
