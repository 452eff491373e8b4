from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.edges import PLAIN, documents
from tidemark.llm import order_minhash
from tidemark.llm.alignment import within
from tidemark.llm.columns import hashed_words
from tidemark.llm.order_minhash import keep_first, near_documents


def distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows) -> dict:
    """Class of every id by all pairs."""
    words, at = hashed_words(pa.array([t for _, t in rows], pa.string()))
    texts = [words[at[i] : at[i + 1]].tolist() for i in range(len(rows))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = max(len(texts[i]), len(texts[j]))
            same = distance(texts[i], texts[j]) <= int(0.2 * n + 1e-9) if n else (rows[i][1] or "") == (rows[j][1] or "")
            if same and min(len(texts[i]), len(texts[j])) >= 0.8 * n:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [f"n{rng.random()}"], [words[k], f"m{rng.random()}"]])
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(25)]
    rows, number = [], 0
    for _ in range(12):  # unlike texts that share a passage
        rows.append(" ".join([*rng.choices(vocabulary, k=30), *passage, *rng.choices(vocabulary, k=30)]))
    base = rng.choices(vocabulary, k=80)
    rows += [" ".join(edited(rng, base, 2)) for _ in range(60)]  # a group of near copies
    chain = rng.choices(vocabulary, k=100)
    for _ in range(6):  # each like the one before it only
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 9)
    rows += [rows[20].upper() + "!", rows[3], rows[3], "a b c", "a b c", "a b d", "", "", "?!", None]
    return [(number + 3 * i, t) for i, t in enumerate(rows)]


def test_groups_match_all_pairs(spark, corpus, monkeypatch):
    monkeypatch.setattr(order_minhash, "TILE", 4)
    rows, groups = near_documents(spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(5), "doc_id", "text")
    found = {r["doc_id"]: r for r in groups.collect()}
    expected = brute(corpus)
    assert {k: r["class_id"] for k, r in found.items()} == expected
    assert {k for k, r in found.items() if r["kept"]} == set(expected.values())
    assert rows.count() == len(corpus)


def test_isolated_borderline_pairs_are_found(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        n = (5, 10, 20, 40, 100)[i % 5]
        one = [f"w{i}x{k}" for k in range(n)]
        two = list(one)
        for k in rng.sample(range(n), n // 5):
            two[k] = f"v{i}x{k}"
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    _, groups = near_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    classes = {r["doc_id"]: r["class_id"] for r in groups.collect()}
    assert all(c in (d, d - d % 2) for d, c in classes.items())
    assert sum(classes[2 * i + 1] == 2 * i for i in range(400)) >= 398


def test_edges(spark):
    frame = documents(spark)
    kept = keep_first(frame, "doc_id", "text")
    assert kept.columns == frame.columns
    # Equal plain texts are one group, whatever their id; null and empty texts are another; white space is its own.
    assert sorted(r["doc_id"] for r in kept.collect()) == [-7, 1, 2, 4, 5, 6]
    assert keep_first(frame.where("false"), "doc_id", "text").count() == 0


def test_repeated_null_rows_leave_one(spark):
    frame = documents(spark, [(None, PLAIN, *[None] * 8)] * 4)
    assert keep_first(frame, "doc_id", "text").count() == 1


def test_alignment_matches_dynamic_programming():
    rng = np.random.default_rng(3)
    pairs, limits, expected = [], [], []
    for _ in range(150):
        a = rng.integers(0, 4, rng.integers(0, 40)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 12)):
            k = rng.integers(0, len(b) + 1)
            b = np.insert(b, k, 9) if rng.random() < 0.5 or not len(b) else np.delete(b, min(k, len(b) - 1))
        limit = int(rng.integers(0, 12))
        pairs.append((a, b))
        limits.append(limit)
        expected.append(distance(a.tolist(), b.tolist()) <= limit)
    assert within(pairs, np.array(limits)).tolist() == expected


def test_order_matters_to_the_sketch():
    words = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    turned = np.concatenate([words[20:], words[:20]])
    both = np.concatenate([words, turned])
    hashes, offsets = order_minhash.labelled_shingles(both, np.array([0, 40, 80]))
    one, two = order_minhash.order_sketches(hashes, offsets)
    assert 0 < (one == two).sum() < order_minhash.REPEATS


def test_repeated_shingles_are_told_apart():
    words = np.tile(np.arange(1, 6, dtype=np.uint64), 6)
    hashes, offsets = order_minhash.labelled_shingles(words, np.array([0, len(words)]))
    assert len(np.unique(hashes)) == len(hashes) == offsets[-1] == 26
    once, _ = order_minhash.labelled_shingles(words[:9], np.array([0, 9]))
    assert (once == hashes[:5]).all()


def test_shared_words_are_never_undercounted():
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 60, rng.integers(1, 90))) for _ in range(30)]
    words, rows = hashed_words(pa.array(texts))
    marks = order_minhash._marks(words, rows)
    for i in range(30):
        bound = order_minhash._shared_marks(marks, rows, i, np.arange(30))
        exact = [sum((Counter(texts[i].split()) & Counter(t.split())).values()) for t in texts]
        assert (bound >= exact).all() and (bound <= np.array(exact) + 2).all()


def test_words_of_many_texts_take_little_besides():
    texts = [None, "", "One ünï", *[f"{PLAIN} {i} " * 40 for i in range(2000)], "☃ " * 700_000, "", "last"]
    column = pa.array(texts, pa.string())
    tracemalloc.start()
    words, rows = hashed_words(column)
    most = tracemalloc.get_traced_memory()[1] - 2 * words.nbytes - column.nbytes
    tracemalloc.stop()
    assert column.nbytes > 6 << 20 and most < 200 << 20
    assert len(rows) == len(texts) + 1
    for i in (0, 1, 2, 3, 700, 2002, 2003, 2004, 2005):
        assert words[rows[i] : rows[i + 1]].tolist() == hashed_words(pa.array([texts[i]], pa.string()))[0].tolist()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_tiles_of_any_batches(size):
    rng = random.Random(size)
    keys = sorted((rng.randrange(2), rng.randrange(3), rng.randrange(2), rng.randrange(2)) for _ in range(60))
    names = ["repeat", "key", "one", "two"]
    columns = [pa.array([k[0] for k in keys], pa.int32()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)], pa.array(range(60))]
    batch = pa.RecordBatch.from_arrays(columns, [*names, "cid"])
    batches = [batch.slice(i, size) for i in range(0, 60, size)]
    tiles = list(order_minhash._by_tile(iter([batch.slice(0, 0), *batches, batch.slice(0, 0)])))
    assert [t.column("cid").to_pylist() for t in tiles] == [[i for i in range(60) if keys[i] == k] for k in sorted(set(keys))]
    assert list(order_minhash._by_tile(iter([]))) == []
