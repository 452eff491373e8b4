from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.edges import LONG, ROWS, documents
from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import common_prefixes, merge_sorted, remove_repeats, suffix_array


@pytest.mark.parametrize("text", [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"mississippi" * 5, b"abcabcabdabcabcabe" * 9, bytes(range(200))])
def test_suffix_array_and_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    order = suffix_array(data)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    expected = []
    for a, b in zip([None, *order[:-1].tolist()], order.tolist(), strict=True) if text else []:
        n = 0
        while a is not None and n < len(text) - max(a, b) and text[a + n] == text[b + n]:
            n += 1
        expected.append(n)
    assert common_prefixes(data, order).tolist() == expected


def test_random_suffix_arrays():
    rng = np.random.default_rng(8)
    for size in (50, 300, 2000):
        text = rng.integers(97, 99, size).astype(np.uint8).tobytes()
        text += text[: size // 2]
        data = np.frombuffer(text, np.uint8)
        order = suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_merge():
    assert merge_sorted([np.array(x, np.uint64) for x in ([1, 5, 9], [], [0, 5, 10], [2])]).tolist() == [0, 1, 2, 5, 9, 10]
    assert merge_sorted([]).tolist() == []


def brute(rows, size):
    """Per row: bytes, removed, spans, kept; rows in their order."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - size + 1):
            window = data[s : s + size]
            if window in seen:
                gone[s : s + size] = b"\1" * size
            seen.add(window)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(data), sum(gone), runs, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("shard_bytes", [500, 10_000_000])
def test_matches_brute_force(spark, shard_bytes):
    rng = random.Random(4)
    passages = ["".join(rng.choices("abcdé ", k=rng.randrange(8, 60))) for _ in range(12)]
    texts = ["".join(rng.choices([*passages, "x", "yz", "ab", str(i)], k=rng.randrange(0, 14))) for i in range(120)]
    texts += [texts[5], texts[5], "a" * 90, "a" * 35, "", None, "é" * 20]
    rows = [(7 * i - 100, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(frame, "doc_id", "text", 10, shard_bytes).collect()}
    assert got == {k: x for (k, _), x in zip(rows, brute(rows, 10), strict=True)}


def test_many_shards_of_one_passage(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    rng = random.Random(2)
    shared = "".join(rng.choices("abcdefgh", k=150))
    texts = ["".join(rng.choices("abcdefgh", k=80)) + shared + "".join(rng.choices("abcdefgh", k=70)) for _ in range(40)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(frame, "doc_id", "text", 100, 600).collect()}
    assert got == {k: x for (k, _), x in zip(rows, brute(rows, 100), strict=True)}
    assert sum(x[1] > 0 for x in got.values()) == 39


def test_edges(spark):
    out = remove_repeats(documents(spark), "doc_id", "text", 30).collect()
    assert len(out) == len(ROWS)
    ones = sorted(r["n_removed"] for r in out if r["doc_id"] == 1)
    # A null id is the smallest, so both rows of document 1 repeat its text.
    assert ones == [63, 63] and {r["n_removed"] for r in out if r["doc_id"] is None} == {0}
    long, = (r for r in out if r["doc_id"] == 5)
    assert long["n_removed"] == len(LONG) - 39 and long["n_spans"] == 1
    assert remove_repeats(documents(spark).where("false"), "doc_id", "text").count() == 0
