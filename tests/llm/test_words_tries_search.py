from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.edges import documents
from tidemark.llm import posting_lists, prefix_trie
from tidemark.llm.posting_lists import nearest_vectors
from tidemark.llm.prefix_trie import conversation_trie
from tidemark.llm.spelling import crc32_spans, near_words, pivots, spelling_variants

DOCS = "doc_id bigint, text string, word string, n bigint, form string, key int"
TURNS = "conv_id bigint, turn bigint, role string, text string, conv int, pos int, item string, name string, size int"
VECTORS = "vec_id bigint, embedding array<double>, id bigint, list int, h int, rank int"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_spelling(rows, least=6, count=5, factor=5, every=199):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def spelled(frame, **options):
    got = spelling_variants(frame, "doc_id", "text", **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


def test_spelling_matches_all_pairs(spark):
    rng = np.random.default_rng(5)
    letters = list("abé") + ["th", "ou"]
    words = list({"".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(260)})
    words = sorted(words)
    weights = 1 / (1.0 + rng.permutation(len(words))) ** 1.4
    weights /= weights.sum()
    rows = [(int(i) - 20, " ".join(rng.choice(words, 300, p=weights)) + "×÷ AbaÉé THouab." * (i % 3)) for i in range(60)]
    rows += [(None, "aaaaaaa aaaaaa " * 9), (3, None), (4, ""), (5, "abab"), (6, "aaaaaab-" * 5)]
    rows += [(7, "yyyyyx " * 5 + "yyyyyyx " * 26 + "yyyyyyyx " * 140 + "yyyyyyyyx " * 750)]
    frame = spark.createDataFrame([(*r, "w", 1, "f", 2) for r in rows], DOCS).repartition(5)
    want = brute_spelling(rows)
    assert len(want) > 60 and sum(w[1] is not None for w in want) > 5 and any(w[2] != (w[1] or w[0]) for w in want)
    assert spelled(frame) == want
    assert spelled(frame, every=7, least_count=3, factor=2) == brute_spelling(rows, count=3, every=7, factor=2)


def test_spelling_of_edge_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert spelled(documents(spark)) == brute_spelling(rows)
    assert spelled(documents(spark).where("false")) == []
    assert spelled(documents(spark).where("doc_id = 4")) == []


def test_all_words_of_few_letters_are_near(spark):
    """Words of equal grams have long prefixes; every pair is still found once."""
    words = sorted({"".join(w) for w in np.random.default_rng(2).choice(list("ab"), (300, 7))} | {"a" * k for k in range(6, 12)} | {"ab" * 4, "ba" * 4, "bab" * 2})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint")
    got = [(r["word"], r["other"]) for r in near_words(frame).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(8)
    for _ in range(200):
        places = np.sort(rng.choice(9, rng.integers(3, 7), replace=False))
        cost = rng.integers(0, 50, len(places))
        rank = np.argsort(np.argsort(cost, kind="stable"), kind="stable")
        word = np.zeros(len(places), np.int64)
        left, right = pivots(np.concatenate([word, word + 1]), np.tile(places, 2), np.tile(rank, 2), np.tile(cost, 2))
        best = min(cost[i] + cost[j] for j in range(len(places)) for i in range(j) if places[j] - places[i] >= 2)
        for k in (0, 1):
            i, j = left[k] - k * len(places), right[k] - k * len(places)
            assert places[j] - places[i] >= 2 and cost[i] + cost[j] == best


def test_crc_of_spans():
    data = np.frombuffer(b"hello wide world", np.uint8)
    starts, lengths = np.array([0, 6, 11, 3]), np.array([5, 4, 5, 0])
    states = np.array([zlib.crc32(b"x:")] * 4, np.uint32)
    want = [zlib.crc32(b"x:" + bytes(data[s : s + n])) for s, n in zip(starts, lengths, strict=True)]
    assert crc32_spans(states, data, starts, lengths).tolist() == want


def brute_trie(rows, every=20, most=4):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            item = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append((turn is not None, turn or 0, role, item, text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(math.fmod(c, every))
        built[c] = tuple(own.get(base, [])[:h] + s[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^ \t-\r]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(frame):
    got = conversation_trie(frame, "conv_id", "turn", "role", "text")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("bits, chunk", [(0, 0), (1, 2), (2, 12), (8, 12)])
def test_trie_matches_brute_force(spark, monkeypatch, bits, chunk):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", chunk)
    rng = np.random.default_rng(bits)
    rows = []
    for conv in [*range(-25, 70), 400, 5000]:
        for turn in range(int(rng.integers(1, 12)) if conv % 7 else 1):
            rows.append((conv, int(turn), "user" if turn % 2 == 0 else "assistant", f"turn {rng.integers(0, 2)} {'word ' * (turn % 3)}" if conv % 3 else f"t {turn}"))
    rows += [(61, None, None, None), (61, None, "user", "last one"), (61, 3, "user", "twice"), (61, 3, "user", "twice"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, 2, "i", "n", 3) for r in rows], TURNS).repartition(7)
    assert trie(frame) == brute_trie(rows)


def test_trie_of_few_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie(empty) == []
    rows = [(c, 0, None, "") for c in (1, 2, 3)]
    frame = spark.createDataFrame([(*r, 1, 2, "i", "n", 3) for r in rows], TURNS)
    assert trie(frame) == brute_trie(rows)


def test_names_do_not_depend_on_the_block():
    items = [bytes([i]) * 16 for i in range(13)]
    names = prefix_trie.block_names(prefix_trie.ROOT, items)
    assert len(set(names)) == 14
    for cut in (1, 4, 8):
        assert prefix_trie.block_names(prefix_trie.ROOT, items[:cut]) == names[: cut + 1]
    assert prefix_trie.block_names(names[8], items[8:12])[:4] == names[8:12]


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) ** 2
    return math.sqrt(total)


def brute_nearest(rows, every=100, k=10):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in good:
        if q % every == 0:
            best = {}
            for i, b in good:
                if i != q and len(b) == len(a):
                    best[i] = min(best.get(i, math.inf), distance(a, b))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted((s, i) for i, s in best.items())[:k])]
    return sorted(out)


def nearest(frame, **options):
    got = nearest_vectors(frame, "vec_id", "embedding", **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("piece", [7, 4096])
def test_one_list_is_exact(spark, monkeypatch, piece):
    monkeypatch.setattr(posting_lists, "PIECE", piece)
    rng = np.random.default_rng(3)
    rows = [(i * 5, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [rows[7], rows[20], (1000, [9.0, 9.0, 9.0, 9.0])]
    rows += [(2000, None), (2001, [0.0] * 4), (2002, [1.0, None]), (2003, [math.nan] * 4), (2004, [math.inf, 1.0]), (2005, []), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(2100, [1.0, 2.0]), (2101, [1.0, 3.0])]
    assert nearest(vectors(spark, rows)) == brute_nearest(rows)


def test_extreme_and_empty(spark):
    rows = [(0, [1e-200, 0.0]), (1, [2e-200, 0.0]), (100, [1e200, 1e200]), (101, [1e200, 2e200]), (200, [5.0])]
    got = nearest(vectors(spark, rows))
    assert [r[2] for r in got if r[0] == 100] == [101, 0, 1]
    assert all(math.isfinite(r[3]) for r in got) and not [r for r in got if r[0] == 200]
    assert nearest(vectors(spark, rows).where("false")) == []
    assert nearest(vectors(spark, [(0, [1.0])])) == []


def test_lists_are_balanced_and_recall_holds(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 16)) * 3
    x = np.concatenate([centres[rng.integers(0, 20, 2500)] + rng.normal(size=(2500, 16)), np.tile(centres[0], (500, 1)) + rng.normal(size=(500, 16)) * 1e-3])
    leaves = posting_lists.balanced_leaves(x, 64, np.random.default_rng(0))
    sizes = [len(leaf) for leaf in leaves]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(3000)) and max(sizes) <= 64 and min(sizes) >= 31
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest(vectors(spark, rows), every=20, per_list=64)
    want = brute_nearest(rows, every=20)
    found = {(r[0], r[2]): r[3] for r in got}
    hit = [found.get((q, i)) for q, _, i, _ in want]
    assert sum(h is not None for h in hit) >= 0.95 * len(want)
    exact = {(q, i): s for q, _, i, s in want}
    assert all(exact[p] == s for p, s in found.items() if p in exact)
    assert Counter(r[0] for r in got) == Counter(r[0] for r in want)


def test_graph_finds_what_lies_within_the_ratio():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 8))
    index = posting_lists.fit_index(x, 32, 1.1, 3, 10, 0.95)
    r, c, apart = posting_lists.search_graph(index, x[:100], 1.2)
    gap = np.linalg.norm(x[:100, None] - index.centroids, axis=2)
    want = {tuple(p) for p in np.argwhere(gap <= 1.2 * gap.min(axis=1, keepdims=True)).tolist()}
    got = set(zip(r.tolist(), c.tolist(), strict=True))
    assert len(got & want) >= 0.97 * len(want) and np.allclose(apart, gap[r, c])
    assert np.bincount(posting_lists.lists_of(index, x)[0]).max() <= 3 and np.bincount(posting_lists.lists_of(index, x)[0]).min() == 1
