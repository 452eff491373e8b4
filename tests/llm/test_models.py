from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edges import ROWS, documents
from tidemark.llm import pitman_yor
from tidemark.llm.pitman_yor import log_stirling, sample_tables, score_corpus
from tidemark.llm.toxicity import fit_nonnegative, reject_toxic, score_texts, sigmoid, train
from tidemark.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op2_toxicity

    rows = op2_toxicity(spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    toxic, clean = ([r["score"] for r in held if r["toxic"] == y] for y in (1, 0))
    assert sum(s >= 0.5 for s in toxic) >= 0.6 * len(toxic) and sum(s >= 0.5 for s in clean) <= 0.05 * len(clean)
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean) > 0.75


def test_fit_corrects_for_hidden_positives():
    rng = np.random.default_rng(0)
    hidden = rng.random(3000) < 0.3
    has = np.where(hidden, rng.random(3000) < 0.9, rng.random(3000) < 0.05)
    positive = hidden & (rng.random(3000) < 0.3)
    row = np.flatnonzero(has)
    weights, bias = fit_nonnegative(row, np.zeros(len(row), np.int64), np.ones(len(row)), positive, 1, 0.3)
    assert sigmoid(weights[0] + bias) > 0.5 > sigmoid(bias)


def test_toxicity_edges(spark):
    frame = documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (3, 1), (77, 1)], "doc_id bigint, toxic int")
    for marks in (labels, labels.where("false"), labels.where("toxic = 0")):
        model = train(frame, "doc_id", "text", marks, "toxic")
        scores = [r["score"] for r in score_texts(frame, ["doc_id"], "text", model).collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
        assert reject_toxic(frame, "text", model).schema == frame.schema
    assert score_texts(frame.where("false"), ["doc_id"], "text", model).count() == 0
    assert train(frame.where("false"), "doc_id", "text", labels, "toxic").buckets.size == 0


# --- language model


def test_stirling_numbers_count_seatings():
    table_ = np.exp(log_stirling(0.0, 6))
    assert np.allclose(table_[5, 1:6], [24, 50, 35, 10, 1])
    d = 0.4
    assert np.allclose(np.exp(log_stirling(d, 4))[3, 1:4], [(1 - d) * (2 - d), 3 * (1 - d), 1])


def test_tables_follow_their_conditional():
    rng = np.random.default_rng(5)
    discount, strength, base, c, others = 0.5, 1.0, 0.2, 4, 3
    weights = np.array([math.exp(log_stirling(discount)[c, t]) * math.prod((strength + discount * (others + i)) * base for i in range(1, t)) for t in range(1, c + 1)])
    n = 60_000
    drawn = sample_tables(np.full(n, c), np.full(n, others), np.full(n, base), discount, strength, log_stirling(discount), rng)
    assert np.allclose(np.bincount(drawn, minlength=c + 1)[1:] / n, weights / weights.sum(), atol=0.01)
    many = sample_tables(np.array([5000, 1, 0]), np.array([10, 0, 0]), np.full(3, 0.1), discount, strength, log_stirling(discount), rng)
    assert 1 < many[0] < 5000 and many[1:].tolist() == [1, 0]


def plain(rows, train_of):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None] for _, t in rows]
    counts = Counter(w for (k, _), ts in zip(rows, tokens, strict=True) if train_of(k) for w in ts)
    total, kinds = sum(counts.values()), len(counts)
    return [(str(k), len(ts), sum(counts[w] > 0 for w in ts), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ts), 6)) for (k, _), ts in zip(rows, tokens, strict=True)]


@pytest.mark.parametrize("small", [False, True])
def test_base_scores_are_exact(spark, monkeypatch, small):
    if small:  # many chunks, buckets and spread contexts
        monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 50)
        monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 40)
        monkeypatch.setattr(pitman_yor, "HEAVY_SHARE", 0.05)
    rng = np.random.default_rng(2)
    rows = [(k % 70, " ".join(rng.choice(["the", "The", "of", "a", "b", "c", f"w{k}"], rng.integers(0, 30)))) for k in range(90)]
    rows += [(None, "the null id"), (200, None), (201, "\t\n")]
    frame = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id bigint, text string, bucket int, body string").repartition(3)
    got = score_corpus(frame, "doc_id", "text", F.col("doc_id") % 5 != 1).collect()
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert found == sorted(plain(rows, lambda k: k is not None and k % 5 != 1))
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_predictive_sums_to_one():
    rng = np.random.default_rng(0)
    customers = rng.integers(1, 40, 50)
    tables = sample_tables(customers, np.full(50, 60), np.full(50, 1 / 51), 0.6, 10.0, log_stirling(0.6), rng)
    known = pitman_yor.word_probability(customers, tables, customers.sum(), tables.sum(), 50.0)
    unknown = pitman_yor.word_probability(0, 0, customers.sum(), tables.sum(), 50.0)
    assert known.sum() + unknown == pytest.approx(1)


def test_no_training_rows(spark):
    got = score_corpus(documents(spark), "doc_id", "text", F.lit(False)).collect()
    assert len(got) == len(ROWS) and all(abs(r["score"]) + abs(r["base_score"]) < 1e-9 for r in got)
    assert score_corpus(documents(spark).where("false"), "doc_id", "text", F.lit(True)).count() == 0
