from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import content, retrieval


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_words(spark):
    got = column(spark, ["Spor-Ürün 5_x, spor", "", "..."], tx.word_set)
    assert [set(w) for w in got] == [{"spor", "ürün", "5_x"}, set(), set()]


def test_masking(spark):
    texts = ["mail me: Ann.B@Mail.example.ORG now", "card 1234567890123456", "call 555-123-4567", "id 5551234567", "x12345678901y", "plain"]
    assert column(spark, texts, tx.mask_pii) == [
        "mail me: [EMAIL] now", "card [CARD]", "call [PHONE]", "id [CARD]", "x12345678901y", "plain",
    ]


def test_guardrails(spark):
    texts = ["60% off", "%60 off", "10% off", "write a@b.io", "555-123-4567", "Unlimited FREE trial", "99999999999999999999%"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    rows = content.guardrails(df, "content").orderBy("i").collect()
    assert [r["guardrail_reasons"] for r in rows] == [
        ["discount_within_limit"], ["discount_within_limit"], [], ["no_pii_leak"], ["no_pii_leak"],
        ["no_forbidden_terms"], ["no_pii_leak", "discount_within_limit"][1:],
    ]
    assert [r["guardrail_passed"] for r in rows] == [not r["guardrail_reasons"] for r in rows]
    passed = content.guardrails(df.select("i").withColumn("content", F.lit(content.EMAIL_TEMPLATE)), "content")
    assert passed.where("NOT guardrail_passed").count() == 0


def test_grounding(spark):
    assert column(spark, ["A special OFFER", "hello"], content.grounded) == [True, False]
    assert column(spark, ["hello"], lambda c: content.grounded(c, ["hell"])) == [True]


DOCS = [
    (0, "End-of-season discount campaign up to 15% on sports and outdoor products."),
    (1, "Loyalty discount in the home decoration and kitchen products category."),
    (2, "New season products for electronic accessories and gadgets."),
    (3, ""),
]


def brute(queries, docs, k):
    def words(t):
        return set(re.findall(r"\w+", t.lower()))

    out = {}
    for q, text in queries:
        a = words(text)
        scored = [(-(len(a & words(t)) / len(a | words(t)) if words(t) else 0.0), d) for d, t in docs]
        out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


def found(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def test_retrieval_fills_k(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    queries = [(1, "sports outdoor campaign"), (2, ""), (3, "zzz")]
    got = found(retrieval.retrieve(spark.createDataFrame(queries, "query_id bigint, text string"), docs, 3))
    assert got == {q: [(d, pytest.approx(s)) for d, s in hits] for q, hits in brute(queries, DOCS, 3).items()}
    assert got[1][0][0] == 0 and len(got[2]) == 3


@pytest.mark.parametrize("max_queries", [4_000, 20, 3])
def test_retrieval_paths_agree(spark, max_queries):
    """Direct, by signature, and in blocks."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(["the", *rng.choices(vocabulary, k=rng.randrange(0, 12))])) for i in range(150)]
    queries = [(i, " ".join([f"id{i}", "the", *rng.choices(vocabulary[:6], k=3)])) for i in range(60)]
    got = found(
        retrieval.retrieve(
            spark.createDataFrame(queries, "query_id bigint, text string"),
            spark.createDataFrame(docs, "doc_id bigint, text string"),
            5,
            max_queries,
        )
    )
    expected = brute(queries, docs, 5)
    assert got == {q: [(d, pytest.approx(s)) for d, s in hits] for q, hits in expected.items()}


def test_blocks_cut_both_sides(spark):
    rng = np.random.default_rng(1)
    vectors, targets = rng.normal(size=(300, 8)), rng.normal(size=(25, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id bigint, items array<double>")
    queries = spark.createDataFrame(
        [(str(i), v.tolist(), 8) for i, v in enumerate(targets)], "query string, items array<double>, size int"
    )
    got = retrieval.top_k(queries, corpus, retrieval.vector_scorer, 4, max_queries=10, block_corpus_items=500)
    cosine = (targets / np.linalg.norm(targets, axis=1, keepdims=True)) @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    for i in range(25):
        hits = [r["doc_id"] for r in got.where(F.col("query") == str(i)).orderBy("rank").collect()]
        assert hits == np.argsort(-cosine[i], kind="stable")[:4].tolist()
        if i == 2:
            break


def test_contexts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    queries = spark.createDataFrame([(7, "sports outdoor campaign")], "query_id bigint, text string")
    row = retrieval.retrieve_contexts(queries, docs, 2).first()
    assert row["sources"][0] == 0 and row["context"].split("\n")[0] == DOCS[0][1]


def test_passages(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc\n \n\n d")], "doc_id bigint, text string")
    got = [(r["position"], r["passage"].strip()) for r in retrieval.passages(docs).collect()]
    assert got == [(0, "a\nb"), (1, "c"), (2, "d")]


def test_prompt_masks_the_profile(spark):
    df = spark.createDataFrame([("mail x@y.org", "ctx")], "p string, c string")
    prompt = df.select(content.email_prompt(F.col("p"), F.col("c"), F.lit("why"))).first()[0]
    assert prompt.startswith("Customer profile: mail [EMAIL]\nChurn risk reason: why\nRelevant context: ctx\n\n")


@pytest.mark.parametrize("seed_postings", [1, 60, 4_000])
def test_retrieval_of_long_texts_with_repeated_and_missing_ids(spark, seed_postings):
    """Thresholds above zero rule documents out; every row of a repeated id counts."""
    rng = random.Random(3)
    frequent, rare = [f"f{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    docs = [(i % 170, " ".join({*rng.sample(frequent, 9), *rng.sample(rare, rng.randrange(1, 60))})) for i in range(200)]
    queries = [(i, " ".join([*frequent, *docs[i * 7][1].split()[:14], f"only{i}"])) for i in range(20)] + [(50, "nothing known"), (51, "r1"), (52, None)]
    got = found(
        retrieval.retrieve(
            spark.createDataFrame(queries, "query_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string"), 6, seed_postings
        )
    )
    expected = brute([(q, t or "") for q, t in queries], docs, 6)
    assert got == {q: [(d, pytest.approx(s)) for d, s in hits] for q, hits in expected.items()}
