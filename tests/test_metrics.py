from __future__ import annotations

import random

import pytest

from tidemark.operators import ensemble, metrics
from tidemark.operators.splits import chronological_split, fold_assignment, stratified_split, walk_forward_folds


def pairs(spark, rows):
    return spark.createDataFrame(
        [(i, y, s) for i, (y, s) in enumerate(rows)], "customer_id bigint, y int, score double"
    )


def test_perfect_scores(spark):
    df = pairs(spark, [(0, 0.1), (1, 0.9), (0, 0.2), (1, 0.8), (1, 0.95)])
    row = metrics.binary_metrics(df).first()
    for name in ("roc_auc", "pr_auc", "precision", "recall", "f1"):
        assert row[name] == pytest.approx(1.0)


def brute_auc(rows):
    won = [0.5 * (p == n) + (p > n) for y, p in rows if y for z, n in rows if not z]
    return sum(won) / len(won)


def brute_ap(rows):
    total, ap, before = sum(y for y, _ in rows), 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hit = [y for y, s in rows if s >= t]
        ap += (sum(hit) / total - before) * sum(hit) / len(hit)
        before = sum(hit) / total
    return ap


@pytest.mark.parametrize("slice_rows", [7, 1_000_000])
def test_ranking_with_ties(spark, slice_rows):
    rng = random.Random(1)
    rows = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(300)]
    row = metrics.ranking_metrics(pairs(spark, rows), slice_rows=slice_rows).first()
    assert row["roc_auc"] == pytest.approx(brute_auc(rows))
    assert row["pr_auc"] == pytest.approx(brute_ap(rows))


@pytest.mark.parametrize("slice_rows", [5, 1_000_000])
def test_ranking_by_group(spark, slice_rows):
    rng = random.Random(2)
    rows = [(g, rng.randrange(2), round(rng.random(), 1)) for g in "ab" for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, y int, score double")
    got = {r["g"]: r["roc_auc"] for r in metrics.ranking_metrics(df, by=("g",), slice_rows=slice_rows).collect()}
    for g in "ab":
        assert got[g] == pytest.approx(brute_auc([(y, s) for k, y, s in rows if k == g]))


def test_profit_and_thresholds(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.5), (0, 0.4), (0, 0.3), (1, 0.2), (0, 0.1), (0, 0.05)]
    df = pairs(spark, rows)
    best = metrics.optimal_threshold(df, 100.0, 10.0).first()
    profits = {}
    for t in (s for _, s in rows):
        tp = sum(y for y, s in rows if s >= t)
        fp = sum(1 - y for y, s in rows if s >= t)
        profits[t] = 100 * tp - 10 * fp - 100 * (4 - tp)
    top = max(profits.values())
    assert best["profit"] == top
    assert best["threshold"] == min(t for t, p in profits.items() if p == top)
    assert metrics.f1_threshold(df).first()["threshold"] == 0.6
    assert metrics.youden_threshold(df).first()["threshold"] == 0.6


def test_no_positive(spark):
    df = pairs(spark, [(0, 0.4), (0, 0.6)])
    assert metrics.f1_threshold(df).first()["threshold"] == 1.0
    assert metrics.top_decile(df).first()["lift_top_decile"] == float("inf")
    assert metrics.threshold_metrics(df).first()["precision"] == 0.0


@pytest.mark.parametrize("limit", [5, 50_000])
def test_lift(spark, limit):
    df = pairs(spark, [(1, 0.9)] * 10 + [(0, 0.1)] * 90)
    row = metrics.top_decile(df, limit=limit).first()
    assert (row["k"], row["lift_top_decile"], row["recall_top_decile"]) == (10, 10.0, 1.0)
    tied = pairs(spark, [(int(i < 5), 0.5) for i in range(100)])
    assert metrics.top_decile(tied, limit=limit).first()["lift_top_decile"] == pytest.approx(10.0)


def test_cv_summary(spark):
    df = spark.createDataFrame([(0, 0.5, 0.6), (1, 0.7, 0.8)], "fold int, pr_auc double, roc_auc double")
    long = metrics.long_metrics(df, ["fold"], ["pr_auc", "roc_auc"])
    got = {r["metric"]: (r["mean"], r["std"]) for r in metrics.summarize_cv(long).collect()}
    assert got["pr_auc"] == (pytest.approx(0.6), pytest.approx(0.1))
    assert got["roc_auc"] == (pytest.approx(0.7), pytest.approx(0.1))


def test_vote_weights():
    assert ensemble.normalized_weights(2) == [0.5, 0.5]
    for bad in ((0, None), (2, [1.0]), (2, [0.0, 0.0])):
        with pytest.raises(ValueError):
            ensemble.normalized_weights(*bad)


def test_splits(spark):
    df = spark.range(600).selectExpr("id AS customer_id", "cast(id % 3 = 0 AS int) AS y", "timestamp_seconds(id DIV 50) AS ts")
    part = stratified_split(df, "y", "customer_id")
    share = part.groupBy("y").agg({"*": "count"}).count()
    assert share == 2 and 60 < part.where("part = 'test'").count() < 180
    assert fold_assignment(df, "y", "customer_id").select("fold").distinct().count() == 5
    for limit in (5, 50_000):
        chrono = chronological_split(df, "ts", "customer_id", limit=limit)
        sizes = {r["part"]: (r["n"], r["lo"]) for r in chrono.groupBy("part").agg({"*": "count", "customer_id": "min"}).toDF("part", "n", "lo").collect()}
        assert sizes == {"train": (420, 0), "valid": (90, 420), "test": (90, 510)}
        folds = walk_forward_folds(df, "ts", "customer_id", limit=limit)
        counts = {r["test_fold"]: r["count"] for r in folds.groupBy("test_fold").count().collect()}
        assert counts == {-1: 100, 0: 100, 1: 100, 2: 100, 3: 100, 4: 100}
