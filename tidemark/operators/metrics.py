"""Evaluation of scores against 0/1 labels.

Everything starts from one row per distinct score, so tied scores count as one point
and what is ordered is smaller than the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binning import key_after
from tidemark.operators.running import SLICE_ROWS, running_totals
from tidemark.operators.selection import VALUE_LIMIT, key_cuts

EXACT = "decimal(38,0)"


def score_points(
    df: DataFrame,
    label: str = "y",
    score: str = "score",
    by: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Per distinct score: positives and negatives there (pos, neg) and at or above (tp, fp)."""
    groups = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("neg"),
    )
    return running_totals(
        groups,
        "threshold",
        {"tp": F.col("pos"), "fp": F.col("neg")},
        descending=True,
        by=by,
        slice_rows=slice_rows,
    )


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def ranking_metrics(
    df: DataFrame,
    label: str = "y",
    score: str = "score",
    by: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """ROC-AUC (ties half), average precision (step sum), rows and positive rate.

    The AUC pairs are counted in exact integers, so the order of the sum cannot matter.
    """
    points = score_points(df, label, score, by, slice_rows)
    above = F.col("tp") - F.col("pos")
    pairs = F.sum(F.col("neg").cast("decimal(18,0)") * (2 * above + F.col("pos")).cast("decimal(19,0)"))
    pos, neg = F.sum("pos"), F.sum("neg")
    gain = F.sum(F.col("pos") * _precision())
    return points.groupBy(*by).agg(
        F.try_divide(pairs.cast("double"), 2.0 * pos.cast("double") * neg.cast("double")).alias(
            "roc_auc"
        ),
        F.try_divide(gain, pos.cast("double")).alias("pr_auc"),
        (pos + neg).alias("n"),
        F.try_divide(pos, pos + neg).alias("pos_rate"),
    )


def threshold_metrics(
    df: DataFrame,
    label: str = "y",
    score: str = "score",
    threshold: float = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall and F1 of ``score >= threshold``; 0 where undefined."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by,
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def binary_metrics(
    df: DataFrame,
    label: str = "y",
    score: str = "score",
    threshold: float = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Ranking and threshold metrics, one row per group."""
    ranked = ranking_metrics(df, label, score, by)
    cut = threshold_metrics(df, label, score, threshold, by)
    if by:
        return ranked.join(cut, list(by))
    row = F.struct("precision", "recall", "f1")
    return ranked.withColumn("cut", cut.select(row).scalar()).select("*", "cut.*").drop("cut")


def _counted_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Score points with the class totals of the whole frame."""
    y = F.col(label).cast("bigint")
    totals = df.agg(F.struct(F.sum(y).alias("p"), F.sum(1 - y).alias("n")))
    return score_points(df, label, score).withColumn("total", totals.scalar()).select(
        "threshold",
        "tp",
        "fp",
        F.col("total.p").alias("positives"),
        F.col("total.n").alias("negatives"),
    )


def pr_curve(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Precision and recall at every distinct threshold."""
    points = _counted_points(df, label, score)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("positives")), F.lit(1.0))
    return points.select(
        "threshold", _precision().alias("precision"), recall.alias("recall"), "tp", "fp"
    )


def profit_curve(
    df: DataFrame, ltv: float, incentive_cost: float, label: str = "y", score: str = "score"
) -> DataFrame:
    """Expected profit of targeting every score at or above each threshold."""
    points = _counted_points(df, label, score)
    missed = F.col("positives") - F.col("tp")
    profit = F.col("tp") * ltv - F.col("fp") * incentive_cost - missed * ltv
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("positives")), F.lit(1.0))
    return points.select(
        "threshold",
        profit.alias("profit"),
        _precision().alias("precision"),
        recall.alias("recall"),
    )


def optimal_threshold(
    df: DataFrame, ltv: float, incentive_cost: float, label: str = "y", score: str = "score"
) -> DataFrame:
    """Threshold of the largest profit, the lowest one on ties."""
    curve = profit_curve(df, ltv, incentive_cost, label, score)
    rank = F.struct("profit", -F.col("threshold"))
    return curve.agg(F.max_by("threshold", rank).alias("threshold"), F.max("profit").alias("profit"))


def f1_threshold(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Threshold of the largest F1, the lowest one on ties; 1.0 without any positive."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * (p * r) / (p + r + 1e-12))
    curve = pr_curve(df, label, score).withColumn("f1", f1)
    best = curve.agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"),
        F.max("f1").alias("f1"),
    )
    return best.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(1.0).alias("threshold"), "f1")


def youden_threshold(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Threshold of the largest TPR - FPR, the highest one on ties; infinite if none is above 0."""
    points = _counted_points(df, label, score)
    tp, fp = F.col("tp").cast("decimal(18,0)"), F.col("fp").cast("decimal(18,0)")
    pos, neg = F.col("positives").cast("decimal(19,0)"), F.col("negatives").cast("decimal(19,0)")
    ranked = points.withColumn("gap", (tp * neg - fp * pos).cast(EXACT))
    best = ranked.agg(
        F.max_by("threshold", F.struct("gap", "threshold")).alias("threshold"),
        F.max("gap").alias("gap"),
        F.max(F.col("positives").cast("double") * F.col("negatives")).alias("pairs"),
    )
    return best.select(
        F.when(F.col("gap") > 0, F.col("threshold")).otherwise(float("inf")).alias("threshold"),
        (F.greatest("gap", F.lit(0)).cast("double") / F.col("pairs")).alias("youden"),
    )


def top_decile(
    df: DataFrame,
    label: str = "y",
    score: str = "score",
    key: str = "customer_id",
    limit: int = VALUE_LIMIT,
) -> DataFrame:
    """Lift and recall of the best tenth of the rows; equal scores are taken in key order."""
    def last(n: int) -> list[int]:
        return [max(1, int(n * 0.1)) - 1] if n else []

    cuts = key_cuts(df, {"s": -F.col(score)}, F.col(key), last, limit)["s"]
    y = F.col(label).cast("bigint")
    inside = F.lit(False)
    for cut in cuts.values():
        inside = ~key_after([-F.col(score), F.col(key)], cut)
    top = F.when(inside, y)
    return df.agg(
        F.count(top).alias("k"),
        F.when(F.sum(y) == 0, float("inf")).otherwise(F.avg(top) / F.avg(y)).alias("lift_top_decile"),
        F.try_divide(F.sum(top), F.sum(y)).alias("recall_top_decile"),
    )


def brier_score(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier_score"))


def naive_baseline(df: DataFrame, label: str = "y") -> DataFrame:
    """Metrics of flagging every row."""
    rate = F.avg(F.col(label))
    return df.agg(
        rate.alias("precision"),
        F.lit(1.0).alias("recall"),
        (2 * rate / (rate + 1)).alias("f1"),
    )


def long_metrics(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Metric columns as (keys..., metric, value) rows."""
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
            for n in names
        ]
    )
    return df.select(*keys, F.inline(cells))


def summarize_cv(metrics: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean and population deviation over the folds of (fold, metric, value) rows."""
    return (
        metrics.where(F.col("value").isNotNull())
        .groupBy(*by)
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )
