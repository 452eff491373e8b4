"""Weighted probability averaging and sigmoid calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_weights(models: int, weights: Sequence[float] | None = None) -> list[float]:
    """Weights that sum to 1; equal ones when none are given."""
    if not models:
        raise ValueError("at least one model is required")
    if weights is None:
        return [1.0 / models] * models
    if len(weights) != models:
        raise ValueError("weight count must match model count")
    total = sum(weights)
    if total <= 0:
        raise ValueError("weight sum must be greater than zero")
    return [w / total for w in weights]


def soft_vote(scores: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of probability columns."""
    parts = [F.col(c) * F.lit(w) for c, w in zip(scores, normalized_weights(len(scores), weights), strict=True)]
    blended = parts[0]
    for part in parts[1:]:
        blended = blended + part
    return blended


def platt(score: Column, slope: float, intercept: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * score + F.lit(intercept))))


def ensemble_weights(fold_metrics: DataFrame) -> DataFrame:
    """Weight per model from its mean fold AUC above chance; a floor keeps all above zero."""
    edge = fold_metrics.groupBy("model").agg(
        (F.greatest(F.avg("roc_auc") - 0.5, F.lit(0.0)) + 1e-6).alias("edge")
    )
    total = edge.agg(F.sum("edge")).scalar()
    return edge.select("model", (F.col("edge") / total).alias("weight"))
