"""Distribution drift between two populations, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tidemark.functions.binning import bin_left
from tidemark.operators.selection import VALUE_LIMIT, inner_quantile_edges
from tidemark.params import DEFAULTS

FLOOR = 1e-6
NULL_VALUE = "nan"


def _is_numeric(df: DataFrame, column: str) -> bool:
    """Numbers, and flags as 0 and 1."""
    return isinstance(df.schema[column].dataType, (NumericType, BooleanType))


def _cells(df: DataFrame, columns: list[str], numeric: dict[str, list[float]], side: int) -> DataFrame:
    """(side, column, bucket) per value; NULL numbers are left out, NULL texts are a bucket."""
    structs = []
    for c in columns:
        if c in numeric:
            bucket: Column = bin_left(F.col(c).cast("double"), numeric[c]).cast("string")
        else:
            bucket = F.coalesce(F.col(c).cast("string"), F.lit(NULL_VALUE))
        structs.append(F.struct(F.lit(c).alias("column"), bucket.alias("bucket")))
    cells = df.select(F.lit(side).alias("side"), F.inline(F.array(*structs)))
    return cells.where(F.col("bucket").isNotNull())


def psi_scores(
    reference: DataFrame, current: DataFrame, bins: int = 10, limit: int = VALUE_LIMIT
) -> DataFrame:
    """Population stability index of every common column, in one shuffle.

    Number bins come from the reference quantiles; every other column is compared by value.
    """
    columns = [c for c in reference.columns if c in current.columns]
    numbers = [c for c in columns if _is_numeric(reference, c) and _is_numeric(current, c)]
    edges = (
        inner_quantile_edges(reference, {c: F.col(c).cast("double") for c in numbers}, bins, limit)
        if numbers
        else {}
    )
    tagged = _cells(reference, columns, edges, 0).unionByName(_cells(current, columns, edges, 1))
    counts = tagged.groupBy("column", "bucket").agg(
        F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1).alias("a")
    )
    # One row per column, so its size is the width of the input.
    totals = counts.groupBy("column").agg(F.sum("e").alias("ne"), F.sum("a").alias("na"))
    joined = counts.join(F.broadcast(totals), "column")

    def share(n: str, total: str) -> Column:
        return F.greatest(F.coalesce(F.try_divide(F.col(n), F.col(total)), F.lit(0.0)), F.lit(FLOOR))

    e, a = share("e", "ne"), share("a", "na")
    scored = joined.groupBy("column").agg(
        F.sum((a - e) * F.ln(a / e)).alias("psi"), F.max("ne").alias("ne"), F.max("na").alias("na")
    )
    thin = F.col("column").isin(*numbers) & ((F.col("ne") < bins) | (F.col("na") == 0))
    kept = scored.select("column", F.when(thin, 0.0).otherwise(F.col("psi")).alias("psi"))
    names = reference.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(kept, "column", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))


def with_drift_flag(psi: DataFrame, threshold: float = DEFAULTS.psi_threshold) -> DataFrame:
    return psi.withColumn("drifted", F.col("psi") > threshold)


def drift_report(psi: DataFrame, threshold: float = DEFAULTS.psi_threshold) -> DataFrame:
    """One row: drifted columns, largest index, flag."""
    drifted = F.array_sort(F.collect_list(F.when(F.col("psi") > threshold, F.col("column"))))
    return psi.agg(
        drifted.alias("drifted_features"), F.max("psi").alias("max_psi")
    ).withColumn("drift_detected", F.size("drifted_features") > 0)


def detect_data_drift(
    reference: DataFrame, current: DataFrame, threshold: float = DEFAULTS.psi_threshold
) -> DataFrame:
    return drift_report(psi_scores(reference, current), threshold)


def detect_prediction_drift(
    reference: DataFrame,
    current: DataFrame,
    score: str = "churn_probability",
    threshold: float = DEFAULTS.psi_threshold,
) -> DataFrame:
    as_prediction = F.col(score).alias("prediction")
    psi = psi_scores(reference.select(as_prediction), current.select(as_prediction))
    return drift_report(psi, threshold)


def concept_drift(
    metrics: DataFrame, min_drop: float = DEFAULTS.concept_drift_min_drop
) -> DataFrame:
    """Add ``drop`` and ``drift_detected`` to reference_metric and current_metric."""
    drop = F.col("reference_metric") - F.col("current_metric")
    return metrics.withColumn("drop", drop).withColumn(
        "drift_detected", F.col("drop") > min_drop
    )


def retrain_signal(*reports: DataFrame) -> DataFrame:
    """One row: true where any report detected drift."""
    flags = reports[0].select("drift_detected")
    for report in reports[1:]:
        flags = flags.unionByName(report.select("drift_detected"))
    return flags.agg(
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("should_retrain")
    )


def check_and_retrain(
    reference: DataFrame,
    current: DataFrame,
    train_fn: Callable[[DataFrame], Any],
    threshold: float = DEFAULTS.psi_threshold,
    dry_run: bool = True,
) -> dict[str, Any]:
    """Drift report; where drift is found and ``dry_run`` is off, train on ``current``."""
    row = detect_data_drift(reference, current, threshold).first()
    report = row.asDict() | {"retrained": False}
    if row["drift_detected"] and not dry_run:
        report["model"] = train_fn(current)
        report["retrained"] = True
    elif row["drift_detected"]:
        report["retrain_skipped"] = True
    return report
