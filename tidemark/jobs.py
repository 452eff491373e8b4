"""The batch jobs end to end: read, compute, write. Each takes and leaves tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import experiments, learning, quality
from tidemark.operators import features as ft
from tidemark.params import DEFAULTS, JobParams
from tidemark.sources import sinks


def quality_job(profiles: DataFrame, out: str) -> None:
    sinks.write_report(quality.quality_report(profiles), out)


def features_job(profiles: DataFrame, out: str) -> dict[str, str]:
    """Write features, labels and training set; return their paths."""
    reference = ft.reference_date(ft.parse_dates(profiles)).first()[0]
    parts = ft.build_dataset(profiles, f"{reference:%Y-%m-%d %H:%M:%S.%f}")
    paths = {name: f"{out}/{name}" for name in parts}
    for name, df in parts.items():
        sinks.write_dataset(df, paths[name])
    return paths


def train_job(
    spark: SparkSession,
    training_path: str,
    out: str,
    kinds: Sequence[str] = ("logistic", "gbt", "random_forest"),
    params: Mapping[str, Mapping[str, Any]] | None = None,
    label: str = "churn",
    folds: int = 5,
    job: JobParams = DEFAULTS,
) -> learning.TrainingResult:
    """Train the ensemble; write its models, fold metrics, comparison, importances and a run row."""
    df = spark.read.parquet(training_path)
    result = learning.train_ensemble(df, kinds, params, folds, label, job.ltv, job.incentive_cost)
    for kind, model in result.ensemble.models.items():
        sinks.save_model(model, f"{out}/models/{kind}")
        sinks.write_csv(
            learning.model_importance(model, df).orderBy(F.desc("mean_abs_contribution")),
            f"{out}/importances/{kind}",
        )
    shape = [
        (k, float(w), float(result.ensemble.slope), float(result.ensemble.intercept))
        for k, w in result.ensemble.weights.items()
    ]
    sinks.write_dataset(
        spark.createDataFrame(shape, "model string, weight double, slope double, intercept double"),
        f"{out}/ensemble",
    )
    sinks.write_report(result.folds, f"{out}/folds")
    sinks.write_report(result.comparison, f"{out}/comparison")
    best = result.comparison.where("model = 'ensemble'").first()
    metrics = {k: float(best[k]) for k in ("roc_auc", "pr_auc", "precision", "recall", "f1")}
    thresholds = {f"threshold_{k}": float(v) for k, v in result.thresholds.items()}
    sinks.append_run(spark, f"{out}/runs", label, {"folds": str(folds)}, metrics | thresholds)
    return result


def load_ensemble(spark: SparkSession, out: str) -> learning.CalibratedEnsemble:
    """The ensemble written by ``train_job``."""
    rows = spark.read.parquet(f"{out}/ensemble").orderBy("model").collect()
    models = {r["model"]: sinks.load_model(f"{out}/models/{r['model']}") for r in rows}
    weights = {r["model"]: r["weight"] for r in rows}
    return learning.CalibratedEnsemble(models, weights, rows[0]["slope"], rows[0]["intercept"])


def score_job(spark: SparkSession, model_path: str, features_path: str, out: str) -> None:
    """Score a feature table with the stored ensemble."""
    features = spark.read.parquet(features_path)
    sinks.write_dataset(learning.score_customers(load_ensemble(spark, model_path), features), out)


def experiment_job(outcomes: DataFrame, out: str, job: JobParams = DEFAULTS) -> None:
    """Write the experiment report with its p-values."""
    report = experiments.analyze_experiment(outcomes, job.alpha)
    sinks.write_report(experiments.with_p_values(report), out)


