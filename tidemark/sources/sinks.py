"""Writers for datasets and reports, and the fitted-model store."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Reports are small aggregates, written as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_run(
    spark: SparkSession, path: str, run: str, params: dict[str, str], metrics: dict[str, float]
) -> None:
    """Append one training run with its parameters and metrics to the run table."""
    row = spark.createDataFrame(
        [(run, {k: str(v) for k, v in params.items()}, metrics)],
        "run string, params map<string,string>, metrics map<string,double>",
    ).withColumn("logged_at", F.current_timestamp())
    row.write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline; a missing path is an error."""
    try:
        return PipelineModel.load(path)
    except Exception as exc:
        raise FileNotFoundError(f"No fitted model at {path}") from exc
