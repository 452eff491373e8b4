"""Parquet scans and table materialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Schemas already read in this process, by path; each look-up would be a job of its own.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan whose files are too few to.

    Large tables have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def publish_view(df: DataFrame, name: str) -> None:
    """Staging models are views."""
    df.createOrReplaceTempView(name)


def publish_table(
    df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 200
) -> None:
    """Mart models are tables; bucketing by the join key keeps later joins shuffle-free."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
