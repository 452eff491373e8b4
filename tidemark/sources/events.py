"""Event scans: batch, file stream, Kafka stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from tidemark.sources.tables import table

# Event vocabulary.
CART, ORDER, SESSION = "cart_abandoned", "order_completed", "session_ended"

# The given events table speaks of clicks, purchases and views.
TYPE_MAP = {"click": CART, "purchase": ORDER, "view": SESSION}

RAW_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, "
    "event_type string, value double, props string"
)
RECORD_SCHEMA = (
    "event_type string, customer_id string, "
    "properties map<string,double>, timestamp double"
)


def map_type(col: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in TYPE_MAP.items() for x in pair])
    return F.try_element_at(mapping, col)


def to_events(raw: DataFrame) -> DataFrame:
    """Raw rows as events; other types are not part of the vocabulary and are dropped."""
    return raw.where(F.col("event_type").isin(*TYPE_MAP)).select(
        F.col("event_id"),
        F.col("ts"),
        F.col("user_id").alias("customer_id"),
        map_type(F.col("event_type")).alias("event_type"),
        F.col("value").alias("amount"),
    )


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_events(table(spark, sf_dir, "events"))


def stream_events(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", bytes_per_trigger: int = 256 << 20
) -> DataFrame:
    """File stream over ``folder``; each trigger reads a bounded amount, so the events one
    customer brings to a trigger are bounded too."""
    raw = (
        spark.readStream.schema(RAW_SCHEMA)
        .option("maxBytesPerTrigger", bytes_per_trigger)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )
    return to_events(raw)


def kafka_events(
    spark: SparkSession, brokers: str, topic: str, offsets_per_trigger: int = 1_000_000
) -> DataFrame:
    """Kafka stream of JSON records; needs the Kafka package on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
    )
    return parse_records(raw.select(F.col("value").cast("string").alias("record")))


def parse_records(records: DataFrame, now: Column | None = None) -> DataFrame:
    """JSON text column ``record`` to event columns, with defaults for absent fields."""
    now = F.current_timestamp() if now is None else now
    parsed = F.from_json("record", RECORD_SCHEMA)
    empty = F.from_json(F.lit("{}"), MapType(StringType(), DoubleType()))
    return records.select("*", parsed.alias("e")).select(
        *[c for c in records.columns if c != "record"],
        F.col("e.event_type").alias("event_type"),
        F.col("e.customer_id").alias("customer_id"),
        F.coalesce(F.col("e.properties"), empty).alias("properties"),
        F.coalesce(
            F.col("e.timestamp"), F.unix_micros(now.cast("timestamp")) / F.lit(1e6)
        ).alias("timestamp"),
    )


def to_records(events: DataFrame) -> DataFrame:
    """Event columns as one JSON text column."""
    return events.select(
        F.to_json(F.struct("event_type", "customer_id", "properties", "timestamp")).alias("record")
    )
