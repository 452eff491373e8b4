"""Re-engagement flow: event stream to result, outbox and tracking tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.campaigns import outbox, track
from tidemark.operators.online_state import reengagement
from tidemark.params import DEFAULTS, JobParams
from tidemark.session import STATE_PROVIDER
from tidemark.streaming.state import stream_state

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
SENT_EVENT = "reengagement_sent"


def messages(results: DataFrame, params: JobParams = DEFAULTS) -> DataFrame:
    """Outbox records of the triggered events."""
    fired = results.where("triggered").select(
        "event_id", "customer_id", F.col("message").alias("content")
    )
    return outbox(fired, enabled=params.enabled_channels)


def tracking(results: DataFrame, params: JobParams = DEFAULTS) -> DataFrame:
    """Tracking records of the triggered events."""
    properties = F.struct("risk", "channels")
    return track(results.where("triggered"), SENT_EVENT, properties, params.cdp_provider)


def run_flow(
    spark: SparkSession,
    events: DataFrame,
    folder: str,
    params: JobParams = DEFAULTS,
    scorer: Callable[[DataFrame], Column] | None = None,
    ttl_ms: int | None = None,
) -> str:
    """Process what the stream holds now and stop; results, outbox and tracks go below ``folder``.

    Each micro-batch writes its own subfolder, named by its number and overwritten when
    the batch is run again, so a restart neither loses nor repeats a record.
    """
    previous = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, STATE_PROVIDER)
    try:
        results = reengagement(
            stream_state(events, ttl_ms), params.trigger_events, scorer, params.enabled_channels
        )

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
            stored = batch.sparkSession.read.parquet(f"{folder}/results/batch={number}")
            for name, part in (("outbox", messages(stored, params)), ("tracks", tracking(stored, params))):
                part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

        query = (
            results.writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if previous is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, previous)
    return folder
