from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import online_state as state
from tidemark.session import scratch_path
from tidemark.sources import events as ev
from tidemark.streaming import flow

SF_DIR = "/root/testdata/sf0.001"


def events(spark, rows):
    return spark.createDataFrame(
        rows, "event_id bigint, s int, customer_id bigint, event_type string, amount double"
    ).withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))


def test_state_after_events(spark):
    df = events(
        spark,
        [
            (1, 1, 1, "cart_abandoned", 250.0),
            (2, 2, 1, "cart_abandoned", 50.0),
            (3, 1, 3, "order_completed", 120.5),
            (4, 1, 2, "session_ended", None),
        ],
    )
    rows = {r["event_id"]: r for r in state.event_state(df).collect()}
    assert rows[2]["cart_abandoned_count"] == 2 and rows[2]["last_cart_value"] == 50.0
    assert rows[3]["monetary"] == 120.5 and rows[3]["order_count"] == 1
    assert rows[4]["session_count"] == 1
    results = {r["event_id"]: r for r in state.reengagement(state.event_state(df)).collect()}
    assert results[1]["triggered"] and results[1]["risk"] == pytest.approx(0.6)
    assert results[1]["message"].startswith("Hello, you still have 250 TRY")
    assert not results[4]["triggered"] and results[4]["risk"] is None
    assert len(results[1]["channels"]) == 3


def test_injected_scorer(spark):
    df = events(spark, [(1, 1, 1, "cart_abandoned", 5.0)])
    got = state.reengagement(state.event_state(df), scorer=lambda d: F.lit(0.77)).first()
    assert got["risk"] == 0.77


def test_latest_state_equals_running_state(spark):
    df = events(spark, [(i, i % 17, i % 5, ["cart_abandoned", "order_completed", "session_ended"][i % 3], float(i)) for i in range(90)])
    after = state.event_state(df).withColumn("at", F.struct("ts", "event_id"))
    last = after.groupBy("customer_id").agg(F.max_by(F.struct(*state.STATE_COLUMNS), "at").alias("s")).select("customer_id", "s.*")
    now = state.online_features(df).select("customer_id", *state.STATE_COLUMNS)
    assert now.exceptAll(last).count() == last.exceptAll(now).count() == 0


def test_parse_defaults_and_round_trip(spark):
    df = spark.createDataFrame([('{"event_type":"a","customer_id":"C1"}',)], "record string")
    row = ev.parse_records(df, F.timestamp_seconds(F.lit(5))).first()
    assert row["properties"] == {} and row["timestamp"] == 5.0
    text = '{"event_type":"a","customer_id":"C1","properties":{"amount":2.5},"timestamp":7.0}'
    again = ev.to_records(ev.parse_records(spark.createDataFrame([(text,)], "record string"))).first()[0]
    assert again == text


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_stream_in_several_triggers_equals_batch(spark):
    raw = spark.read.parquet(f"{SF_DIR}/events.parquet")
    folder = scratch_path(spark, "source")
    # Three files in time order and a trigger budget of one byte: one file per trigger.
    for i in range(3):
        part = raw.where(F.floor(F.col("event_id") * 3 / F.lit(raw.count())) == i)
        part.coalesce(1).write.parquet(f"{folder}/part{i}")
    stream = ev.stream_events(spark, f"{folder}/part*", bytes_per_trigger=1)
    out = flow.run_flow(spark, stream, scratch_path(spark, "flow"))
    got = spark.read.parquet(f"{out}/results")
    assert got.select("batch").distinct().count() == 3
    batch = state.reengagement(state.event_state(ev.to_events(raw)))
    got = got.select(*batch.columns)
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0
    fired = batch.where("triggered").count()
    assert spark.read.parquet(f"{out}/outbox").count() == 3 * fired
    assert spark.read.parquet(f"{out}/tracks").where("event = 'reengagement_sent'").count() == fired


def test_watermark_option(spark):
    df = events(spark, [(1, 1, 1, "a", 1.0), (2, 4000, 1, "a", 1.0)])
    assert state.tumbling_counts(df, late="10 minutes").count() == 2


def test_merge_and_read(spark):
    stored = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "customer_id int, n int, t string")
    updates = spark.createDataFrame([(2, 7, 1.5), (3, None, 2.5)], "customer_id int, n int, x double")
    merged = state.merge_features(stored, updates)
    assert {tuple(r) for r in merged.collect()} == {(1, 5, "a", None), (2, 7, "b", 1.5), (3, None, None, 2.5)}
    wanted = spark.createDataFrame([(2,), (9,)], "customer_id int")
    assert {tuple(r) for r in state.read_features(stored, wanted).collect()} == {(2, 6, "b"), (9, None, None)}
