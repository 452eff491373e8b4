"""Cases outside the given tables that once gave wrong results."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import row_checksum
from tidemark.operators import features, learning, online_state, quality, retrieval, selection


def test_moved_values_come_from_another_row(spark):
    df = spark.range(50).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id")))
    ring = Window.partitionBy(F.lit(1)).orderBy(F.xxhash64("id"))
    rows = df.withColumn("moved", learning.moved_on("v", ring)).collect()
    assert sorted(str(r["v"]) for r in rows) == sorted(str(r["moved"]) for r in rows)
    assert all(r["v"] is None or r["v"] != r["moved"] for r in rows)


@pytest.mark.parametrize("limit", [1, 50_000])
def test_quantiles_leave_out_nan(spark, limit):
    values = [float(i) for i in range(90)] + [float("nan")] * 10 + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = selection.exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5, 0.9], limit)["x"]
    assert got == pytest.approx([22.25, 44.5, 80.1])


@pytest.mark.parametrize("max_queries", [1, 4_000])
def test_retrieval_takes_null_and_repeated_queries(spark, max_queries):
    queries = spark.createDataFrame([(1, "red shoes"), (1, "blue hats"), (2, None)], "query_id bigint, text string")
    docs = spark.createDataFrame([(1, "red shoes"), (2, "blue hats"), (3, None)], "doc_id bigint, text string")
    rows = retrieval.retrieve(queries, docs, 1, max_queries).collect()
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in rows) == [(1, 1, 1.0), (1, 2, 1.0), (2, rows[-1]["doc_id"] if rows[-1]["query_id"] == 2 else next(r["doc_id"] for r in rows if r["query_id"] == 2), 0.0)]


def test_checksums_tell_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("~", "x"), (None, "x"), ("", "x"), ("1:a", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(row_checksum(F.col("a"), F.col("b")).alias("h")).distinct().count() == len(rows)


def test_empty_table_has_no_duplicates(spark):
    assert spark.createDataFrame([], "k string").agg(quality.duplicates("k").alias("n")).first()["n"] == 0


def test_training_set_checks_the_flag(spark, profiles):
    with pytest.raises(Exception, match="must only contain 0/1"):
        features.training_set(profiles.withColumn("is_repeat_customer", F.lit(2).cast("bigint"))).collect()


def test_money_is_not_rounded_to_cents(spark):
    rows = [(i, f"2024-01-01 00:00:0{i}", 1, "order_completed", a) for i, a in enumerate((0.004, 2.675, 0.004))]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, customer_id bigint, event_type string, amount double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert online_state.online_features(df).first()["monetary"] == pytest.approx(2.683)
    assert max(r["monetary"] for r in online_state.event_state(df).collect()) == pytest.approx(2.683)


def test_watermark_on_times_without_a_zone(spark):
    stream = spark.readStream.format("rate").load().select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.lit("a").alias("event_type"))
    assert online_state.tumbling_counts(stream, late="10 minutes").isStreaming
