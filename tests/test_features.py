from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dates import days_between
from tidemark.operators import features as ft


def test_labels(profiles):
    rows = ft.churn_labels(profiles).orderBy("customer_id").collect()
    assert [r["churn"] for r in rows] == [1, 1, 0]


def test_label_outside_01_fails(profiles):
    bad = profiles.withColumn("is_repeat_customer", F.lit(2).cast("bigint"))
    with pytest.raises(Exception, match="0/1"):
        ft.churn_labels(bad).collect()
    with pytest.raises(ValueError):
        ft.churn_labels(profiles.drop("is_repeat_customer"))
    with pytest.raises(ValueError):
        ft.churn_labels(profiles.drop("customer_id"))


def test_reference_date(profiles):
    row = ft.reference_date(ft.parse_dates(profiles)).first()
    assert row["reference_date"] == datetime.datetime(2022, 8, 1)
    with pytest.raises(ValueError):
        ft.reference_date(profiles.select("customer_id"))


def test_features(profiles):
    df = ft.customer_features(profiles).orderBy("customer_id")
    assert df.columns == ["customer_id", *ft.FEATURE_COLUMNS]
    first, second, third = df.collect()
    assert [r["has_purchase"] for r in (first, second, third)] == [0, 1, 1]
    assert [r["age_group_code"] for r in (first, second, third)] == [0, 2, -1]
    assert third["country"] == "MISSING" and second["preferred_device_sess"] == "web"
    assert first["tenure_days"] == 212 and first["recency_days"] is None
    assert third["days_to_first_session"] == -2
    assert third["order_session_gap_days"] == -52
    assert [r["has_rating"] for r in (first, second, third)] == [0, 1, 0]


def test_forbidden_columns_stay_out():
    assert not {"name", "email", "total_orders", "is_repeat_customer"} & set(ft.FEATURE_COLUMNS)


def test_recency_churn(profiles):
    rows = ft.recency_churn_labels(profiles, 100, "2022-08-01 00:00:00").orderBy("customer_id")
    assert [r["recency_churn"] for r in rows.collect()] == [1, 1, 0]


def test_joined_and_projected_training_sets_agree(profiles):
    joined = ft.build_dataset(profiles)["training_set"]
    projected = ft.training_set(profiles)
    assert joined.columns == projected.columns
    assert joined.exceptAll(projected).count() == projected.exceptAll(joined).count() == 0


def test_days_are_floored(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00' AS a, TIMESTAMP_NTZ '2024-01-01 11:00:00' AS b, "
        "TIMESTAMP_NTZ '2024-01-03 09:59:59' AS c"
    )
    row = df.select(
        days_between(F.col("a"), F.col("b")).alias("x"), days_between(F.col("c"), F.col("a")).alias("y")
    ).first()
    assert (row["x"], row["y"]) == (-1, 1)


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("2024-01-01",), ("soon",)], "signup_date string")
    assert ft.parse_dates(df).where("signup_date IS NULL").count() == 1


def test_asof(spark):
    labels = spark.sql(
        "SELECT * FROM VALUES (1L, 10, TIMESTAMP_NTZ '2024-01-02'), (1L, 11, TIMESTAMP_NTZ '2023-01-01'), "
        "(2L, 12, TIMESTAMP_NTZ '2024-01-01') AS t(customer_id, n, label_ts)"
    )
    states = spark.sql(
        "SELECT * FROM VALUES (1L, TIMESTAMP_NTZ '2024-01-01', 'a'), (1L, TIMESTAMP_NTZ '2024-01-02', 'b'), "
        "(1L, TIMESTAMP_NTZ '2024-01-03', 'c') AS t(customer_id, state_ts, v)"
    )
    got = {r["n"]: r["v"] for r in ft.asof_features(labels, states).collect()}
    assert got == {10: "b", 11: None, 12: None}
