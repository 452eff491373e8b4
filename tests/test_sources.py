from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quality import file_fingerprint
from tidemark.session import scratch_path, settle, shared_folder
from tidemark.sources import csv_profiles, sinks
from tidemark.sources.tables import publish_table, publish_view


@pytest.fixture
def profile_file(spark, tmp_path):
    header = ",".join(csv_profiles.PROFILE_COLUMNS)
    values = {"customer_id": "1", "name": "nan", "signup_date": "2024-01-05", "marketing_opt_in": "True", "total_orders": "0"}
    bad = {"customer_id": "2", "name": "None", "signup_date": "someday", "marketing_opt_in": "False", "total_spend_usd": "12.5"}
    lines = [",".join(v.get(c, "") for c in csv_profiles.PROFILE_COLUMNS) for v in (values, bad)]
    path = tmp_path / "profiles.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_typed_scan_and_lenient_load(spark, profile_file):
    raw = csv_profiles.read_profile_csv(spark, profile_file)
    assert raw.schema == csv_profiles.PROFILE_SCHEMA and len(raw.columns) == 27
    rows = csv_profiles.load_profiles(csv_profiles.normalise_nulls(raw)).orderBy("customer_id").collect()
    assert rows[0]["customer_id"] == "1" and rows[0]["signup_date"].year == 2024
    assert rows[1]["signup_date"] is None and rows[1]["total_spend_usd"] == 12.5
    assert rows[0]["name"] is None and rows[1]["name"] is None
    assert rows[0]["avg_order_value"] is None and rows[0]["marketing_opt_in"] is True


def test_ingest_replaces_the_table(spark, profile_file, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{tmp_path / 'shop'}'")
    assert csv_profiles.ingest_profiles(spark, profile_file, "shop.customers") == 2
    assert csv_profiles.ingest_profiles(spark, profile_file, "shop.customers") == 2
    publish_table(spark.range(10).toDF("k"), "shop.bucketed", bucket_by="k", buckets=2)
    assert spark.table("shop.bucketed").count() == 10
    publish_view(spark.table("shop.customers"), "stg")
    assert spark.table("stg").count() == 2
    spark.sql("DROP DATABASE shop CASCADE")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "feature string, v double")
    sinks.write_dataset(df, str(tmp_path / "p"))
    sinks.write_report(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()
    assert spark.read.json(str(tmp_path / "j")).first()["feature"] == "a"
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["feature", "v"]
    for run in ("r1", "r2"):
        sinks.append_run(spark, str(tmp_path / "runs"), run, {"depth": 3}, {"auc": 0.7})
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert runs.count() == 2 and runs.first()["metrics"]["auc"] == 0.7


def test_file_fingerprint(spark, tmp_path):
    import hashlib

    path = tmp_path / "d.csv"
    path.write_bytes(b"x,y\n1,2\n")
    got = file_fingerprint(spark, str(path)).first()["sha256"]
    assert got == hashlib.sha256(path.read_bytes()).hexdigest()[:16]


def test_settled_tables_lie_in_the_shared_folder(spark):
    df = settle(spark.range(5).withColumn("s", F.lit("x")), "t")
    assert df.count() == 5
    assert shared_folder(spark).removeprefix("file:") in df.inputFiles()[0]
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
