"""Profiles, staging, marts, features, labels, training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.plans.base_sql import sql
from tidemark.plans.registry import query
from tidemark.sources.csv_profiles import PROFILE_COLUMNS, load_profiles
from tidemark.sources.profiles import profiles
from tidemark.sources.tables import table

LOADED = ", ".join("CAST(customer_id AS VARCHAR) AS customer_id" if c == "customer_id" else c for c in PROFILE_COLUMNS)


@query("load_profiles", sql(f"SELECT {LOADED} FROM profiles", "profiles"))
def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_profiles(profiles(spark, sf_dir))


@query(
    "stg_customers",
    sql(f"SELECT {', '.join(PROFILE_COLUMNS)} FROM profiles WHERE customer_id IS NOT NULL", "profiles"),
)
def _staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.staged_customers(profiles(spark, sf_dir))


@query("reference_date", sql("SELECT ref_date AS reference_date FROM ref", "ref"))
def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.reference_date(profiles(spark, sf_dir, columns=ft.DATE_COLUMNS))


@query("churn_labels", sql("SELECT * FROM labels_churn", "labels_churn"))
def _churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.churn_labels(profiles(spark, sf_dir, columns=(ft.ID, ft.LABEL)))


@query("recency_churn", sql("SELECT * FROM labels_recency", "labels_recency"))
def _recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.recency_churn_labels(profiles(spark, sf_dir, columns=(ft.ID, *ft.DATE_COLUMNS)))


@query("customer_features", sql("SELECT * FROM features", "features"))
def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.customer_features(profiles(spark, sf_dir, columns=ft.FEATURE_INPUTS))


@query("training_set", sql("SELECT * FROM training", "training"))
def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.training_set(profiles(spark, sf_dir, columns=ft.FEATURE_INPUTS))


@query("training_set_join", sql("SELECT * FROM training", "training"))
def _training_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.build_dataset(profiles(spark, sf_dir, columns=ft.FEATURE_INPUTS))["training_set"]


MART = ", ".join(ft.MART_PASSTHROUGH)


@query(
    "mart_customer_features",
    sql(
        f"""SELECT {MART}, CASE WHEN total_orders >= 1 THEN 1 ELSE 0 END AS has_purchase,
  CAST(date_diff('day', signup_date, ref_date) AS INTEGER) AS tenure_days,
  CAST(date_diff('day', last_order_date, ref_date) AS INTEGER) AS recency_days,
  CAST(date_diff('day', last_session_date, ref_date) AS INTEGER) AS session_recency_days,
  total_spend_usd / (total_sessions + 1) AS spend_per_session
FROM profiles CROSS JOIN ref""",
        "profiles",
        "ref",
    ),
)
def _mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.mart_features(ft.staged_customers(profiles(spark, sf_dir)))


@query(
    "mart_churn_labels",
    sql("SELECT customer_id, CASE WHEN is_repeat_customer = 0 THEN 1 ELSE 0 END AS churn FROM profiles", "profiles"),
)
def _mart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.mart_labels(
        ft.staged_customers(profiles(spark, sf_dir, columns=(ft.ID, ft.LABEL)))
    )


@query(
    "asof_features",
    """SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderdate AS label_ts, e.state_ts, e.event_type, e.amount
FROM orders o ASOF LEFT JOIN (
  SELECT user_id, ts - INTERVAL 26 YEARS AS state_ts, event_type, value AS amount FROM events) e
ON o.o_custkey = e.user_id AND o.o_orderdate >= e.state_ts""",
)
def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("label_ts"),
    )
    states = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"),
        (F.col("ts") - F.make_ym_interval(F.lit(26), F.lit(0))).alias("state_ts"),
        "event_type",
        F.col("value").alias("amount"),
    )
    return ft.asof_features(labels, states)
