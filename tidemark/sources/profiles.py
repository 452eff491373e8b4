"""Customer profiles derived from the order, line, part and event tables.

Only the parts a caller's columns need are built, so a job that reads order
dates never scans the line table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.csv_profiles import PROFILE_COLUMNS
from tidemark.sources.tables import table

AS_OF = "1996-02-01 00:00:00"
EVENT_SHIFT_YEARS = 28

ORDER_COLUMNS = {
    "total_orders",
    "total_spend_usd",
    "avg_order_value",
    "first_order_date",
    "last_order_date",
    "preferred_payment",
    "preferred_device_ord",
    "clv_tier",
    "is_repeat_customer",
}
LINE_COLUMNS = {"avg_discount_pct", "top_category_bought", "preferred_source"}
SESSION_COLUMNS = {
    "avg_rating_given",
    "total_sessions",
    "preferred_device_sess",
    "preferred_source_sess",
    "first_session_date",
    "last_session_date",
    "has_abandoned_cart",
}

# Spend bands of the tier column, in the unit of o_totalprice.
TIER_BANDS = ((250_000, "low"), (450_000, "medium"), (700_000, "high"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    age = F.lit(18) + key % 60
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("customer_id"),
            F.col("c_name").alias("name"),
            F.concat(key.cast("string"), F.lit("@example.com")).alias("email"),
            F.col("n_name").alias("country"),
            age.alias("age"),
            F.when(age <= 24, "18-24")
            .when(age <= 34, "25-34")
            .when(age <= 44, "35-44")
            .when(age <= 54, "45-54")
            .otherwise("55+")
            .alias("age_group"),
            (
                F.expr("TIMESTAMP_NTZ '1994-01-01 00:00:00'")
                + F.make_dt_interval(((key * 37) % 365).cast("int"))
            ).alias("signup_date"),
            (key % 3 != 0).alias("marketing_opt_in"),
        )
    )


def past_orders(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    return table(spark, sf_dir, "orders").where(
        F.col("o_orderdate") < F.expr(f"TIMESTAMP_NTZ '{as_of}'")
    )


def _order_part(orders: DataFrame) -> DataFrame:
    """One row per customer; ``mode`` keeps a count per distinct value and merges map-side."""
    spend = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.count("*").alias("orders"),
        spend.alias("spend"),
        F.min("o_orderdate").alias("first_order_date"),
        F.max("o_orderdate").alias("last_order_date"),
        F.mode("o_orderpriority", True).alias("preferred_payment"),
        F.mode("o_orderstatus", True).alias("preferred_device_ord"),
    )


def _line_part(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Discount, brand and type preferences of the lines of ``orders``.

    Both preferences are exploded and counted per (customer, dimension, value) in one
    shuffle, with the counting begun before it.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    keys = orders.select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    bought = lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey"), "left"
    )
    pairs = F.array(
        F.struct(
            F.lit("brand").alias("dim"),
            F.col("p_brand").alias("value"),
            F.col("l_quantity").cast("decimal(18,2)").alias("weight"),
            F.col("l_discount").cast("decimal(18,4)").alias("disc"),
        ),
        F.struct(
            F.lit("type").alias("dim"),
            F.col("p_type").alias("value"),
            F.lit(1).cast("decimal(18,2)").alias("weight"),
            F.lit(None).cast("decimal(18,4)").alias("disc"),
        ),
    )
    votes = (
        bought.select("customer_id", F.inline(pairs))
        .groupBy("customer_id", "dim", "value")
        .agg(F.sum("weight").alias("weight"), F.sum("disc").alias("disc"), F.count("disc").alias("n"))
    )
    order = F.struct(-F.col("weight"), F.col("value"))
    named = F.col("value").isNotNull()

    def favourite(dim: str):
        return F.min_by(
            F.when((F.col("dim") == dim) & named, F.col("value")),
            F.when((F.col("dim") == dim) & named, order),
        )

    return votes.groupBy("customer_id").agg(
        (F.sum("disc").cast("double") / F.sum("n").cast("double") * F.lit(100.0) + F.lit(0.0)).alias(
            "avg_discount_pct"
        ),
        favourite("brand").alias("top_category_bought"),
        favourite("type").alias("preferred_source"),
    )


def _session_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.col("ts") - F.make_ym_interval(F.lit(EVENT_SHIFT_YEARS), F.lit(0))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer_id"), kind, at.alias("at"), k.alias("k")
    )
    last_click = F.max(F.when(kind == "click", F.col("at")))
    last_purchase = F.max(F.when(kind == "purchase", F.col("at")))
    return events.groupBy("customer_id").agg(
        F.count_if(kind == "view").alias("sessions"),
        F.min("at").alias("first_session_date"),
        F.max("at").alias("last_session_date"),
        F.mode((F.col("k") % 3).cast("string"), True).alias("preferred_device_sess"),
        F.mode((F.col("k") % 4).cast("string"), True).alias("preferred_source_sess"),
        F.avg(F.when(kind == "purchase", F.col("k") % 5 + 1)).alias("avg_rating_given"),
        F.when(last_click.isNull(), 0)
        .when(last_purchase.isNull() | (last_click > last_purchase), 1)
        .otherwise(0)
        .alias("abandoned"),
    )


def profiles(
    spark: SparkSession,
    sf_dir: str,
    as_of: str = AS_OF,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Profile rows with ``columns`` (all 27 when omitted), one per customer."""
    wanted = list(columns or PROFILE_COLUMNS)
    df = _customers(spark, sf_dir)
    orders = past_orders(spark, sf_dir, as_of)
    if ORDER_COLUMNS & set(wanted):
        df = df.join(_order_part(orders), "customer_id", "left")
        n, spend = F.coalesce("orders", F.lit(0)), F.coalesce("spend", F.lit(0.0))
        tier = F.when(n == 0, "no_purchase")
        for limit, label in TIER_BANDS:
            tier = tier.when(spend < limit, label)
        df = df.withColumns(
            {
                "total_orders": n.cast("bigint"),
                "total_spend_usd": spend,
                "avg_order_value": F.col("spend") / F.col("orders"),
                "clv_tier": tier.otherwise("vip"),
                "is_repeat_customer": (n >= 2).cast("bigint"),
            }
        )
    if LINE_COLUMNS & set(wanted):
        df = df.join(_line_part(spark, sf_dir, orders), "customer_id", "left")
    if SESSION_COLUMNS & set(wanted):
        df = df.join(_session_part(spark, sf_dir), "customer_id", "left")
        df = df.withColumns(
            {
                "total_sessions": F.coalesce("sessions", F.lit(0)).cast("bigint"),
                "has_abandoned_cart": F.coalesce("abandoned", F.lit(0)).cast("bigint"),
            }
        )
    return df.select(*wanted)
