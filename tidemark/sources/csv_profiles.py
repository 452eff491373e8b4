"""Customer profile files: declared schema, lenient load, ingest to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tidemark.sources.tables import publish_table

# The 27 profile columns in file order.
PROFILE_COLUMNS: dict[str, type] = {
    "customer_id": LongType,
    "name": StringType,
    "email": StringType,
    "country": StringType,
    "age": LongType,
    "age_group": StringType,
    "signup_date": StringType,
    "marketing_opt_in": BooleanType,
    "total_orders": LongType,
    "total_spend_usd": DoubleType,
    "avg_order_value": DoubleType,
    "avg_discount_pct": DoubleType,
    "first_order_date": StringType,
    "last_order_date": StringType,
    "preferred_payment": StringType,
    "preferred_device_ord": StringType,
    "preferred_source": StringType,
    "top_category_bought": StringType,
    "avg_rating_given": DoubleType,
    "total_sessions": LongType,
    "preferred_device_sess": StringType,
    "preferred_source_sess": StringType,
    "first_session_date": StringType,
    "last_session_date": StringType,
    "has_abandoned_cart": LongType,
    "clv_tier": StringType,
    "is_repeat_customer": LongType,
}
PROFILE_SCHEMA = StructType([StructField(n, t(), True) for n, t in PROFILE_COLUMNS.items()])
DATE_COLUMNS = (
    "signup_date",
    "first_order_date",
    "last_order_date",
    "first_session_date",
    "last_session_date",
)
# Texts that stand for a missing string.
NULL_TEXTS = ("nan", "None")


def read_profile_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed scan; empty fields are NULL."""
    return (
        spark.read.schema(PROFILE_SCHEMA)
        .option("header", True)
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def ingest_profiles(spark: SparkSession, path: str, table: str = "customers") -> int:
    """Create or replace ``table`` from the file and return its row count."""
    publish_table(read_profile_csv(spark, path).select(*PROFILE_COLUMNS), table)
    return spark.table(table).count()


def parse_dates(df: DataFrame) -> DataFrame:
    """Dates that cannot be read become NULL."""
    present = [c for c in DATE_COLUMNS if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in present})


def load_profiles(df: DataFrame) -> DataFrame:
    """Lenient typing of a profile frame: dates, opt-in flag, text id."""
    return parse_dates(df).withColumns(
        {
            "marketing_opt_in": F.col("marketing_opt_in").cast("boolean"),
            "customer_id": F.col("customer_id").cast("string"),
        }
    )


def normalise_nulls(df: DataFrame) -> DataFrame:
    """String fields spelled like a missing value become NULL."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns(
        {c: F.when(~F.col(c).isin(*NULL_TEXTS), F.col(c)) for c in strings}
    )
