"""Quality counts and declared constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tidemark.functions.hashing import row_checksum


def _null_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns]


def _null_pairs(columns: Sequence[str]) -> Column:
    """The non-zero NULL counts as an array of (column, missing)."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_null_{c}").alias("missing"))
            for c in columns
        ]
    )
    return F.filter(pairs, lambda p: p["missing"] > 0)


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing) for each column with a NULL."""
    return df.agg(*_null_counts(df)).select(F.inline(_null_pairs(df.columns)))


def duplicates(key: str) -> Column:
    """Rows beyond the first of each key; NULL counts as one key."""
    keys = F.count_distinct(F.col(key)) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))
    return F.count("*") - keys


def quality_report(df: DataFrame) -> DataFrame:
    """One row of counts and the issue texts, from one pass over ``df``."""
    aggs = [F.count("*").alias("total_rows"), *_null_counts(df)]
    zero = F.lit(0).cast("bigint")
    have = set(df.columns)
    if "customer_id" in have:
        aggs += [
            F.count_distinct("customer_id").alias("unique_customers"),
            duplicates("customer_id").alias("duplicated_customer_ids"),
        ]
    flags = {
        "no_purchase_count": ("total_orders", 0),
        "abandoned_cart_count": ("has_abandoned_cart", 1),
        "repeat_customer_count": ("is_repeat_customer", 1),
    }
    aggs += [
        F.count_if(F.col(c) == v).alias(name) for name, (c, v) in flags.items() if c in have
    ]
    counts = df.agg(*aggs)
    absent = {
        name: zero
        for name in ("unique_customers", "duplicated_customer_ids", *flags)
        if name not in counts.columns
    }
    counts = counts.withColumns(absent).withColumn(
        "invalid_dates", F.col("_null_signup_date") if "signup_date" in have else zero
    )
    listed = F.array_join(
        F.transform(
            _null_pairs(df.columns),
            lambda p: F.concat(F.lit("'"), p["column"], F.lit("': "), p["missing"].cast("string")),
        ),
        ", ",
    )
    issues = F.array(
        F.when(
            F.col("duplicated_customer_ids") > 0,
            F.concat(F.col("duplicated_customer_ids").cast("string"), F.lit(" duplicate customer_id")),
        ),
        F.when(listed != "", F.concat(F.lit("Missing values: {"), listed, F.lit("}"))),
        F.when(
            F.col("invalid_dates") > 0,
            F.concat(
                F.col("invalid_dates").cast("string"), F.lit(" rows with invalid signup_date")
            ),
        ),
    )
    return counts.select(
        "total_rows",
        "unique_customers",
        "duplicated_customer_ids",
        *flags,
        "invalid_dates",
        F.array_compact(issues).alias("issues"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column.

    Rows meet by a 256-bit digest, so long texts are not shuffled.
    """
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    # Adding 0.0 makes negative zero equal to zero.
    cells = [(F.col(c) + F.lit(0.0) if c in floating else F.col(c)).alias(c) for c in df.columns]
    digest = F.sha2(F.to_json(F.struct(*cells)), 256).alias("row")
    groups = df.select(digest).groupBy("row").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def constraint_tests(
    models: Mapping[str, DataFrame],
    not_null: Mapping[str, Sequence[str]],
    unique: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Failing rows (not_null) and failing keys (unique) per model and column."""
    parts: list[DataFrame] = []
    for model, columns in not_null.items():
        counts = models[model].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        rows = F.array(
            *[
                F.struct(
                    F.lit(model).alias("model"),
                    F.lit(c).alias("column"),
                    F.lit("not_null").alias("test"),
                    F.col(c).alias("failures"),
                )
                for c in columns
            ]
        )
        parts.append(counts.select(F.inline(rows)))
    for model, columns in unique.items():
        for c in columns:
            keys = models[model].where(F.col(c).isNotNull()).groupBy(c).count()
            parts.append(
                keys.agg(F.count_if(F.col("count") > 1).alias("failures")).select(
                    F.lit(model).alias("model"),
                    F.lit(c).alias("column"),
                    F.lit("unique").alias("test"),
                    "failures",
                )
            )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum over all columns, as text: the sum outgrows 64 bits (up to 1e18 rows)."""
    total = F.sum(row_checksum(*[F.col(c) for c in df.columns]).cast("decimal(28,0)"))
    return df.agg(
        F.count("*").alias("total_rows"),
        F.coalesce(total, F.lit(0)).cast("string").alias("checksum"),
    )


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of each file below ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("sha256"))
