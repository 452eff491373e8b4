"""Recency, frequency and monetary scores and inputs."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binning import bin_right, key_after
from tidemark.functions.dates import days_between
from tidemark.operators.selection import VALUE_LIMIT, Ranks, inner_quantile_edges, key_cuts


def scoring_time(profiles: DataFrame) -> Column:
    """The day after the last order of any customer."""
    latest = profiles.agg(F.max("last_order_date") + F.make_dt_interval(F.lit(1)))
    return latest.scalar()


def bin_starts(bins: int) -> Ranks:
    """Positions at which the equal-count bins of ranked rows start."""

    def starts(n: int) -> list[int]:
        spots = [math.floor((n - 1) * i / bins) + 1 for i in range(1, bins)]
        return [s for s in spots if s < n]

    return starts


def rank_bin(value: Column, key: Column, cuts: Mapping[int, tuple[float, int]]) -> Column:
    """0-based bin of a row: how many bin starts sort at or before its (value, key)."""
    total = F.lit(0)
    for cut in cuts.values():
        at = (value == F.lit(cut[0])) & (key == F.lit(cut[1]))
        total = total + (at | key_after([value, key], cut)).cast("int")
    return total


def rfm_scores(profiles: DataFrame, limit: int = VALUE_LIMIT) -> DataFrame:
    """Scores 1-4 per customer; ``profiles`` is read several times, so pass a settled table.

    Looking up the rows at which bins start replaces ranking all rows.
    """
    days = profiles.select(
        "customer_id",
        F.col("total_orders").cast("double").alias("frequency"),
        F.col("total_spend_usd").alias("monetary"),
        days_between(scoring_time(profiles), F.col("last_order_date")).cast("double").alias("recency"),
    )
    longest = days.agg(F.max("recency")).first()[0]
    filled = days.withColumn("recency", F.coalesce(F.col("recency"), F.lit(longest)))
    edges = inner_quantile_edges(filled, {"recency": F.col("recency")}, 4, limit)["recency"]
    key = F.col("customer_id")
    ranked = {c: F.col(c) for c in ("frequency", "monetary")}
    cuts = key_cuts(filled, ranked, key, bin_starts(4), limit)
    return filled.select(
        "customer_id",
        (F.lit(4) - bin_right(F.col("recency"), edges)).alias("rfm_recency_score"),
        *[
            (rank_bin(F.col(c), key, cuts[c]) + 1).alias(f"rfm_{c}_score")
            for c in ("frequency", "monetary")
        ],
    )


def rfm_matrix(profiles: DataFrame) -> DataFrame:
    """Standardised clustering inputs of the buyers (population deviation)."""
    now = scoring_time(profiles)
    raw = profiles.where(F.col("total_orders") > 0).select(
        "customer_id",
        F.log1p(days_between(now, F.col("last_order_date")).cast("double")).alias("recency"),
        F.col("total_orders").cast("double").alias("frequency"),
        F.log1p(F.greatest(F.col("total_spend_usd"), F.lit(1.0))).alias("monetary"),
    )
    names = ("recency", "frequency", "monetary")
    stats = raw.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in names],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in names],
        )
    ).scalar()
    spread = raw.withColumn("_stats", stats)

    def scaled(c: str) -> Column:
        sd = F.col(f"_stats.s_{c}")
        return ((F.col(c) - F.col(f"_stats.m_{c}")) / F.when(sd == 0, 1.0).otherwise(sd)).alias(c)

    return spread.select("customer_id", *[scaled(c) for c in names])
