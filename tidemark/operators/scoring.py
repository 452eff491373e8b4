"""Risk tiers, rule scores and score summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binning import labelled_ranges
from tidemark.functions.dates import days_between
from tidemark.operators.features import reference_value
from tidemark.params import DEFAULTS, JobParams

# Profile columns the rule score reads.
RULE_INPUTS = (
    "customer_id",
    "signup_date",
    "first_order_date",
    "last_order_date",
    "first_session_date",
    "last_session_date",
    "has_abandoned_cart",
)


def risk_tier(probability: Column, params: JobParams = DEFAULTS) -> Column:
    """low up to the medium threshold, medium up to the high one, high above; else NULL."""
    return labelled_ranges(
        probability,
        (
            (-0.01, params.medium_risk_threshold, "low"),
            (params.medium_risk_threshold, params.high_risk_threshold, "medium"),
            (params.high_risk_threshold, 1.01, "high"),
        ),
    )


def with_tier(scores: DataFrame, params: JobParams = DEFAULTS) -> DataFrame:
    return scores.withColumn("risk_tier", risk_tier(F.col("churn_probability"), params))


def rule_scores(
    profiles: DataFrame, reference: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Scores by a fixed rule, for jobs that need scores where no model is fitted."""
    idle = days_between(reference_value(profiles, reference), F.col("last_order_date"))
    capped = F.least(F.coalesce(idle, F.lit(365)), F.lit(365)).cast("double")
    probability = (
        F.lit(0.15)
        + F.lit(0.2) * F.col("has_abandoned_cart").cast("double")
        + F.lit(0.6) * capped / F.lit(365.0)
    )
    return with_tier(
        profiles.select("customer_id", *keep, probability.alias("churn_probability"))
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Row count, mean probability, high-risk count and tier counts."""
    return scores.agg(
        F.count("*").alias("total_customers"),
        F.round(F.avg("churn_probability"), 4).alias("avg_churn_probability"),
        *[
            F.count_if(F.col("risk_tier") == tier).alias(f"{tier}_count")
            for tier in ("low", "medium", "high")
        ],
    )


def risk_segments(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_tier").agg(F.count("*").alias("customers"))
