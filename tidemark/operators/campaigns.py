"""Coupon campaigns, message fan-out, tracking records, escalation and tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.params import DEFAULTS, JobParams

RECOMMENDED_ACTION = "Sales representative should call and present a personalized offer"
ESCALATION_REASON = "High LTV + low confidence (human approval required)"


def outbox(
    messages: DataFrame,
    channels: Sequence[str] | None = None,
    enabled: Sequence[str] = DEFAULTS.enabled_channels,
) -> DataFrame:
    """One record per message and enabled target channel."""
    targets = [c for c in (channels or enabled) if c in enabled]
    return messages.withColumn("channel", F.explode(F.array(*map(F.lit, targets)))) if targets else (
        messages.withColumn("channel", F.lit("")).where(F.lit(False))
    )


def coupon_campaign(
    scores: DataFrame,
    discount_pct: float,
    validity_days: int,
    channel: str = "email",
    campaign: str = "winback",
    params: JobParams = DEFAULTS,
) -> DataFrame:
    """Coupon message per high-risk customer on one channel; codes depend on the id only."""
    if not 0 < discount_pct <= params.max_discount_pct:
        raise ValueError(f"discount must be above 0 and at most {params.max_discount_pct:.0f}")
    if validity_days <= 0:
        raise ValueError("validity_days must be positive")
    digest = F.md5(F.concat(F.lit(f"{campaign}::"), F.col("customer_id").cast("string")))
    code = F.concat(F.lit("COUPON-"), F.upper(F.substring(digest, 1, 8)))
    text = F.concat(
        F.lit(f"Your exclusive {discount_pct:g}% discount coupon: "),
        F.col("coupon_code"),
        F.lit(
            f" (valid for {validity_days} days). Use it on the items you last viewed "
            "or left in your cart."
        ),
    )
    drafts = (
        scores.where(F.col("risk_tier") == "high")
        .select("customer_id", code.alias("coupon_code"))
        .withColumn("content", text)
    )
    return outbox(drafts, [channel], params.enabled_channels)


def campaign_report(sent: DataFrame, discount_pct: float, validity_days: int) -> DataFrame:
    """Totals of a campaign and its first five codes in id order."""
    first = sent.orderBy("customer_id").limit(5)
    codes = first.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("customer_id", "coupon_code"))),
            lambda s: s["coupon_code"],
        )
    )
    return sent.agg(
        F.count("*").alias("sent"),
        F.lit(float(discount_pct)).alias("discount_pct"),
        F.lit(validity_days).alias("validity_days"),
    ).withColumn("coupon_codes", codes.scalar())


def track(
    events: DataFrame, event: str, properties: Column, provider: str = DEFAULTS.cdp_provider
) -> DataFrame:
    """Tracking records for the customer data platform."""
    return events.select(
        F.lit(provider).alias("provider"),
        F.col("customer_id").alias("user_id"),
        F.lit(event).alias("event"),
        properties.alias("properties"),
        F.lit("ok").alias("status"),
    )


def identify(
    customers: DataFrame, traits: Column, provider: str = DEFAULTS.cdp_provider
) -> DataFrame:
    return customers.select(
        F.lit(provider).alias("provider"),
        F.col("customer_id").alias("user_id"),
        traits.alias("traits"),
        F.lit("ok").alias("status"),
    )


def lifetime_value(spend: Column, monetary: Column | None = None) -> Column:
    """Spend, else the streamed monetary total, else 0."""
    fallback = F.lit(0.0) if monetary is None else F.coalesce(monetary, F.lit(0.0))
    return F.coalesce(spend, fallback)


def confidence(probability: Column) -> Column:
    """The churn probability, where a missing or zero one means 0.5."""
    return F.when(probability.isNull() | (probability == 0), 0.5).otherwise(probability)


def should_escalate(
    ltv: Column,
    sureness: Column,
    guardrail_passed: Column,
    complaints: Column,
    params: JobParams = DEFAULTS,
) -> Column:
    return (
        ~guardrail_passed
        | (complaints > 0)
        | ((ltv >= params.high_ltv_threshold) & (sureness < params.confidence_threshold))
    )


def priority(
    ltv: Column, sureness: Column, complaints: Column, params: JobParams = DEFAULTS
) -> Column:
    urgent = (complaints > 0) | ((ltv >= params.high_ltv_threshold) & (sureness < 0.5))
    return F.when(urgent, "high").otherwise("normal")


def route(cases: DataFrame, params: JobParams = DEFAULTS) -> DataFrame:
    """Add ``ltv``, ``confidence``, ``escalated``, ``priority`` and ``decision``.

    Input columns: total_spend_usd, churn_probability, support_complaints, guardrail_passed.
    """
    complaints = F.coalesce("support_complaints", F.lit(0))
    scored = cases.withColumns(
        {
            "ltv": lifetime_value(F.col("total_spend_usd")),
            "confidence": confidence(F.col("churn_probability")),
        }
    )
    ltv, sureness = F.col("ltv"), F.col("confidence")
    passed = F.coalesce("guardrail_passed", F.lit(False))
    return scored.withColumns(
        {
            "escalated": should_escalate(ltv, sureness, passed, complaints, params),
            "priority": priority(ltv, sureness, complaints, params),
        }
    ).withColumn("decision", F.when(F.col("escalated"), "ESCALATED").otherwise("SENT"))


def crm_tasks(routed: DataFrame) -> DataFrame:
    """Task per escalated case. Input adds risk_reason, context and guardrail_reasons."""
    reason = F.when(
        F.size("guardrail_reasons") > 0, F.array_join("guardrail_reasons", "; ")
    ).otherwise(ESCALATION_REASON)
    summary = F.concat(
        F.lit("Customer: "),
        F.col("customer_id").cast("string"),
        F.lit("\nPriority: "),
        F.col("priority"),
        F.lit("\nReason: "),
        reason,
        F.lit(f"\nRecommended action: {RECOMMENDED_ACTION}\n\nSummary:\nChurn risk reason: "),
        F.col("risk_reason"),
        F.lit(". Profile: "),
        F.col("context"),
    )
    return routed.where("escalated").select(
        F.concat(F.lit("CRM-"), F.col("customer_id").cast("string")).alias("task_id"),
        F.lit("open").alias("status"),
        "priority",
        summary.alias("summary"),
    )
