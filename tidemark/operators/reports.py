"""Business indicators, distributions, population averages, insights, customer view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import iso_date
from tidemark.session import settle

# Columns whose value distribution is reported.
DISTRIBUTION_COLUMNS = (
    "age_group",
    "country",
    "clv_tier",
    "preferred_device_sess",
    "preferred_source_sess",
    "preferred_payment",
    "preferred_device_ord",
    "preferred_source",
    "top_category_bought",
)
NOT_SET = "Not set"
TOP_VALUES = 6

OUTPUT_COLUMNS = (
    "segment",
    "predicted_clv",
    "predicted_clv_tier",
    "predicted_orders_12m",
    "cart_abandon_probability",
    "discount_sensitivity",
)


def percent(value: Column) -> Column:
    return F.round(value * 100, 1)


def join_scores(profiles: DataFrame, scores: DataFrame, *columns: str) -> DataFrame:
    return profiles.join(scores.select("customer_id", *columns), "customer_id", "left")


def join_outputs(profiles: DataFrame, outputs: DataFrame | None) -> DataFrame:
    """Model outputs per customer, NULL where there is no row or no table."""
    if outputs is None:
        texts = ("segment", "predicted_clv_tier")
        return profiles.withColumns(
            {
                c: F.lit(None).cast("string" if c in texts else "double")
                for c in OUTPUT_COLUMNS
            }
        )
    return profiles.join(outputs.select("customer_id", *OUTPUT_COLUMNS), "customer_id", "left")


def business_metrics(profiles: DataFrame) -> DataFrame:
    """Eight indicators as (category, label, value, format) rows, from one aggregate."""
    metrics = [
        ("sales", "Total Orders", F.sum("total_orders").cast("double"), "number"),
        (
            "sales",
            "Total Spend",
            F.sum(F.col("total_spend_usd").cast("decimal(28,2)")).cast("double"),
            "currency",
        ),
        ("sales", "Avg Basket Value", F.round(F.avg("avg_order_value"), 2), "currency"),
        ("sales", "Avg Discount Rate", F.round(F.avg("avg_discount_pct"), 1), "percent"),
        ("profile", "Repeat Purchase Rate", percent(F.avg("is_repeat_customer")), "percent"),
        ("engagement", "Avg Sessions / Customer", F.round(F.avg("total_sessions"), 1), "number"),
        ("engagement", "Cart Abandonment Rate", percent(F.avg("has_abandoned_cart")), "percent"),
        ("experience", "Avg Satisfaction Score", F.round(F.avg("avg_rating_given"), 2), "number"),
    ]
    row = profiles.agg(*[m[2].alias(f"m{i}") for i, m in enumerate(metrics)])
    cells = [
        F.struct(
            F.lit(category).alias("category"),
            F.lit(label).alias("label"),
            F.col(f"m{i}").alias("value"),
            F.lit(style).alias("format"),
        )
        for i, (category, label, _, style) in enumerate(metrics)
    ]
    return row.select(F.inline(F.array(*cells)))


def segment_distributions(
    scored: DataFrame,
    columns: Sequence[str] = DISTRIBUTION_COLUMNS,
    top: int = TOP_VALUES,
) -> DataFrame:
    """Share, count and mean risk of the ``top`` values of each column, in one pass.

    The columns are unpivoted and counted before any shuffle, so what is ranked is one
    row per distinct value.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("dimension"),
                F.coalesce(F.col(c).cast("string"), F.lit(NOT_SET)).alias("name"),
            )
            for c in columns
        ]
    )
    counted = (
        scored.select("churn_probability", F.inline(cells))
        .groupBy("dimension", "name")
        .agg(F.count("*").alias("count"), F.avg("churn_probability").alias("risk"))
    )
    # One row per reported column.
    totals = counted.groupBy("dimension").agg(F.sum("count").alias("total"))
    order = Window.partitionBy("dimension").orderBy(F.col("count").desc(), F.col("name"))
    ranked = counted.withColumn("position", F.row_number().over(order))
    return (
        ranked.where(F.col("position") <= top)
        .join(F.broadcast(totals), "dimension")
        .select(
            "dimension",
            "position",
            "name",
            F.round(F.col("count") / F.col("total"), 4).alias("share"),
            "count",
            F.round("risk", 3).alias("risk"),
        )
    )


def _top(column: str) -> Column:
    return F.coalesce(F.mode(column, True), F.lit(""))


def population_summary(joined: DataFrame) -> DataFrame:
    """Averages, sums and most frequent values over all customers."""
    return joined.agg(
        F.count("*").alias("total_customers"),
        F.round(F.avg("age"), 1).alias("age_avg"),
        F.round(F.avg("total_orders"), 1).alias("total_orders_avg"),
        F.sum("total_orders").alias("total_orders_sum"),
        F.sum(F.col("total_spend_usd").cast("decimal(28,2)")).cast("double").alias("total_spend_sum"),
        F.round(F.avg("total_spend_usd"), 2).alias("total_spend_avg"),
        F.round(F.avg("avg_order_value"), 2).alias("avg_order_value_avg"),
        F.round(F.avg("avg_discount_pct"), 1).alias("avg_discount_pct_avg"),
        F.round(F.avg("predicted_clv"), 2).alias("predicted_clv_avg"),
        _top("segment").alias("segment_top"),
        _top("predicted_clv_tier").alias("clv_tier_top"),
        percent(F.avg("is_repeat_customer")).alias("repeat_rate"),
        F.round(F.avg("total_sessions"), 1).alias("total_sessions_avg"),
        _top("preferred_device_sess").alias("device_sess_top"),
        _top("preferred_source_sess").alias("source_sess_top"),
        percent(F.avg("has_abandoned_cart")).alias("cart_abandon_rate"),
        percent(F.avg("cart_abandon_probability")).alias("cart_abandon_prob_avg"),
        _top("preferred_payment").alias("payment_top"),
        _top("preferred_device_ord").alias("device_ord_top"),
        _top("preferred_source").alias("source_ord_top"),
        _top("top_category_bought").alias("top_category"),
        F.round(F.avg("avg_rating_given"), 2).alias("avg_rating_avg"),
        F.round(F.avg("discount_sensitivity"), 1).alias("discount_sensitivity_avg"),
    )


def _one_decimal(value: Column) -> Column:
    return F.format_number(value, 1)


def insights(scored: DataFrame, limit: int = 5) -> DataFrame:
    """Up to ``limit`` findings as (position, title, text).

    One pass reduces the customers to a small cube of group sums, which is written once;
    every finding is an aggregate of that cube.
    """
    sums = scored.groupBy(
        "age_group", "is_repeat_customer", "risk_tier", "top_category_bought"
    ).agg(
        F.count("*").alias("n"),
        F.sum("churn_probability").alias("p_sum"),
        F.count("churn_probability").alias("p_n"),
        F.sum("has_abandoned_cart").alias("carts"),
        F.sum(F.coalesce("avg_discount_pct", F.lit(0.0))).alias("disc"),
        F.sum("avg_rating_given").alias("rating_sum"),
        F.count("avg_rating_given").alias("rating_n"),
    )
    cube = settle(sums, "cube")

    def mean(top: str, bottom: str, cond: Column | None = None) -> Column:
        num, den = F.col(top), F.col(bottom)
        if cond is not None:
            num, den = F.when(cond, num), F.when(cond, den)
        return F.try_divide(F.sum(num), F.sum(den))

    totals = cube.agg(
        F.sum("n").alias("n"),
        mean("p_sum", "p_n", F.col("is_repeat_customer") == 0).alias("once"),
        mean("p_sum", "p_n", F.col("is_repeat_customer") == 1).alias("repeat"),
        mean("carts", "n").alias("cart_rate"),
        mean("disc", "n", F.col("risk_tier") == "high").alias("high_disc"),
        mean("disc", "n", F.col("risk_tier") == "low").alias("low_disc"),
        mean("rating_sum", "rating_n").alias("rating"),
    )
    by_age = cube.groupBy("age_group").agg(mean("p_sum", "p_n").alias("p"))
    riskiest = by_age.where("p IS NOT NULL").agg(
        F.max(F.struct("p", "age_group")).alias("age")
    )
    by_category = cube.where("top_category_bought IS NOT NULL").groupBy("top_category_bought")
    popular = by_category.agg(F.sum("n").alias("n")).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "top_category_bought")).alias("cat")
    )
    row = totals.withColumns({"age": riskiest.scalar(), "cat": popular.scalar()})

    def finding(when: Column, title: str, *parts: str | Column) -> Column:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.when(when, F.struct(F.lit(title).alias("title"), text.alias("text")))

    found = F.array_compact(
        F.array(
            finding(
                F.col("age").isNotNull(),
                "Highest-risk demographic",
                "The ",
                F.col("age.age_group"),
                " age group shows the highest average churn risk at ",
                _one_decimal(F.col("age.p") * 100),
                "%.",
            ),
            finding(
                F.col("once").isNotNull() & F.col("repeat").isNotNull(),
                "Repeat buyers churn less",
                "One-time buyers carry ",
                _one_decimal((F.col("once") - F.col("repeat")) * 100),
                " percentage points more churn risk than repeat buyers.",
            ),
            finding(
                F.lit(True),
                "Cart abandonment",
                _one_decimal(F.col("cart_rate") * 100),
                "% of customers have abandoned a cart — a direct re-engagement opportunity.",
            ),
            finding(
                F.col("cat").isNotNull(),
                "Most popular category",
                "'",
                F.col("cat.top_category_bought"),
                "' is the top category, bought by ",
                _one_decimal(-F.col("cat.neg") / F.col("n") * 100),
                "% of customers.",
            ),
            finding(
                F.col("high_disc").isNotNull() & F.col("low_disc").isNotNull(),
                "Discount dependency",
                "High-risk customers average ",
                _one_decimal(F.col("high_disc")),
                "% discount vs ",
                _one_decimal(F.col("low_disc")),
                "% for low-risk customers.",
            ),
            finding(
                F.lit(True),
                "Customer satisfaction",
                "Average rating given by customers is ",
                F.format_number(F.col("rating"), 2),
                " / 5.",
            ),
        )
    )
    kept = F.slice(found, 1, limit)
    return row.select(F.posexplode(kept).alias("position", "item")).select(
        "position", "item.title", "item.text"
    )


# One sentence per tier.
RISK_SENTENCES = {
    "high": ("high", "Immediate re-engagement is recommended."),
    "medium": ("medium", "Monitor and consider an offer."),
    "low": ("low", "Standard retention is sufficient."),
}


def risk_explanation(tier: Column, probability: Column) -> Column:
    def sentence(name: str) -> Column:
        word, advice = RISK_SENTENCES[name]
        return F.concat(
            F.lit(f"This customer has a {word} churn probability ("),
            F.format_number(probability * 100, 0),
            F.lit(f"%). {advice}"),
        )

    return (
        F.when(tier == "high", sentence("high"))
        .when(tier == "medium", sentence("medium"))
        .otherwise(sentence("low"))
    )


def customer_context() -> Column:
    """One line of profile text, from the columns of ``customer_360``."""

    def text(c: str) -> Column:
        return F.col(c).cast("string")

    return F.concat(
        F.lit("Customer "),
        text("customer_id"),
        F.lit("; country "),
        F.col("country"),
        F.lit("; age "),
        text("age"),
        F.lit(" ("),
        F.col("age_group"),
        F.lit("); CLV tier "),
        F.col("clv_tier"),
        F.lit("; orders "),
        text("total_orders"),
        F.lit("; total spend "),
        F.format_number("total_spend_usd", 0),
        F.lit("; sessions "),
        text("total_sessions"),
        F.lit("; abandoned cart "),
        text("has_abandoned_cart"),
        F.lit("; repeat buyer "),
        text("is_repeat_customer"),
        F.lit("; churn probability "),
        F.format_number(F.col("churn_probability") * 100, 1),
        F.lit("%; risk tier "),
        F.col("risk_tier"),
    )


def customer_360(
    profiles: DataFrame, scores: DataFrame | None = None, outputs: DataFrame | None = None
) -> DataFrame:
    """Profile, score and model outputs of every customer; filter by id for one."""
    if scores is None:
        joined = profiles.withColumns(
            {"churn_probability": F.lit(0.0), "risk_tier": F.lit("low")}
        )
    else:
        joined = join_scores(profiles, scores, "churn_probability", "risk_tier")
    joined = join_outputs(joined, outputs)
    rounded = {
        "total_spend_usd": 2,
        "avg_order_value": 2,
        "avg_discount_pct": 2,
        "avg_rating_given": 2,
        "predicted_clv": 2,
        "predicted_orders_12m": 3,
        "cart_abandon_probability": 4,
        "discount_sensitivity": 1,
    }
    dates = ("signup_date", "first_session_date", "last_order_date", "last_session_date")
    view = joined.withColumns(
        {c: F.round(c, digits) for c, digits in rounded.items()}
        | {c: iso_date(F.col(c)) for c in dates}
        | {c: F.coalesce(c, F.lit("")) for c in ("segment", "predicted_clv_tier")}
        | {
            "churn_probability": F.round(F.coalesce("churn_probability", F.lit(0.0)), 4),
            "risk_tier": F.coalesce("risk_tier", F.lit("low")),
        }
    ).drop("first_order_date")
    return view.withColumns(
        {
            "risk_explanation": risk_explanation(F.col("risk_tier"), F.col("churn_probability")),
            "context": customer_context(),
        }
    )
