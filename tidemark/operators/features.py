"""Labels, leakage-free features and the training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import calendar_days, days_between
from tidemark.operators.running import carry_last
from tidemark.params import DEFAULTS
from tidemark.sources.csv_profiles import DATE_COLUMNS, parse_dates

ID, LABEL, TARGET, RECENCY_TARGET = (
    "customer_id",
    "is_repeat_customer",
    "churn",
    "recency_churn",
)

# Ordinal codes are the positions in this list.
AGE_GROUPS = ("18-24", "25-34", "35-44", "45-54", "55+")
STRING_CATEGORICALS = ("country", "preferred_device_sess", "preferred_source_sess")
MISSING = "MISSING"

# Ordered feature schema shared by training and scoring.
FEATURE_COLUMNS = (
    "age",
    "age_group_code",
    "country",
    "marketing_opt_in",
    "tenure_days",
    "total_sessions",
    "days_to_first_session",
    "session_span_days",
    "session_recency_days",
    "preferred_device_sess",
    "preferred_source_sess",
    "has_abandoned_cart",
    "has_purchase",
    "days_to_first_order",
    "recency_days",
    "order_session_gap_days",
    "has_rating",
    "avg_rating_given",
)

# Profile columns the features and labels read.
FEATURE_INPUTS = (
    ID,
    "country",
    "age",
    "age_group",
    "signup_date",
    "marketing_opt_in",
    "total_orders",
    "first_order_date",
    "last_order_date",
    "avg_rating_given",
    "total_sessions",
    "preferred_device_sess",
    "preferred_source_sess",
    "first_session_date",
    "last_session_date",
    "has_abandoned_cart",
    LABEL,
)


def reference_date(profiles: DataFrame) -> DataFrame:
    """One row: the latest date of any date column, NULL columns ignored."""
    present = [c for c in DATE_COLUMNS if c in profiles.columns]
    if not present:
        raise ValueError("no date column to take a reference date from")
    tops = [F.max(c).alias(c) for c in present]
    latest = F.greatest(*present) if len(present) > 1 else F.col(present[0])
    return profiles.agg(*tops).select(latest.alias("reference_date"))


def reference_value(profiles: DataFrame, reference: str | None = None) -> Column:
    """The reference date as an expression: a literal, or a scalar subquery over the profiles.

    The subquery runs once and its single value reaches the tasks, so no join is planned.
    """
    if reference is not None:
        return F.expr(f"TIMESTAMP_NTZ '{reference}'")
    return reference_date(profiles).scalar()


def churn_labels(profiles: DataFrame) -> DataFrame:
    """``churn = 1 - is_repeat_customer``; any other flag value fails the job."""
    for col in (LABEL, ID):
        if col not in profiles.columns:
            raise ValueError(f"column not found: {col}")
    return profiles.select(ID, checked_label().cast("int").alias(TARGET))


def checked_label() -> Column:
    """One less the repeat flag, which must be 0, 1 or NULL."""
    flag = F.col(LABEL)
    return F.when(flag.isNull() | flag.isin(0, 1), F.lit(1) - flag).otherwise(
        F.raise_error(F.lit(f"{LABEL} must only contain 0/1"))
    )


def recency_churn_labels(
    profiles: DataFrame,
    horizon_days: int = DEFAULTS.recency_horizon_days,
    reference: str | None = None,
) -> DataFrame:
    """1 without an order, or with the last one more than ``horizon_days`` ago."""
    df = parse_dates(profiles)
    ref = reference_value(df, reference)
    late = days_between(ref, F.col("last_order_date")) > horizon_days
    return df.select(
        ID, (F.col("last_order_date").isNull() | late).cast("int").alias(RECENCY_TARGET)
    )


def _feature_exprs(ref: Column) -> dict[str, Column]:
    signup = F.col("signup_date")
    first_order, last_order = F.col("first_order_date"), F.col("last_order_date")
    first_session, last_session = F.col("first_session_date"), F.col("last_session_date")
    codes = F.create_map(*[F.lit(x) for i, g in enumerate(AGE_GROUPS) for x in (g, i)])
    tenure = days_between(ref, signup)
    exprs = {
        "age_group_code": F.coalesce(F.try_element_at(codes, F.col("age_group")), F.lit(-1)),
        "marketing_opt_in": F.col("marketing_opt_in").cast("int"),
        "tenure_days": F.when(tenure < 0, 0).otherwise(tenure),
        "days_to_first_session": days_between(first_session, signup),
        "session_span_days": days_between(last_session, first_session),
        "session_recency_days": days_between(ref, last_session),
        "has_abandoned_cart": F.col("has_abandoned_cart").cast("int"),
        "has_purchase": F.coalesce(F.col("total_orders") >= 1, F.lit(False)).cast("int"),
        "days_to_first_order": days_between(first_order, signup),
        "recency_days": days_between(ref, last_order),
        "order_session_gap_days": days_between(last_order, last_session),
        "has_rating": F.col("avg_rating_given").isNotNull().cast("int"),
    }
    exprs |= {c: F.coalesce(F.col(c), F.lit(MISSING)) for c in STRING_CATEGORICALS}
    return exprs


def customer_features(profiles: DataFrame, reference: str | None = None) -> DataFrame:
    """``customer_id`` and the 18 features in their fixed order."""
    df = parse_dates(profiles)
    exprs = _feature_exprs(reference_value(df, reference))
    return df.select(ID, *[exprs.get(c, F.col(c)).alias(c) for c in FEATURE_COLUMNS])


def build_dataset(profiles: DataFrame, reference: str | None = None) -> dict[str, DataFrame]:
    """Features, labels and the joined training set."""
    features = customer_features(profiles, reference)
    labels = churn_labels(profiles)
    recency = recency_churn_labels(profiles, reference=reference)
    return {
        "features": features,
        "labels": labels,
        "training_set": features.join(labels, ID).join(recency, ID),
    }


def training_set(profiles: DataFrame, reference: str | None = None) -> DataFrame:
    """The training set when all three inputs are the same profile rows.

    Features and both labels are projections of one scan; joining them on a unique
    key would give the same rows and cost two shuffles.
    """
    df = parse_dates(profiles)
    ref = reference_value(df, reference)
    exprs = _feature_exprs(ref)
    late = days_between(ref, F.col("last_order_date")) > DEFAULTS.recency_horizon_days
    return df.select(
        ID,
        *[exprs.get(c, F.col(c)).alias(c) for c in FEATURE_COLUMNS],
        checked_label().cast("int").alias(TARGET),
        (F.col("last_order_date").isNull() | late).cast("int").alias(RECENCY_TARGET),
    )


# Columns the mart passes through unchanged.
MART_PASSTHROUGH = (
    ID,
    "country",
    "age",
    "age_group",
    "clv_tier",
    "total_spend_usd",
    "total_sessions",
    "avg_order_value",
    "avg_discount_pct",
    "avg_rating_given",
    "has_abandoned_cart",
    "marketing_opt_in",
    "preferred_payment",
    "preferred_device_ord",
    "preferred_source",
    "top_category_bought",
    "preferred_device_sess",
    "preferred_source_sess",
)


def staged_customers(raw: DataFrame) -> DataFrame:
    """Staging model: safe-cast dates, rows without a key dropped."""
    return parse_dates(raw).where(F.col(ID).isNotNull())


def mart_features(staged: DataFrame) -> DataFrame:
    """Reporting features; day counts here are calendar days and are not clipped."""
    ref = reference_date(staged).scalar()
    return staged.select(
        *MART_PASSTHROUGH,
        F.when(F.col("total_orders") >= 1, 1).otherwise(0).alias("has_purchase"),
        calendar_days(ref, F.col("signup_date")).alias("tenure_days"),
        calendar_days(ref, F.col("last_order_date")).alias("recency_days"),
        calendar_days(ref, F.col("last_session_date")).alias("session_recency_days"),
        (F.col("total_spend_usd") / (F.col("total_sessions") + 1)).alias("spend_per_session"),
    )


def mart_labels(staged: DataFrame) -> DataFrame:
    return staged.select(ID, F.when(F.col(LABEL) == 0, 1).otherwise(0).alias(TARGET))


def asof_features(labels: DataFrame, states: DataFrame) -> DataFrame:
    """Latest state at or before each label time.

    ``labels``: customer_id, label_ts and more; ``states``: customer_id, state_ts and state
    columns. Both sides become one time-ordered run per customer, so no pair of a label
    with all its earlier states is ever formed.
    """
    extra = [c for c in labels.columns if c not in (ID, "label_ts")]
    cols = [c for c in states.columns if c not in (ID, "state_ts")]
    tagged = states.select(
        ID,
        F.col("state_ts").alias("at"),
        F.lit(0).alias("side"),
        F.struct("state_ts", *cols).alias("state"),
    ).unionByName(
        labels.select(
            ID, F.col("label_ts").alias("at"), F.lit(1).alias("side"), F.struct(*extra).alias("label")
        ),
        allowMissingColumns=True,
    )
    filled = carry_last(tagged, ID, ["at", "side"], "state")
    return filled.where(F.col("side") == 1).select(
        ID, F.col("at").alias("label_ts"), "label.*", "state.*"
    )
