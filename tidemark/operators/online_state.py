"""Per-customer event state: after every event, and latest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import whole_number
from tidemark.operators.running import SLICE_ROWS, running_by_key
from tidemark.params import DEFAULTS
from tidemark.sources.events import CART, ORDER, SESSION

# Fine enough that amounts are summed as they are, not to the cent.
MONEY = "decimal(28,8)"

# Fixed value: message text around the cart value.
MESSAGE = (
    "Hello, you still have ",
    " TRY worth of items in your cart. Complete your purchase with a special 10% discount!",
)

STATE_COLUMNS = (
    "cart_abandoned_count",
    "last_cart_value",
    "order_count",
    "monetary",
    "session_count",
)


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _amount() -> Column:
    """Cart value or order amount of the event; absent means 0."""
    return F.coalesce(F.col("amount"), F.lit(0.0))


def event_state(events: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """State of the customer after each event, in (ts, event_id) order."""
    return running_by_key(
        events,
        "customer_id",
        ["ts", "event_id"],
        sums={
            "cart_abandoned_count": _is(CART).cast("bigint"),
            "order_count": _is(ORDER).cast("bigint"),
            "monetary": F.when(_is(ORDER), _amount()).otherwise(0.0).cast(MONEY),
            "session_count": _is(SESSION).cast("bigint"),
        },
        lasts={"last_cart_value": F.when(_is(CART), _amount())},
        slice_rows=slice_rows,
    ).withColumn("monetary", F.col("monetary").cast("double"))


def online_features(events: DataFrame) -> DataFrame:
    """Latest state per customer by plain aggregation; what a reader of the state sees."""
    at = F.struct("ts", "event_id")
    return events.groupBy("customer_id").agg(
        F.max_by("event_type", at).alias("last_event_type"),
        F.max("ts").alias("last_event_at"),
        F.count_if(_is(CART)).alias("cart_abandoned_count"),
        F.max_by(F.when(_is(CART), _amount()), F.when(_is(CART), at)).alias("last_cart_value"),
        F.count_if(_is(ORDER)).alias("order_count"),
        F.coalesce(
            F.sum(F.when(_is(ORDER), _amount()).cast(MONEY)).cast("double"), F.lit(0.0)
        ).alias("monetary"),
        F.count_if(_is(SESSION)).alias("session_count"),
    )


def merge_features(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert per customer: an update's value wins, a NULL in it keeps the stored one."""
    stored, new = current.alias("s"), updates.alias("n")
    columns = [c for c in dict.fromkeys([*current.columns, *updates.columns]) if c != "customer_id"]

    def merged(c: str) -> Column:
        sides = [f"n.{c}"] * (c in updates.columns) + [f"s.{c}"] * (c in current.columns)
        return F.coalesce(*sides).alias(c)

    key = F.coalesce("n.customer_id", "s.customer_id").alias("customer_id")
    joined = stored.join(new, F.col("s.customer_id") == F.col("n.customer_id"), "full")
    return joined.select(key, *[merged(c) for c in columns])


def read_features(state: DataFrame, customers: DataFrame) -> DataFrame:
    """Stored features of the given customers; unknown ones have NULLs."""
    return customers.select("customer_id").join(state, "customer_id", "left")


def rule_risk(carts: Column, cart_value: Column) -> Column:
    """Risk without a model: grows with abandoned carts and a large last cart."""
    large = (F.coalesce(cart_value, F.lit(0.0)) > 100).cast("double")
    raw = F.lit(0.3) + F.lit(0.2) * F.coalesce(carts, F.lit(0)).cast("double") + F.lit(0.1) * large
    return F.least(F.lit(0.95), raw)


def reengagement(
    states: DataFrame,
    triggers: tuple[str, ...] = DEFAULTS.trigger_events,
    scorer: Callable[[DataFrame], Column] | None = None,
    channels: tuple[str, ...] = DEFAULTS.enabled_channels,
) -> DataFrame:
    """Result per event: whether it triggers, and then risk, channels and message."""
    risk = (
        scorer(states)
        if scorer
        else rule_risk(F.col("cart_abandoned_count"), F.col("last_cart_value"))
    )
    text = F.concat(F.lit(MESSAGE[0]), whole_number(_amount()), F.lit(MESSAGE[1]))
    fired = F.col("event_type").isin(*triggers)
    return states.select(
        "event_id",
        "ts",
        "customer_id",
        "event_type",
        fired.alias("triggered"),
        F.when(fired, risk).alias("risk"),
        F.when(fired, F.array(*[F.lit(c) for c in channels])).alias("channels"),
        F.when(fired, text).alias("message"),
    )


def session_counts(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions per customer: a new one starts after a pause longer than the gap."""
    seen = running_by_key(
        events, "customer_id", ["ts", "event_id"], lasts={"previous": F.col("ts")}, before_row=True
    )
    pause = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(gap_minutes))
    starts = F.col("previous").isNull() | (F.col("ts") > F.col("previous") + pause)
    return seen.groupBy("customer_id").agg(
        F.count_if(starts).alias("sessions"), F.count("*").alias("events")
    )


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events per type and window; ``late`` sets a watermark for streams."""
    # A watermark needs an instant; times without a zone are read in the session's.
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    return (
        source.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("events"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "event_type",
            "events",
        )
    )
