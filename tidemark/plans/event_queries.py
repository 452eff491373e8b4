"""Events, online state, the re-engagement flow in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import online_state as state
from tidemark.plans.base_sql import cte, sql
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import events as ev
from tidemark.sources.tables import table
from tidemark.streaming import flow

cte(
    "stream",
    (),
    """stream AS (
  SELECT event_id, ts, user_id AS customer_id, CASE event_type WHEN 'click' THEN 'cart_abandoned' WHEN 'purchase' THEN 'order_completed' ELSE 'session_ended' END AS event_type, value AS amount
  FROM events WHERE event_type IN ('click', 'purchase', 'view'))""",
)
cte(
    "after",
    ("stream",),
    """after AS (
  SELECT *, CAST(sum(CAST(event_type = 'cart_abandoned' AS BIGINT)) OVER w AS BIGINT) AS cart_abandoned_count,
    last_value(CASE WHEN event_type = 'cart_abandoned' THEN COALESCE(amount, 0) END IGNORE NULLS) OVER w AS last_cart_value,
    CAST(sum(CAST(event_type = 'order_completed' AS BIGINT)) OVER w AS BIGINT) AS order_count,
    CAST(sum(CASE WHEN event_type = 'order_completed' THEN CAST(amount AS DECIMAL(28,8)) ELSE 0 END) OVER w AS DOUBLE) AS monetary,
    CAST(sum(CAST(event_type = 'session_ended' AS BIGINT)) OVER w AS BIGINT) AS session_count
  FROM stream WINDOW w AS (PARTITION BY customer_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""",
)
cte(
    "results",
    ("after",),
    """results AS (
  SELECT event_id, ts, customer_id, event_type, event_type = 'cart_abandoned' AS triggered,
    CASE WHEN event_type = 'cart_abandoned' THEN LEAST(0.95::DOUBLE, 0.3::DOUBLE + 0.2::DOUBLE * CAST(cart_abandoned_count AS DOUBLE) + 0.1::DOUBLE * CAST(last_cart_value > 100 AS INTEGER)) END AS risk,
    CASE WHEN event_type = 'cart_abandoned' THEN ['email', 'sms', 'push'] END AS channels,
    CASE WHEN event_type = 'cart_abandoned' THEN 'Hello, you still have ' || printf('%.0f', amount) || ' TRY worth of items in your cart. Complete your purchase with a special 10% discount!' END AS message
  FROM after)""",
)


@query("event_scan", sql("SELECT * FROM stream", "stream"))
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.batch_events(spark, sf_dir)


@query(
    "event_parse",
    """SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS customer_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INTEGER) AS properties, CASE WHEN event_type = 'signup' THEN 0.0::DOUBLE ELSE CAST(epoch_us(ts) // 1000000 AS DOUBLE) END AS timestamp
FROM events""",
)
def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to JSON records and back; errors have no properties, sign-ups no time."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)).cast("double")
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.col("user_id").cast("string").alias("customer_id"),
        F.when(F.col("event_type") != "error", F.create_map(F.lit("value"), F.col("value"))).alias(
            "properties"
        ),
        F.when(F.col("event_type") != "signup", seconds).alias("timestamp"),
    )
    records = raw.select(
        "event_id",
        F.to_json(F.struct("event_type", "customer_id", "properties", "timestamp")).alias("record"),
    )
    parsed = ev.parse_records(records, F.timestamp_seconds(F.lit(0)))
    return parsed.select(
        "event_id",
        "event_type",
        "customer_id",
        F.try_element_at("properties", F.lit("value")).alias("value"),
        F.size("properties").alias("properties"),
        "timestamp",
    )


@query("event_state", sql("SELECT * FROM after", "after"))
def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.event_state(ev.batch_events(spark, sf_dir))


@query(
    "online_features",
    sql(
        """SELECT customer_id, arg_max(event_type, ts) AS last_event_type, max(ts) AS last_event_at, max(cart_abandoned_count) AS cart_abandoned_count,
  arg_max(last_cart_value, ts) AS last_cart_value, max(order_count) AS order_count, max(monetary) AS monetary, max(session_count) AS session_count
FROM after GROUP BY 1""",
        "after",
    ),
)
def _online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.online_features(ev.batch_events(spark, sf_dir))


@query("reengagement", sql("SELECT * FROM results", "results"))
def _reengagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.reengagement(state.event_state(ev.batch_events(spark, sf_dir)))


@query(
    "cdp_track",
    sql(
        "SELECT 'segment' AS provider, customer_id AS user_id, 'reengagement_sent' AS event, risk, channels, 'ok' AS status FROM results WHERE triggered",
        "results",
    ),
)
def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = state.reengagement(state.event_state(ev.batch_events(spark, sf_dir)))
    return flow.tracking(results).select("provider", "user_id", "event", "properties.*", "status")


@query("reengagement_stream", sql("SELECT * FROM results", "results"))
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results from the stateful stream over the events file."""
    events = ev.stream_events(spark, sf_dir, "events.parquet")
    folder = flow.run_flow(spark, events, scratch_path(spark, "flow"))
    return spark.read.parquet(f"{folder}/results").drop("batch")


@query(
    "session_counts",
    """SELECT user_id AS customer_id, count(*) FILTER (prev IS NULL OR ts > prev + INTERVAL 30 MINUTES) AS sessions, count(*) AS events
FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1""",
)
def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.session_counts(table(spark, sf_dir, "events").withColumnRenamed("user_id", "customer_id"))


@query(
    "tumbling_counts",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events
FROM events GROUP BY ALL""",
)
def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tumbling_counts(table(spark, sf_dir, "events"))
