"""Quality, constraints, scores, indicators, distributions, insights, customer view, campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.binning import labelled_ranges
from tidemark.operators import campaigns as cp
from tidemark.operators import content, quality, reports, scoring
from tidemark.operators import features as ft
from tidemark.plans.base_sql import CTES, cte, sql
from tidemark.plans.registry import query
from tidemark.sources.csv_profiles import PROFILE_COLUMNS
from tidemark.sources.profiles import profiles
from tidemark.sources.tables import table


def rnd(expr: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal text of a number."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


# ---------- quality ----------

NULLS = ", ".join(f"count(*) FILTER ({c} IS NULL) AS n_{c}" for c in PROFILE_COLUMNS)
PAIRS = ", ".join(f"{{'c': '{c}', 'n': n_{c}}}" for c in PROFILE_COLUMNS)
cte("nulls", ("profiles",), f"nulls AS (SELECT {NULLS} FROM profiles)")
cte(
    "missing",
    ("nulls",),
    f"missing AS (SELECT p.c AS c, p.n AS n FROM (SELECT unnest([{PAIRS}]) AS p FROM nulls) WHERE p.n > 0)",
)
LISTED = " || ".join(
    f"CASE WHEN n_{c} > 0 THEN ', ''{c}'': ' || n_{c} ELSE '' END" for c in PROFILE_COLUMNS
)


@query("missing_values", sql('SELECT c AS "column", n AS missing FROM missing', "missing"))
def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_values(profiles(spark, sf_dir))


@query(
    "quality_report",
    sql(
        f"""SELECT count(*) AS total_rows, count(DISTINCT customer_id) AS unique_customers,
  count(*) - count(DISTINCT customer_id) - CAST(COALESCE(bool_or(customer_id IS NULL), false) AS BIGINT) AS duplicated_customer_ids,
  count(*) FILTER (total_orders = 0) AS no_purchase_count,
  count(*) FILTER (has_abandoned_cart = 1) AS abandoned_cart_count,
  count(*) FILTER (is_repeat_customer = 1) AS repeat_customer_count,
  count(*) FILTER (signup_date IS NULL) AS invalid_dates,
  (SELECT list_filter([CASE WHEN t <> '' THEN 'Missing values: {{' || substr(t, 3) || '}}' END], lambda x: x IS NOT NULL)
   FROM (SELECT {LISTED} AS t FROM nulls)) AS issues
FROM profiles""",
        "profiles",
        "nulls",
    ),
)
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(profiles(spark, sf_dir))


@query(
    "event_quality",
    """SELECT count(*) AS total_rows, count(DISTINCT user_id) AS unique_customers,
  count(*) - count(DISTINCT user_id) AS duplicated_customer_ids, CAST(0 AS BIGINT) AS no_purchase_count,
  CAST(0 AS BIGINT) AS abandoned_cart_count, CAST(0 AS BIGINT) AS repeat_customer_count, CAST(0 AS BIGINT) AS invalid_dates,
  [(count(*) - count(DISTINCT user_id)) || ' duplicate customer_id'] AS issues FROM events""",
)
def _event_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "customer_id")
    return quality.quality_report(events)


@query(
    "duplicate_rows",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicate_rows
FROM documents""",
)
def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rows(table(spark, sf_dir, "documents").drop("doc_id"))


NOT_NULL = {
    "stg_customers": ("customer_id", "country", "total_orders", "total_spend_usd", "total_sessions"),
    "customer_features": ("customer_id", "total_spend_usd", "tenure_days"),
    "churn_labels": ("customer_id", "churn"),
}
UNIQUE = {"customer_features": ("customer_id",), "churn_labels": ("customer_id",)}
_SOURCES = {"stg_customers": "profiles", "customer_features": "marts", "churn_labels": "labels_churn"}
cte(
    "marts",
    ("profiles", "ref"),
    "marts AS (SELECT *, date_diff('day', signup_date, ref_date) AS tenure_days FROM profiles CROSS JOIN ref)",
)
_TESTS = [
    f"""SELECT '{m}' AS model, '{c}' AS "column", 'not_null' AS test, count(*) FILTER ({c} IS NULL) AS failures FROM {_SOURCES[m]}"""
    for m, cols in NOT_NULL.items()
    for c in cols
] + [
    f"""SELECT '{m}', '{c}', 'unique', (SELECT count(*) FROM (SELECT {c} FROM {_SOURCES[m]} GROUP BY 1 HAVING count(*) > 1))"""
    for m, cols in UNIQUE.items()
    for c in cols
]


@query("constraint_tests", sql(" UNION ALL ".join(_TESTS), "marts", "labels_churn"))
def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = ("customer_id", "country", "total_orders", "total_spend_usd", "total_sessions")
    staged = profiles(spark, sf_dir, columns=(*needed, *ft.DATE_COLUMNS, ft.LABEL))
    ref = ft.reference_value(staged)
    mart = staged.withColumn("tenure_days", ft.calendar_days(ref, F.col("signup_date")))
    models = {
        "stg_customers": staged,
        "customer_features": mart,
        "churn_labels": ft.mart_labels(staged),
    }
    return quality.constraint_tests(models, NOT_NULL, UNIQUE)


@query(
    "table_fingerprint",
    """SELECT count(*) AS total_rows, CAST(sum(CAST('0x' || substr(md5(COALESCE(len(CAST(o_orderkey AS VARCHAR)) || ':' || CAST(o_orderkey AS VARCHAR), '~') || COALESCE(len(CAST(o_custkey AS VARCHAR)) || ':' || CAST(o_custkey AS VARCHAR), '~') || COALESCE(len(o_orderstatus) || ':' || o_orderstatus, '~')
  || COALESCE(len(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) || ':' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '~') || COALESCE(len(CAST(epoch_us(o_orderdate) AS VARCHAR)) || ':' || CAST(epoch_us(o_orderdate) AS VARCHAR), '~') || COALESCE(len(o_orderpriority) || ':' || o_orderpriority, '~')), 1, 16) AS HUGEINT)) AS VARCHAR) AS checksum
FROM orders""",
)
def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns; money and time as text that every engine writes alike."""
    rows = table(spark, sf_dir, "orders").withColumns(
        {
            "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"),
            "o_orderdate": F.unix_micros(F.col("o_orderdate").cast("timestamp")),
        }
    )
    return quality.table_fingerprint(rows)


# ---------- scores ----------


def scores(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Rule scores over all customers, with further profile columns where asked for."""
    cols = tuple(dict.fromkeys((*scoring.RULE_INPUTS, *extra)))
    return scoring.rule_scores(profiles(spark, sf_dir, columns=cols), keep=extra)


@query("risk_tier", sql("SELECT customer_id, churn_probability, risk_tier FROM scores", "scores"))
def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir)


@query(
    "risk_tier_edges",
    """SELECT l_orderkey, l_linenumber, l_discount * 10.0 + 0.0 AS p, CASE WHEN l_discount * 10.0 > -0.01 AND l_discount * 10.0 <= 0.4 THEN 'low'
  WHEN l_discount * 10.0 > 0.4 AND l_discount * 10.0 <= 0.7 THEN 'medium' WHEN l_discount * 10.0 > 0.7 AND l_discount * 10.0 <= 1.01 THEN 'high' END AS risk_tier
FROM lineitem""",
)
def _tier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_discount") * 10.0 + 0.0
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", p.alias("p"), scoring.risk_tier(p).alias("risk_tier"))


@query(
    "score_summary",
    sql(
        """SELECT count(*) AS total_customers, round(avg(churn_probability), 4) AS avg_churn_probability,
  count(*) FILTER (risk_tier = 'low') AS low_count, count(*) FILTER (risk_tier = 'medium') AS medium_count,
  count(*) FILTER (risk_tier = 'high') AS high_count FROM scores""",
        "scores",
    ),
)
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_summary(scores(spark, sf_dir))


@query("risk_segments", sql("SELECT risk_tier, count(*) AS customers FROM scores GROUP BY 1", "scores"))
def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.risk_segments(scores(spark, sf_dir))


@query(
    "churn_distribution",
    sql("SELECT churn, count(*) AS customers FROM labels_churn GROUP BY 1", "labels_churn"),
)
def _distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ft.churn_labels(profiles(spark, sf_dir, columns=(ft.ID, ft.LABEL)))
    return labels.groupBy("churn").agg(F.count("*").alias("customers"))


# Tenure bands in days.
TENURE_BANDS = (
    (-1, 30, "0-30"),
    (30, 90, "31-90"),
    (90, 180, "91-180"),
    (180, 365, "181-365"),
    (365, 1e9, "365+"),
)
TENURE_SQL = """CASE WHEN tenure_days > -1 AND tenure_days <= 30 THEN '0-30' WHEN tenure_days > 30 AND tenure_days <= 90 THEN '31-90'
  WHEN tenure_days > 90 AND tenure_days <= 180 THEN '91-180' WHEN tenure_days > 180 AND tenure_days <= 365 THEN '181-365'
  WHEN tenure_days > 365 THEN '365+' END"""


@query(
    "tenure_bucket",
    sql(f"SELECT customer_id, tenure_days, {TENURE_SQL} AS tenure_bucket FROM features", "features"),
)
def _tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ft.customer_features(profiles(spark, sf_dir, columns=ft.FEATURE_INPUTS))
    days = F.col("tenure_days")
    return df.select("customer_id", days, labelled_ranges(days, TENURE_BANDS).alias("tenure_bucket"))


# ---------- model outputs by rule, so that reports have a table to join ----------

OUTPUT_INPUTS = (
    "customer_id",
    "total_orders",
    "total_spend_usd",
    "has_abandoned_cart",
    "avg_discount_pct",
)


def rule_outputs(buyers: DataFrame) -> DataFrame:
    """Stand-in for fitted segment, value and sensitivity outputs; buyers only."""
    n, spend = F.col("total_orders"), F.col("total_spend_usd")
    p = F.lit(0.05) + F.lit(0.9) * F.col("has_abandoned_cart").cast("double")
    capped = F.least(F.greatest(F.coalesce("avg_discount_pct", F.lit(0.0)), F.lit(0.0)), F.lit(30.0))
    return buyers.where(n > 0).select(
        "customer_id",
        F.when(n >= 6, "VIP").when(n >= 4, "Loyal").when(n >= 2, "Promising").otherwise("At Risk").alias("segment"),
        (spend * 0.8).alias("predicted_clv"),
        F.when(spend >= 600000, "High").when(spend >= 300000, "Medium").otherwise("Low").alias("predicted_clv_tier"),
        (n * 0.8).cast("double").alias("predicted_orders_12m"),
        p.alias("cart_abandon_probability"),
        ((F.lit(0.6) * p + F.lit(0.4) * (capped / 30.0)) * 100.0).alias("discount_sensitivity"),
    )


cte(
    "outputs",
    ("profiles",),
    """outputs AS (
  SELECT customer_id, CASE WHEN total_orders >= 6 THEN 'VIP' WHEN total_orders >= 4 THEN 'Loyal' WHEN total_orders >= 2 THEN 'Promising' ELSE 'At Risk' END AS segment,
    total_spend_usd * 0.8 AS predicted_clv,
    CASE WHEN total_spend_usd >= 600000 THEN 'High' WHEN total_spend_usd >= 300000 THEN 'Medium' ELSE 'Low' END AS predicted_clv_tier,
    CAST(total_orders * 0.8 AS DOUBLE) AS predicted_orders_12m,
    0.05 + 0.9 * CAST(has_abandoned_cart AS DOUBLE) AS cart_abandon_probability,
    (0.6 * (0.05 + 0.9 * CAST(has_abandoned_cart AS DOUBLE)) + 0.4 * (LEAST(GREATEST(COALESCE(avg_discount_pct, 0.0), 0.0), 30.0) / 30.0)) * 100.0 AS discount_sensitivity
  FROM profiles WHERE total_orders > 0)""",
)


# ---------- reports ----------


@query(
    "business_metrics",
    sql(
        f"""SELECT unnest([{{'category': 'sales', 'label': 'Total Orders', 'value': a, 'format': 'number'}},
  {{'category': 'sales', 'label': 'Total Spend', 'value': b, 'format': 'currency'}},
  {{'category': 'sales', 'label': 'Avg Basket Value', 'value': c, 'format': 'currency'}},
  {{'category': 'sales', 'label': 'Avg Discount Rate', 'value': d, 'format': 'percent'}},
  {{'category': 'profile', 'label': 'Repeat Purchase Rate', 'value': e, 'format': 'percent'}},
  {{'category': 'engagement', 'label': 'Avg Sessions / Customer', 'value': f, 'format': 'number'}},
  {{'category': 'engagement', 'label': 'Cart Abandonment Rate', 'value': g, 'format': 'percent'}},
  {{'category': 'experience', 'label': 'Avg Satisfaction Score', 'value': h, 'format': 'number'}}], recursive := true)
FROM (SELECT CAST(sum(total_orders) AS DOUBLE) AS a, CAST(sum(CAST(total_spend_usd AS DECIMAL(28,2))) AS DOUBLE) AS b,
  {rnd('avg(avg_order_value)', 2)} AS c, {rnd('avg(avg_discount_pct)', 1)} AS d, {rnd('avg(is_repeat_customer) * 100', 1)} AS e,
  {rnd('avg(total_sessions)', 1)} AS f, {rnd('avg(has_abandoned_cart) * 100', 1)} AS g, {rnd('avg(avg_rating_given)', 2)} AS h FROM profiles)""",
        "profiles",
    ),
)
def _business(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = (
        "total_orders",
        "total_spend_usd",
        "avg_order_value",
        "avg_discount_pct",
        "is_repeat_customer",
        "total_sessions",
        "has_abandoned_cart",
        "avg_rating_given",
    )
    return reports.business_metrics(profiles(spark, sf_dir, columns=cols))


DIMS = " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, COALESCE(CAST(p.{c} AS VARCHAR), 'Not set') AS name, s.churn_probability AS r "
    "FROM profiles p LEFT JOIN scores s USING (customer_id)"
    for c in reports.DISTRIBUTION_COLUMNS
)


@query(
    "segment_distributions",
    sql(
        f"""WITH cells AS ({DIMS}),
counted AS (SELECT dimension, name, count(*) AS n, avg(r) AS risk FROM cells GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, name) AS INTEGER) AS position,
  sum(n) OVER (PARTITION BY dimension) AS total FROM counted)
SELECT dimension, position, name, {rnd('CAST(n AS DOUBLE) / total', 4)} AS share, n AS "count", {rnd('risk', 3)} AS risk
FROM ranked WHERE position <= 6""",
        "profiles",
        "scores",
    ),
)
def _distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores(spark, sf_dir, *reports.DISTRIBUTION_COLUMNS)
    return reports.segment_distributions(scored)


MODES = {
    "segment_top": "segment",
    "clv_tier_top": "predicted_clv_tier",
    "device_sess_top": "preferred_device_sess",
    "source_sess_top": "preferred_source_sess",
    "payment_top": "preferred_payment",
    "device_ord_top": "preferred_device_ord",
    "source_ord_top": "preferred_source",
    "top_category": "top_category_bought",
}
MODE_SQL = ", ".join(
    f"COALESCE((SELECT {c} FROM j WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1), '') AS {n}"
    for n, c in MODES.items()
)


@query(
    "population_summary",
    sql(
        f"""WITH j AS (SELECT * FROM profiles LEFT JOIN outputs USING (customer_id))
SELECT count(*) AS total_customers, {rnd('avg(age)', 1)} AS age_avg, {rnd('avg(total_orders)', 1)} AS total_orders_avg,
  CAST(sum(total_orders) AS BIGINT) AS total_orders_sum, CAST(sum(CAST(total_spend_usd AS DECIMAL(28,2))) AS DOUBLE) AS total_spend_sum,
  {rnd('avg(total_spend_usd)', 2)} AS total_spend_avg, {rnd('avg(avg_order_value)', 2)} AS avg_order_value_avg,
  {rnd('avg(avg_discount_pct)', 1)} AS avg_discount_pct_avg, {rnd('avg(predicted_clv)', 2)} AS predicted_clv_avg,
  {rnd('avg(is_repeat_customer) * 100', 1)} AS repeat_rate, {rnd('avg(total_sessions)', 1)} AS total_sessions_avg,
  {rnd('avg(has_abandoned_cart) * 100', 1)} AS cart_abandon_rate, {rnd('avg(cart_abandon_probability) * 100', 1)} AS cart_abandon_prob_avg,
  {rnd('avg(avg_rating_given)', 2)} AS avg_rating_avg, {rnd('avg(discount_sensitivity)', 1)} AS discount_sensitivity_avg, {MODE_SQL}
FROM j""",
        "profiles",
        "outputs",
    ),
)
def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = profiles(spark, sf_dir)
    return reports.population_summary(reports.join_outputs(people, rule_outputs(people)))


@query(
    "insights",
    sql(
        """WITH j AS (SELECT * FROM profiles LEFT JOIN scores USING (customer_id)),
age AS (SELECT age_group, avg(churn_probability) AS p FROM j GROUP BY 1 ORDER BY 2 DESC LIMIT 1),
cat AS (SELECT top_category_bought AS c, count(*) AS n FROM j WHERE top_category_bought IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
f AS (
  SELECT 1 AS o, 'Highest-risk demographic' AS title, 'The ' || age_group || ' age group shows the highest average churn risk at ' || printf('%.1f', p * 100) || '%.' AS text FROM age
  UNION ALL SELECT 2, 'Repeat buyers churn less', 'One-time buyers carry ' || printf('%.1f', (avg(churn_probability) FILTER (is_repeat_customer = 0) - avg(churn_probability) FILTER (is_repeat_customer = 1)) * 100) || ' percentage points more churn risk than repeat buyers.' FROM j
  UNION ALL SELECT 3, 'Cart abandonment', printf('%.1f', avg(has_abandoned_cart) * 100) || '% of customers have abandoned a cart — a direct re-engagement opportunity.' FROM j
  UNION ALL SELECT 4, 'Most popular category', '''' || c || ''' is the top category, bought by ' || printf('%.1f', n * 100.0 / (SELECT count(*) FROM j)) || '% of customers.' FROM cat
  UNION ALL SELECT 5, 'Discount dependency', 'High-risk customers average ' || printf('%.1f', avg(COALESCE(avg_discount_pct, 0)) FILTER (risk_tier = 'high')) || '% discount vs ' || printf('%.1f', avg(COALESCE(avg_discount_pct, 0)) FILTER (risk_tier = 'low')) || '% for low-risk customers.' FROM j
  UNION ALL SELECT 6, 'Customer satisfaction', 'Average rating given by customers is ' || printf('%.2f', avg(avg_rating_given)) || ' / 5.' FROM j)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, title, text FROM f WHERE text IS NOT NULL ORDER BY o LIMIT 5""",
        "profiles",
        "scores",
    ),
)
def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = (
        "age_group",
        "is_repeat_customer",
        "top_category_bought",
        "has_abandoned_cart",
        "avg_discount_pct",
        "avg_rating_given",
    )
    return reports.insights(scores(spark, sf_dir, *cols))


def _r(col: str, digits: int) -> str:
    return f"{rnd(col, digits)} AS {col}"


def _d(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d') AS {col}"


cte(
    "view360",
    ("profiles", "scores", "outputs"),
    f"""view360 AS (
  SELECT customer_id, name, email, country, age, age_group, {_d('signup_date')}, marketing_opt_in, total_orders,
    {_r('total_spend_usd', 2)}, {_r('avg_order_value', 2)}, {_r('avg_discount_pct', 2)}, {_d('last_order_date')},
    preferred_payment, preferred_device_ord, preferred_source, top_category_bought, {_r('avg_rating_given', 2)},
    total_sessions, preferred_device_sess, preferred_source_sess, {_d('first_session_date')}, {_d('last_session_date')},
    has_abandoned_cart, clv_tier, is_repeat_customer, COALESCE(segment, '') AS segment, {_r('predicted_clv', 2)},
    COALESCE(predicted_clv_tier, '') AS predicted_clv_tier, {_r('predicted_orders_12m', 3)},
    {_r('cart_abandon_probability', 4)}, {_r('discount_sensitivity', 1)},
    {rnd('COALESCE(churn_probability, 0.0)', 4)} AS churn_probability, COALESCE(risk_tier, 'low') AS risk_tier
  FROM profiles LEFT JOIN scores USING (customer_id) LEFT JOIN outputs USING (customer_id))""",
)
cte(
    "customer360",
    ("view360",),
    """customer360 AS (SELECT *,
  'This customer has a ' || risk_tier || ' churn probability (' || printf('%.0f', churn_probability * 100) || '%). ' ||
    CASE risk_tier WHEN 'high' THEN 'Immediate re-engagement is recommended.' WHEN 'medium' THEN 'Monitor and consider an offer.'
                   ELSE 'Standard retention is sufficient.' END AS risk_explanation,
  'Customer ' || customer_id || '; country ' || country || '; age ' || age || ' (' || age_group || '); CLV tier ' || clv_tier ||
  '; orders ' || total_orders || '; total spend ' || format('{:,}', CAST(round_even(total_spend_usd, 0) AS BIGINT)) || '; sessions ' || total_sessions ||
  '; abandoned cart ' || has_abandoned_cart || '; repeat buyer ' || is_repeat_customer || '; churn probability ' ||
  printf('%.1f', churn_probability * 100) || '%; risk tier ' || risk_tier AS context
  FROM view360)""",
)


def customer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = profiles(spark, sf_dir)
    scored = scoring.rule_scores(people)
    return reports.customer_360(people, scored, rule_outputs(people))


@query("customer_360", sql("SELECT * FROM customer360", "customer360"))
def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_view(spark, sf_dir)


# ---------- campaigns ----------


@query(
    "coupon_campaign",
    sql(
        """SELECT customer_id, coupon_code, 'Your exclusive 15% discount coupon: ' || coupon_code ||
  ' (valid for 14 days). Use it on the items you last viewed or left in your cart.' AS content, 'email' AS channel
FROM (SELECT customer_id, 'COUPON-' || upper(substr(md5('winback::' || customer_id), 1, 8)) AS coupon_code
      FROM scores WHERE risk_tier = 'high')""",
        "scores",
    ),
)
def _coupons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.coupon_campaign(scores(spark, sf_dir), 15, 14)


@query(
    "campaign_report",
    sql(
        """WITH sent AS (SELECT customer_id, 'COUPON-' || upper(substr(md5('winback::' || customer_id), 1, 8)) AS code FROM scores WHERE risk_tier = 'high')
SELECT count(*) AS sent, CAST(15 AS DOUBLE) AS discount_pct, 14 AS validity_days,
  (SELECT list(code ORDER BY customer_id) FROM (SELECT * FROM sent ORDER BY customer_id LIMIT 5)) AS coupon_codes FROM sent""",
        "scores",
    ),
)
def _coupon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.campaign_report(cp.coupon_campaign(scores(spark, sf_dir), 15, 14), 15, 14)


@query(
    "outbox",
    sql(
        """SELECT customer_id, unnest(['email', 'push']) AS channel, 'Hello ' || customer_id || ', we saved your cart.' AS content
FROM scores WHERE risk_tier <> 'low'""",
        "scores",
    ),
)
def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    hello = F.concat(F.lit("Hello "), F.col("customer_id").cast("string"), F.lit(", we saved your cart."))
    drafts = scores(spark, sf_dir).where(F.col("risk_tier") != "low")
    # "fax" is not an enabled channel and is skipped.
    return cp.outbox(drafts.select("customer_id", hello.alias("content")), ["email", "fax", "push"])


@query(
    "cdp_identify",
    sql(
        """SELECT 'segment' AS provider, customer_id AS user_id, '{"country":"' || country || '","clv_tier":"' || clv_tier || '"}' AS traits, 'ok' AS status FROM profiles""",
        "profiles",
    ),
)
def _identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = profiles(spark, sf_dir, columns=("customer_id", "country", "clv_tier"))
    return cp.identify(people, F.to_json(F.struct("country", "clv_tier")))


# Drafts with a discount that differs per customer, so the discount rule has both outcomes.
cte(
    "cases",
    ("customer360",),
    """cases AS (
  SELECT c.customer_id, total_spend_usd, churn_probability, context, risk_explanation, COALESCE(e.n, 0) AS support_complaints,
    15 + (c.customer_id % 5) * 5 AS pct, 15 + (c.customer_id % 5) * 5 <= 30 AS guardrail_passed
  FROM customer360 c LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1) e ON e.user_id = c.customer_id)""",
)
cte(
    "routed",
    ("cases",),
    """routed AS (SELECT *, (NOT guardrail_passed) OR support_complaints > 0 OR (ltv >= 1000 AND confidence < 0.8) AS escalated,
    CASE WHEN support_complaints > 0 OR (ltv >= 1000 AND confidence < 0.5) THEN 'high' ELSE 'normal' END AS priority
  FROM (SELECT *, COALESCE(total_spend_usd, 0.0) AS ltv, CASE WHEN churn_probability IS NULL OR churn_probability = 0 THEN 0.5 ELSE churn_probability END AS confidence FROM cases))""",
)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("customer_id"))
    complaints = events.agg(F.count_if(F.col("event_type") == "error").alias("support_complaints"))
    offer = F.concat(
        F.lit("Hello, we prepared a "),
        (F.lit(15) + F.col("customer_id") % 5 * 5).cast("string"),
        F.lit("% discount just for you."),
    )
    view = customer_view(spark, sf_dir).join(complaints, "customer_id", "left")
    drafts = view.withColumn("content", offer)
    return cp.route(content.guardrails(drafts, "content"))


@query(
    "escalation_route",
    sql(
        """SELECT customer_id, ltv, confidence, escalated, priority, CASE WHEN escalated THEN 'ESCALATED' ELSE 'SENT' END AS decision FROM routed""",
        "routed",
    ),
)
def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("customer_id", "ltv", "confidence", "escalated", "priority", "decision")
    return _cases(spark, sf_dir).select(*cols)


@query(
    "crm_tasks",
    sql(
        """SELECT 'CRM-' || customer_id AS task_id, 'open' AS status, priority,
  'Customer: ' || customer_id || chr(10) || 'Priority: ' || priority || chr(10) || 'Reason: ' ||
  CASE WHEN guardrail_passed THEN 'High LTV + low confidence (human approval required)' ELSE 'discount_within_limit' END || chr(10) ||
  'Recommended action: Sales representative should call and present a personalized offer' || chr(10) || chr(10) || 'Summary:' || chr(10) ||
  'Churn risk reason: ' || risk_explanation || '. Profile: ' || context AS summary
FROM routed WHERE escalated""",
        "routed",
    ),
)
def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.crm_tasks(_cases(spark, sf_dir).withColumn("risk_reason", F.col("risk_explanation")))


__all__ = ["CTES", "customer_view", "scores"]
