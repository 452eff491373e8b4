"""Common table expressions of the check SQL, written independently of the Spark plans."""

from __future__ import annotations

AS_OF = "TIMESTAMP '1996-02-01'"


def days(later: str, earlier: str) -> str:
    """Whole elapsed days, floored."""
    return f"CAST(floor(date_diff('microsecond', {earlier}, {later}) / 86400000000.0) AS INTEGER)"


def favourite(cte: str, key: str, value: str, source: str, weight: str = "count(*)") -> str:
    return f"""{cte} AS (
  SELECT {key} AS k, {value} AS v FROM (
    SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY {weight} DESC, {value}) AS rn
    FROM {source} GROUP BY {key}, {value}) WHERE rn = 1)"""


# name -> (names it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


cte("past", (), f"past AS (SELECT * FROM orders WHERE o_orderdate < {AS_OF})")
cte(
    "ord",
    ("past",),
    """ord AS (
  SELECT o_custkey AS k, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend,
         min(o_orderdate) AS first_at, max(o_orderdate) AS last_at
  FROM past GROUP BY 1)""",
)
cte("pay", ("past",), favourite("pay", "o_custkey", "o_orderpriority", "past"))
cte("dev", ("past",), favourite("dev", "o_custkey", "o_orderstatus", "past"))
cte(
    "bought",
    ("past",),
    """bought AS (
  SELECT o_custkey, p_brand, p_type, l_quantity, l_discount
  FROM lineitem JOIN past ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
)
cte(
    "disc",
    ("bought",),
    """disc AS (
  SELECT o_custkey AS k,
         CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS pct
  FROM bought GROUP BY 1)""",
)
cte("brand", ("bought",), favourite("brand", "o_custkey", "p_brand", "bought", "sum(l_quantity)"))
cte("kind", ("bought",), favourite("kind", "o_custkey", "p_type", "bought"))
cte(
    "visits",
    (),
    """visits AS (
  SELECT user_id, event_type, ts - INTERVAL 28 YEARS AS at_,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS kk
  FROM events)""",
)
cte(
    "sess",
    ("visits",),
    """sess AS (
  SELECT user_id AS k, count(*) FILTER (event_type = 'view') AS n, min(at_) AS first_at, max(at_) AS last_at,
         avg(CASE WHEN event_type = 'purchase' THEN kk % 5 + 1 END) AS rating,
         CASE WHEN max(at_) FILTER (event_type = 'click') IS NULL THEN 0
              WHEN max(at_) FILTER (event_type = 'purchase') IS NULL THEN 1
              WHEN max(at_) FILTER (event_type = 'click') > max(at_) FILTER (event_type = 'purchase') THEN 1
              ELSE 0 END AS cart
  FROM visits GROUP BY 1)""",
)
cte(
    "sdev",
    ("visits",),
    favourite("sdev", "user_id", "m", "(SELECT user_id, CAST(kk % 3 AS VARCHAR) AS m FROM visits)"),
)
cte(
    "ssrc",
    ("visits",),
    favourite("ssrc", "user_id", "m", "(SELECT user_id, CAST(kk % 4 AS VARCHAR) AS m FROM visits)"),
)
cte(
    "profiles",
    ("ord", "pay", "dev", "disc", "brand", "kind", "sess", "sdev", "ssrc"),
    """profiles AS (
  SELECT c_custkey AS customer_id, c_name AS name, CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
         n_name AS country, 18 + c_custkey % 60 AS age,
         CASE WHEN c_custkey % 60 <= 6 THEN '18-24' WHEN c_custkey % 60 <= 16 THEN '25-34'
              WHEN c_custkey % 60 <= 26 THEN '35-44' WHEN c_custkey % 60 <= 36 THEN '45-54' ELSE '55+' END AS age_group,
         TIMESTAMP '1994-01-01' + CAST((c_custkey * 37) % 365 AS INTEGER) * INTERVAL 1 DAY AS signup_date,
         c_custkey % 3 <> 0 AS marketing_opt_in,
         COALESCE(ord.n, 0) AS total_orders, COALESCE(ord.spend, 0.0) AS total_spend_usd,
         ord.spend / ord.n AS avg_order_value, disc.pct AS avg_discount_pct,
         ord.first_at AS first_order_date, ord.last_at AS last_order_date,
         pay.v AS preferred_payment, dev.v AS preferred_device_ord, kind.v AS preferred_source,
         brand.v AS top_category_bought, sess.rating AS avg_rating_given,
         COALESCE(sess.n, 0) AS total_sessions, sdev.v AS preferred_device_sess, ssrc.v AS preferred_source_sess,
         sess.first_at AS first_session_date, sess.last_at AS last_session_date,
         CAST(COALESCE(sess.cart, 0) AS BIGINT) AS has_abandoned_cart,
         CASE WHEN COALESCE(ord.n, 0) = 0 THEN 'no_purchase' WHEN ord.spend < 250000 THEN 'low'
              WHEN ord.spend < 450000 THEN 'medium' WHEN ord.spend < 700000 THEN 'high' ELSE 'vip' END AS clv_tier,
         CAST(COALESCE(ord.n, 0) >= 2 AS BIGINT) AS is_repeat_customer
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN ord ON ord.k = c_custkey LEFT JOIN pay ON pay.k = c_custkey LEFT JOIN dev ON dev.k = c_custkey
  LEFT JOIN disc ON disc.k = c_custkey LEFT JOIN brand ON brand.k = c_custkey LEFT JOIN kind ON kind.k = c_custkey
  LEFT JOIN sess ON sess.k = c_custkey LEFT JOIN sdev ON sdev.k = c_custkey LEFT JOIN ssrc ON ssrc.k = c_custkey)""",
)
cte(
    "ref",
    ("profiles",),
    """ref AS (
  SELECT max(d) AS ref_date FROM (
    SELECT unnest([signup_date, first_order_date, last_order_date, first_session_date, last_session_date]) AS d
    FROM profiles))""",
)
cte(
    "features",
    ("profiles", "ref"),
    f"""features AS (
  SELECT customer_id, age,
    CASE age_group WHEN '18-24' THEN 0 WHEN '25-34' THEN 1 WHEN '35-44' THEN 2 WHEN '45-54' THEN 3
                   WHEN '55+' THEN 4 ELSE -1 END AS age_group_code,
    COALESCE(country, 'MISSING') AS country, CAST(marketing_opt_in AS INTEGER) AS marketing_opt_in,
    CASE WHEN {days('ref_date', 'signup_date')} < 0 THEN 0 ELSE {days('ref_date', 'signup_date')} END AS tenure_days,
    total_sessions,
    {days('first_session_date', 'signup_date')} AS days_to_first_session,
    {days('last_session_date', 'first_session_date')} AS session_span_days,
    {days('ref_date', 'last_session_date')} AS session_recency_days,
    COALESCE(preferred_device_sess, 'MISSING') AS preferred_device_sess,
    COALESCE(preferred_source_sess, 'MISSING') AS preferred_source_sess,
    CAST(has_abandoned_cart AS INTEGER) AS has_abandoned_cart,
    CAST(total_orders >= 1 AS INTEGER) AS has_purchase,
    {days('first_order_date', 'signup_date')} AS days_to_first_order,
    {days('ref_date', 'last_order_date')} AS recency_days,
    {days('last_order_date', 'last_session_date')} AS order_session_gap_days,
    CAST(avg_rating_given IS NOT NULL AS INTEGER) AS has_rating, avg_rating_given
  FROM profiles CROSS JOIN ref)""",
)
cte(
    "labels_churn",
    ("profiles",),
    "labels_churn AS (SELECT customer_id, CAST(1 - is_repeat_customer AS INTEGER) AS churn FROM profiles)",
)
cte(
    "labels_recency",
    ("profiles", "ref"),
    f"""labels_recency AS (
  SELECT customer_id, CAST(last_order_date IS NULL OR {days('ref_date', 'last_order_date')} > 365 AS INTEGER) AS recency_churn
  FROM profiles CROSS JOIN ref)""",
)
cte(
    "training",
    ("features", "labels_churn", "labels_recency"),
    "training AS (SELECT * FROM features JOIN labels_churn USING (customer_id) JOIN labels_recency USING (customer_id))",
)
cte(
    "scores",
    ("profiles", "ref"),
    f"""scores AS (
  SELECT *, CASE WHEN churn_probability <= 0.4 THEN 'low' WHEN churn_probability <= 0.7 THEN 'medium' ELSE 'high' END AS risk_tier
  FROM (SELECT customer_id, 0.15 + 0.2 * CAST(has_abandoned_cart AS DOUBLE)
          + 0.6 * CAST(LEAST(COALESCE({days('ref_date', 'last_order_date')}, 365), 365) AS DOUBLE) / 365.0 AS churn_probability
        FROM profiles CROSS JOIN ref))""",
)
cte(
    "judged",
    ("scores", "labels_churn"),
    "judged AS (SELECT customer_id, churn AS y, churn_probability AS score FROM scores JOIN labels_churn USING (customer_id))",
)


def sql(body: str, *needs: str) -> str:
    """``body`` preceded by the expressions it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for parent in CTES[name][0]:
            visit(parent)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    ctes = [CTES[n][1] for n in order]
    body = body.strip()
    if body.startswith("WITH "):
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body
