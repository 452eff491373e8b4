"""Experiment design, arms, tests and report; drift between periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.binning import bin_right, labelled_ranges
from tidemark.functions.dates import days_between, ntz
from tidemark.functions.special import normal_quantile
from tidemark.operators import drift, metrics
from tidemark.operators import experiments as ex
from tidemark.operators import features as ft
from tidemark.operators.selection import inner_quantile_edges
from tidemark.plans.base_sql import cte, sql
from tidemark.plans.ranking_queries import _rounded, frac
from tidemark.plans.registry import query
from tidemark.plans.report_queries import TENURE_BANDS, TENURE_SQL, scores
from tidemark.session import settle
from tidemark.sources.profiles import profiles
from tidemark.sources.tables import table

Z = normal_quantile(1 - 0.05 / 2)
Z_POWER = normal_quantile(0.80)
LOOKS, LOOK_DAYS = 12, 30
START = "1996-02-01 00:00:00"
TREATMENT_COST = 50.0

cte(
    "arms",
    ("profiles",),
    f"arms AS (SELECT customer_id, country, CASE WHEN {frac('customer_id', '42')} < 0.5 THEN 'treatment' ELSE 'control' END AS assignment FROM profiles)",
)
# Amounts in thousands; treatment costs 50 thousand per customer.
cte(
    "outcomes",
    ("arms",),
    f"""outcomes AS (
  SELECT customer_id, country, assignment, CASE WHEN COALESCE(after_n, 0) = 0 THEN 1 ELSE 0 END AS churn,
    COALESCE(after_sum, 0) AS revenue, before_sum AS pre_revenue, CASE WHEN assignment = 'treatment' THEN {TREATMENT_COST}::DOUBLE ELSE 0.0::DOUBLE END AS discount_cost, first_look
  FROM arms LEFT JOIN (
    SELECT o_custkey, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1997-01-31') AS after_n,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1997-01-31') AS DOUBLE) / 1000.0 AS after_sum,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderdate < TIMESTAMP '1996-02-01') AS DOUBLE) / 1000.0 AS before_sum,
      min(date_diff('day', TIMESTAMP '1996-02-01', o_orderdate) // {LOOK_DAYS} + 1) FILTER (o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1997-01-31') AS first_look
    FROM orders WHERE o_orderdate >= TIMESTAMP '1995-02-01' AND o_orderdate < TIMESTAMP '1997-01-31' GROUP BY 1) ON o_custkey = customer_id)""",
)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms and outcomes per customer from one aggregate over two years of orders."""
    start = ntz(START)
    at = F.col("o_orderdate")
    window = table(spark, sf_dir, "orders").where(
        (at >= ntz("1995-02-01 00:00:00")) & (at < ntz("1997-01-31 00:00:00"))
    )
    price = F.col("o_totalprice").cast("decimal(18,2)")
    after = at >= start
    look = F.floor(days_between(at, start) / F.lit(LOOK_DAYS)).cast("int") + 1
    sums = window.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.count_if(after).alias("after_n"),
        (F.sum(F.when(after, price)).cast("double") / 1000.0).alias("after_sum"),
        (F.sum(F.when(~after, price)).cast("double") / 1000.0).alias("before_sum"),
        F.min(F.when(after, look)).alias("first_look"),
    )
    people = profiles(spark, sf_dir, columns=("customer_id", "country"))
    arms = ex.assign_groups(people)
    cost = F.when(F.col("assignment") == ex.TREATMENT, TREATMENT_COST).otherwise(0.0)
    return arms.join(sums, "customer_id", "left").select(
        "customer_id",
        "country",
        "assignment",
        (F.coalesce("after_n", F.lit(0)) == 0).cast("int").alias("churn"),
        F.coalesce("after_sum", F.lit(0.0)).alias("revenue"),
        F.col("before_sum").alias("pre_revenue"),
        cost.alias("discount_cost"),
        "first_look",
    )


@query("ab_assignment", sql("SELECT customer_id, assignment FROM arms", "arms"))
def _assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.assign_groups(profiles(spark, sf_dir, columns=("customer_id",)))


STRATA = ("spend_decile", "tenure_bucket", "country")
cte(
    "strata",
    ("features", "profiles"),
    f"""strata AS (
  SELECT customer_id, country, {TENURE_SQL} AS tenure_bucket,
    CAST((SELECT count(*) FROM (SELECT unnest(e.ed) AS x) WHERE x < spend AND x > e.lo AND x < e.hi) AS INTEGER) AS spend_decile
  FROM (SELECT f.customer_id, f.country, f.tenure_days, COALESCE(p.total_spend_usd, 0.0) AS spend FROM features f LEFT JOIN profiles p USING (customer_id)),
    (SELECT list_distinct([{', '.join(f'quantile_cont(total_spend_usd, {i}/10.0)' for i in range(1, 10))}]) AS ed, min(total_spend_usd) AS lo, max(total_spend_usd) AS hi FROM profiles) e)""",
)


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend decile, tenure band and country per customer."""
    cols = (*ft.FEATURE_INPUTS, "total_spend_usd")
    people = settle(profiles(spark, sf_dir, columns=cols), "strata")
    spend = people.select("customer_id", F.col("total_spend_usd").alias("spend"))
    features = ft.customer_features(people).select("customer_id", "country", "tenure_days")
    joined = features.join(spend, "customer_id", "left").withColumn(
        "spend", F.coalesce("spend", F.lit(0.0))
    )
    edges = inner_quantile_edges(people, {"s": F.col("total_spend_usd")}, 10)["s"]
    return joined.select(
        "customer_id",
        "country",
        labelled_ranges(F.col("tenure_days"), TENURE_BANDS).alias("tenure_bucket"),
        bin_right(F.col("spend"), edges).alias("spend_decile"),
    )


@query("experiment_strata", sql("SELECT * FROM strata", "strata"))
def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata(spark, sf_dir)


@query(
    "strata_balance",
    sql(
        """SELECT spend_decile, tenure_bucket, strata.country AS country, count(*) AS n, round(avg(CAST(assignment = 'treatment' AS INTEGER)), 6) AS treatment_ratio
FROM strata JOIN arms USING (customer_id) GROUP BY 1, 2, 3""",
        "strata",
        "arms",
    ),
)
def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.strata_balance(ex.assign_groups(strata(spark, sf_dir)), STRATA)


@query(
    "srm_check",
    sql(
        f"""SELECT a AS n_control, b AS n_treatment, round((a - (a + b) * 0.5) ** 2 / ((a + b) * 0.5) + (b - (a + b) * 0.5) ** 2 / ((a + b) * 0.5), 9) AS chi_square,
  (a - (a + b) * 0.5) ** 2 / ((a + b) * 0.5) + (b - (a + b) * 0.5) ** 2 / ((a + b) * 0.5) > {Z * Z!r} AS mismatch
FROM (SELECT CAST(count(*) FILTER (assignment = 'control') AS BIGINT) AS a, count(*) FILTER (assignment = 'treatment') AS b FROM arms)""",
        "arms",
    ),
)
def _srm(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = ex.assign_groups(profiles(spark, sf_dir, columns=("customer_id",)))
    return _rounded(ex.srm_check(arms), 9, "chi_square")


@query(
    "sample_size_inputs",
    sql("SELECT count(*) AS customers, round(avg(churn), 9) AS baseline_rate FROM labels_churn", "labels_churn"),
)
def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ft.churn_labels(profiles(spark, sf_dir, columns=(ft.ID, ft.LABEL)))
    return labels.agg(F.count("*").alias("customers"), F.round(F.avg("churn"), 9).alias("baseline_rate"))


@query(
    "sample_size_by_stratum",
    sql(
        f"""WITH g AS (SELECT country, avg(churn) AS r FROM profiles JOIN labels_churn USING (customer_id) GROUP BY 1),
m AS (SELECT country, r, unnest([0.1, 0.15, 0.2]::DOUBLE[]) AS d FROM g),
t AS (SELECT *, r * (1.0::DOUBLE - d) AS q FROM m)
SELECT country, r AS baseline_rate, d AS mde_relative, n AS n_per_group, 2 * n AS total_required FROM (
  SELECT *, CASE WHEN r > 0 AND r < 1 THEN CAST(floor({(Z + Z_POWER) * (Z + Z_POWER)!r}::DOUBLE * (r * (1.0::DOUBLE - r) + q * (1.0::DOUBLE - q)) / ((r - q) * (r - q)) * 1.2::DOUBLE) AS BIGINT) + 1 END AS n FROM t)""",
        "profiles",
        "labels_churn",
    ),
)
def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = profiles(spark, sf_dir, columns=("customer_id", "country", ft.LABEL))
    labelled = people.withColumn("churn", (1 - F.col(ft.LABEL)).cast("int"))
    return ex.sample_size_by_stratum(labelled, ["country"], "churn", (0.1, 0.15, 0.2))


@query(
    "arm_stats",
    sql(
        "SELECT assignment, count(revenue) AS n, round(sum(revenue), 6) AS total, round(avg(revenue), 10) AS mean, round(var_samp(revenue), 3) AS variance FROM outcomes GROUP BY 1",
        "outcomes",
    ),
)
def _arm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ex.arm_stats(outcomes(spark, sf_dir), "revenue")
    return _rounded(_rounded(_rounded(stats, 3, "variance"), 6, "total"), 10, "mean")


cte(
    "ztest",
    ("outcomes",),
    f"""ztest AS (
  SELECT *, p1 - p2 AS d, sqrt(pp * (1 - pp) * (1 / n1 + 1 / n2)) AS se, {Z!r}::DOUBLE * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS margin FROM (
    SELECT x1 / n1 AS p1, x2 / n2 AS p2, (x1 + x2) / (n1 + n2) AS pp, * FROM (
      SELECT CAST(count(*) FILTER (assignment = 'control') AS DOUBLE) AS n1, CAST(count(*) FILTER (assignment = 'treatment') AS DOUBLE) AS n2,
        CAST(sum(churn) FILTER (assignment = 'control') AS DOUBLE) AS x1, CAST(sum(churn) FILTER (assignment = 'treatment') AS DOUBLE) AS x2 FROM outcomes)))""",
)
ZCOLS = f"""round(p1, 9) AS p1, round(p2, 9) AS p2, round((p2 - p1) / p1, 9) AS lift, round(d / se, 9) AS z_stat,
  round(p2 - p1 - margin, 9) AS ci_low, round(p2 - p1 + margin, 9) AS ci_high, abs(d / se) > {Z!r} AS significant"""
Z_NAMES = ("p1", "p2", "lift", "z_stat", "ci_low", "ci_high")


@query("ab_churn_ztest", sql(f"SELECT {ZCOLS} FROM ztest", "ztest"))
def _ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ex.proportions_z_test(outcomes(spark, sf_dir)), 9, *Z_NAMES)


def welch_sql(source: str, value: str) -> str:
    return f"""(SELECT m2 - m1 AS mean_diff, (m2 - m1) / sqrt(a + b) AS t_stat, (a + b) ** 2 / (a ** 2 / (n1 - 1) + b ** 2 / (n2 - 1)) AS df FROM (
  SELECT *, v1 / n1 AS a, v2 / n2 AS b FROM (SELECT count({value}) FILTER (assignment = 'control') AS n1, count({value}) FILTER (assignment = 'treatment') AS n2,
    avg({value}) FILTER (assignment = 'control') AS m1, avg({value}) FILTER (assignment = 'treatment') AS m2,
    var_samp({value}) FILTER (assignment = 'control') AS v1, var_samp({value}) FILTER (assignment = 'treatment') AS v2 FROM {source})))"""


@query(
    "ab_welch",
    sql(
        f"SELECT round(mean_diff, 10) AS mean_diff, round(t_stat, 9) AS t_stat, round(df, 4) AS df FROM {welch_sql('outcomes', 'revenue')}",
        "outcomes",
    ),
)
def _welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = ex.welch(ex.two_arms(outcomes(spark, sf_dir), "revenue"))
    rounded = _rounded(test.select("mean_diff", "t_stat", "df"), 10, "mean_diff")
    return _rounded(_rounded(rounded, 9, "t_stat"), 4, "df")


def student_p_sql(t: str, df: str) -> str:
    """Two-sided p by Simpson's rule over the density from 0 to ``t``, 4,000 steps."""
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
    return f"""(1 - 2 * {density} * abs({t}) / 12000 * list_sum([CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * pow(1 + pow({t} * i / 4000.0::DOUBLE, 2) / {df}, -({df} + 1) / 2) FOR i IN range(4001)]))"""


NORMAL_P = """(1 - 2 / sqrt(2 * pi()) * abs(z) / 12000 * list_sum([CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(-pow(z * i / 4000.0::DOUBLE, 2) / 2) FOR i IN range(4001)]))"""
_NEWTON = f"x + ({student_p_sql('x', 'df')} - 0.05) / (2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + x * x / df, -(df + 1) / 2))"
# The quantile by six of Newton's steps on the p-value.
_QUANTILE = ",\n".join(["q0 AS (SELECT 1.959963984540054::DOUBLE AS x, df FROM w)", *[f"q{k + 1} AS (SELECT {_NEWTON} AS x, df FROM q{k})" for k in range(6)]])
WELCH_P = f"""WITH w AS (SELECT mean_diff, t_stat, df, mean_diff / t_stat AS se FROM {welch_sql('outcomes', 'revenue')}),
{_QUANTILE}
SELECT round(mean_diff, 10) AS mean_diff, round(t_stat, 9) AS t_stat, round(w.df, 4) AS df, round(p, 8) AS p_value,
  round(mean_diff - x * se, 7) AS ci_low, round(mean_diff + x * se, 7) AS ci_high, p < 0.05 AS significant
FROM (SELECT *, {student_p_sql('t_stat', 'df')} AS p FROM w) w, q6"""


@query("ab_welch_p_value", sql(WELCH_P, "outcomes"))
def _welch_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = _rounded(ex.welch_test(outcomes(spark, sf_dir), "revenue"), 7, "ci_low", "ci_high")
    return _rounded(_rounded(_rounded(_rounded(tested, 8, "p_value"), 10, "mean_diff"), 9, "t_stat"), 4, "df")


cte(
    "cuped",
    ("outcomes",),
    """cuped AS (
  SELECT *, CASE WHEN pre_revenue IS NOT NULL THEN net - theta * (pre_revenue - xm) END AS adjusted FROM
    (SELECT *, revenue - discount_cost AS net FROM outcomes),
    (SELECT COALESCE(regr_slope(revenue - discount_cost, pre_revenue), 0) AS theta, avg(pre_revenue) AS xm FROM outcomes WHERE pre_revenue IS NOT NULL))""",
)


def net_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).withColumn("net", F.col("revenue") - F.col("discount_cost"))


@query(
    "cuped_theta",
    sql(
        "SELECT round(max(theta), 8) AS theta, round(max(xm), 6) AS x_mean, count(*) AS n FROM cuped WHERE pre_revenue IS NOT NULL",
        "cuped",
    ),
)
def _theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ex.cuped_stats(net_outcomes(spark, sf_dir), "net", "pre_revenue")
    return _rounded(_rounded(stats, 8, "theta"), 6, "x_mean")


@query("cuped_adjusted", sql("SELECT customer_id, assignment, round(adjusted, 6) AS adjusted FROM cuped", "cuped"))
def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted = ex.apply_cuped(net_outcomes(spark, sf_dir), "net", "pre_revenue")
    return _rounded(adjusted, 6, "adjusted").select("customer_id", "assignment", "adjusted")


@query(
    "variance_reduction",
    sql(
        "SELECT round(LEAST(GREATEST(1 - var_samp(adjusted) / var_samp(net), 0), 1), 9) AS variance_reduction FROM cuped WHERE pre_revenue IS NOT NULL",
        "cuped",
    ),
)
def _reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ex.variance_reduction(net_outcomes(spark, sf_dir), "net", "pre_revenue")
    return _rounded(result, 9, "variance_reduction")


@query(
    "sequential_looks",
    sql(
        f"""WITH k AS (SELECT unnest(range(1, {LOOKS + 1})) AS k),
c AS (SELECT k, CAST(count(*) FILTER (assignment = 'control') AS DOUBLE) AS n1, CAST(count(*) FILTER (assignment = 'treatment') AS DOUBLE) AS n2,
  count(*) FILTER (assignment = 'control' AND (first_look IS NULL OR first_look > k)) / CAST(count(*) FILTER (assignment = 'control') AS DOUBLE) AS p1,
  count(*) FILTER (assignment = 'treatment' AND (first_look IS NULL OR first_look > k)) / CAST(count(*) FILTER (assignment = 'treatment') AS DOUBLE) AS p2
  FROM outcomes, k GROUP BY k),
z AS (SELECT *, {Z!r}::DOUBLE / sqrt(k / {LOOKS}.0::DOUBLE) AS b, (p1 * n1 + p2 * n2) / (n1 + n2) AS pp FROM c)
SELECT CAST(k AS INTEGER) AS look, round(k / {LOOKS}.0::DOUBLE, 9) AS information_fraction, round(b, 9) AS boundary, round(p1, 9) AS p1, round(p2, 9) AS p2,
  round((p1 - p2) / sqrt(pp * (1 - pp) * (1 / n1 + 1 / n2)), 9) AS z_stat, abs((p1 - p2) / sqrt(pp * (1 - pp) * (1 / n1 + 1 / n2))) > b AS crossed FROM z""",
        "outcomes",
    ),
)
def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = ex.sequential_looks(outcomes(spark, sf_dir), "first_look", LOOKS)
    return _rounded(looks, 9, "information_fraction", "boundary", "p1", "p2", "z_stat")


@query(
    "ab_report",
    sql(
        f"""SELECT CAST(n1 AS BIGINT) AS n_control, CAST(n2 AS BIGINT) AS n_treatment, {ZCOLS},
  round(w.mean_diff, 6) AS net_mean_diff, round(w.t_stat, 6) AS net_t_stat, round(w.df, 4) AS net_df, round((r.b - r.a) / r.a, 8) AS net_lift,
  CASE WHEN abs(d / se) > {Z!r} AND p2 < p1 THEN CASE WHEN w.mean_diff < 0 THEN 'OPTIMIZE' ELSE 'LAUNCH' END ELSE 'HOLD' END AS decision
FROM ztest, {welch_sql('(SELECT assignment, COALESCE(adjusted, net) AS v FROM cuped)', 'v')} w,
  (SELECT avg(net) FILTER (assignment = 'control') AS a, avg(net) FILTER (assignment = 'treatment') AS b FROM cuped) r""",
        "ztest",
        "cuped",
    ),
)
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ex.analyze_experiment(outcomes(spark, sf_dir))
    rounded = _rounded(report, 9, *Z_NAMES)
    return _rounded(_rounded(_rounded(rounded, 6, "net_mean_diff", "net_t_stat"), 4, "net_df"), 8, "net_lift")


@query(
    "ab_report_p_values",
    sql(
        f"""SELECT decision, round(z, 9) AS z_stat, round(t, 6) AS net_t_stat, round({NORMAL_P}, 8) AS p_value, round({student_p_sql('t', 'df')}, 8) AS net_p_value FROM (
  SELECT d / se AS z, w.t_stat AS t, w.df AS df, CASE WHEN abs(d / se) > {Z!r} AND p2 < p1 THEN CASE WHEN w.mean_diff < 0 THEN 'OPTIMIZE' ELSE 'LAUNCH' END ELSE 'HOLD' END AS decision
  FROM ztest, {welch_sql('(SELECT assignment, COALESCE(adjusted, net) AS v FROM cuped)', 'v')} w)""",
        "ztest",
        "cuped",
    ),
)
def _report_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = ex.with_p_values(ex.analyze_experiment(outcomes(spark, sf_dir))).select("decision", "z_stat", "net_t_stat", "p_value", "net_p_value")
    return _rounded(_rounded(_rounded(tested, 9, "z_stat"), 6, "net_t_stat"), 8, "p_value", "net_p_value")


# ---------- drift ----------


def numeric_psi_sql(ref: str, cur: str, column: str) -> str:
    """PSI of one number column over decile bins of the reference."""
    qs = ", ".join(f"quantile_cont({column}, {i}/10.0)" for i in range(1, 10))
    return f"""(WITH e AS (SELECT list_sort(list_distinct([{qs}])) AS ed, min({column}) AS lo, max({column}) AS hi FROM {ref}),
  b AS (SELECT side, len(list_filter(e.ed, lambda x: x <= v AND x > e.lo AND x < e.hi)) AS bin FROM (
    SELECT 0 AS side, {column} AS v FROM {ref} UNION ALL SELECT 1, {column} FROM {cur}) t, e WHERE v IS NOT NULL),
  n AS (SELECT bin, count(*) FILTER (side = 0) AS e, count(*) FILTER (side = 1) AS a FROM b GROUP BY 1),
  f AS (SELECT GREATEST(CAST(e AS DOUBLE) / (SELECT sum(e) FROM n), 1e-6) AS e, GREATEST(CAST(a AS DOUBLE) / (SELECT sum(a) FROM n), 1e-6) AS a FROM n)
  SELECT sum((a - e) * ln(a / e)) FROM f)"""


def category_psi_sql(ref: str, cur: str, column: str) -> str:
    return f"""(WITH n AS (SELECT COALESCE(CAST(v AS VARCHAR), 'nan') AS v, count(*) FILTER (side = 0) AS e, count(*) FILTER (side = 1) AS a FROM (
    SELECT 0 AS side, {column} AS v FROM {ref} UNION ALL SELECT 1, {column} FROM {cur}) GROUP BY 1),
  f AS (SELECT GREATEST(CAST(e AS DOUBLE) / (SELECT sum(e) FROM n), 1e-6) AS e, GREATEST(CAST(a AS DOUBLE) / (SELECT sum(a) FROM n), 1e-6) AS a FROM n)
  SELECT sum((a - e) * ln(a / e)) FROM f)"""


ORDERS_REF = "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')"
ORDERS_CUR = "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"
LINES_REF = "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')"
LINES_CUR = "(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"
ORDER_NUMBERS = ("o_totalprice", "o_orderkey", "o_custkey")
ORDER_TEXTS = ("o_orderstatus", "o_orderpriority", "o_orderdate")
LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_TEXTS = ("l_returnflag", "l_linestatus", "l_shipdate")


def _psi_rows(numbers, texts, ref: str, cur: str) -> str:
    parts = [f"""SELECT '{c}' AS "column", round({numeric_psi_sql(ref, cur, c)}, 8) AS psi""" for c in numbers]
    parts += [f"""SELECT '{c}' AS "column", round({category_psi_sql(ref, cur, c)}, 8) AS psi""" for c in texts]
    return " UNION ALL ".join(parts)


def _halves(df: DataFrame, time: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows before 1998 and from 1998 on."""
    cut = ntz("1998-01-01 00:00:00")
    return df.where(F.col(time) < cut).select(*columns), df.where(F.col(time) >= cut).select(*columns)


def _order_psi(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    psi = drift.psi_scores(*_halves(table(spark, sf_dir, "orders"), "o_orderdate", *columns))
    return _rounded(psi, 8, "psi")


@query("psi_numeric", _psi_rows(ORDER_NUMBERS, (), ORDERS_REF, ORDERS_CUR))
def _psi_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_psi(spark, sf_dir, *ORDER_NUMBERS)


@query("psi_categorical", _psi_rows((), ORDER_TEXTS, ORDERS_REF, ORDERS_CUR))
def _psi_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_psi(spark, sf_dir, *ORDER_TEXTS)


DATA_DRIFT = f"""WITH psi AS ({_psi_rows(LINE_NUMBERS, LINE_TEXTS, LINES_REF, LINES_CUR)})
SELECT COALESCE(list("column" ORDER BY "column") FILTER (psi > 0.2), []) AS drifted_features, max(psi) AS max_psi, count(*) FILTER (psi > 0.2) > 0 AS drift_detected FROM psi"""


def _line_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = _halves(table(spark, sf_dir, "lineitem"), "l_shipdate", *LINE_NUMBERS, *LINE_TEXTS)
    return drift.detect_data_drift(*halves)


@query("data_drift", DATA_DRIFT)
def _data_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_line_drift(spark, sf_dir), 8, "max_psi")


cte(
    "score_sides",
    ("scores", "profiles"),
    "score_sides AS (SELECT churn_probability AS prediction, total_sessions > 0 AS active FROM scores JOIN profiles USING (customer_id))",
)


def _prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = settle(scores(spark, sf_dir, "total_sessions"), "scores")
    active = F.col("total_sessions") > 0
    return drift.detect_prediction_drift(scored.where(~active), scored.where(active))


PREDICTION_SQL = numeric_psi_sql(
    "(SELECT * FROM score_sides WHERE NOT active)", "(SELECT * FROM score_sides WHERE active)", "prediction"
)


@query(
    "prediction_drift",
    sql(
        f"""SELECT CASE WHEN p > 0.2 THEN ['prediction'] ELSE [] END AS drifted_features, round(p, 8) AS max_psi, p > 0.2 AS drift_detected FROM (SELECT {PREDICTION_SQL} AS p)""",
        "score_sides",
    ),
)
def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_prediction_drift(spark, sf_dir), 8, "max_psi")


cte(
    "opt_auc",
    ("judged", "profiles"),
    """opt_auc AS (SELECT o, CAST(sum(neg * (2 * (tp - pos) + pos)) AS DOUBLE) / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM (
  SELECT o, pos, neg, sum(pos) OVER (PARTITION BY o ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp FROM (
    SELECT marketing_opt_in AS o, score AS s, sum(y) AS pos, sum(1 - y) AS neg FROM judged JOIN profiles USING (customer_id) GROUP BY 1, 2)) GROUP BY 1)""",
)


def _concept_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the rule score without and with marketing opt-in, as reference and current."""
    scored = settle(scores(spark, sf_dir, "marketing_opt_in", ft.LABEL), "scores")
    rated = scored.select(
        "marketing_opt_in", (1 - F.col(ft.LABEL)).alias("y"), F.col("churn_probability").alias("score")
    )
    auc = metrics.ranking_metrics(rated, by=("marketing_opt_in",))
    opted = F.col("marketing_opt_in")
    return drift.concept_drift(
        auc.agg(
            F.max(F.when(~opted, F.col("roc_auc"))).alias("reference_metric"),
            F.max(F.when(opted, F.col("roc_auc"))).alias("current_metric"),
        )
    )


CONCEPT = "(SELECT max(auc) FILTER (NOT o) AS a, max(auc) FILTER (o) AS b FROM opt_auc)"


@query(
    "concept_drift",
    sql(
        f'SELECT round(a, 9) AS reference_metric, round(b, 9) AS current_metric, round(a - b, 9) AS "drop", a - b > 0.1 AS drift_detected FROM {CONCEPT}',
        "opt_auc",
    ),
)
def _concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_concept_drift(spark, sf_dir), 9, "reference_metric", "current_metric", "drop")


@query(
    "retrain_signal",
    sql(
        f"""SELECT (SELECT drift_detected FROM ({DATA_DRIFT})) OR (SELECT {PREDICTION_SQL} > 0.2) OR (SELECT a - b > 0.1 FROM {CONCEPT}) AS should_retrain""",
        "score_sides",
        "opt_auc",
    ),
)
def _retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.retrain_signal(
        _line_drift(spark, sf_dir), _prediction_drift(spark, sf_dir), _concept_drift(spark, sf_dir)
    )



