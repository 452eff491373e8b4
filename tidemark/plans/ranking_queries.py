"""Quantiles, RFM, splits, score evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ensemble, metrics, rfm, scoring, splits
from tidemark.operators import features as ft
from tidemark.operators.selection import exact_quantiles
from tidemark.plans.base_sql import cte, days, sql
from tidemark.plans.registry import query
from tidemark.session import settle
from tidemark.sources.profiles import profiles
from tidemark.sources.tables import table


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn label and rule score per customer, written once for the passes over it."""
    people = profiles(spark, sf_dir, columns=(*scoring.RULE_INPUTS, ft.LABEL))
    scored = scoring.rule_scores(people, keep=(ft.LABEL,))
    return settle(
        scored.select(
            "customer_id",
            (1 - F.col(ft.LABEL)).cast("int").alias("y"),
            F.col("churn_probability").alias("score"),
        ),
        "judged",
    )


@query(
    "quantile_edges",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST({q} AS DOUBLE) AS q, round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS value FROM orders"
        for c in ("o_totalprice", "o_orderkey")
        for q in (0.1, 0.25, 0.33, 0.5, 0.66, 0.75, 0.9)
    ),
)
def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    probs = [0.1, 0.25, 0.33, 0.5, 0.66, 0.75, 0.9]
    cols = {c: F.col(c) for c in ("o_totalprice", "o_orderkey")}
    found = exact_quantiles(orders, cols, probs)
    rows = [(c, q, v) for c in cols for q, v in zip(probs, found[c], strict=True)]
    edges = spark.createDataFrame(rows, "name string, q double, value double")
    return edges.withColumn("value", F.round("value", 6))


# ---------- RFM ----------

cte(
    "rfm_base",
    ("profiles",),
    f"""rfm_base AS (
  SELECT *, COALESCE(rec, max(rec) OVER ()) AS recency FROM (
    SELECT customer_id, total_orders, total_spend_usd, last_order_date,
      CAST({days('now_', 'last_order_date')} AS DOUBLE) AS rec
    FROM profiles, (SELECT max(last_order_date) + INTERVAL 1 DAY AS now_ FROM profiles)))""",
)
RFM_INPUTS = ("customer_id", "total_orders", "total_spend_usd", "last_order_date")


@query(
    "rfm_scores",
    sql(
        """WITH r AS (SELECT *, row_number() OVER (ORDER BY total_orders, customer_id) AS fr, row_number() OVER (ORDER BY total_spend_usd, customer_id) AS mr FROM rfm_base),
e AS (SELECT list_distinct([quantile_cont(recency, 0.25), quantile_cont(recency, 0.5), quantile_cont(recency, 0.75)]) AS ed, min(recency) AS lo, max(recency) AS hi,
  count(*) AS n FROM rfm_base)
SELECT customer_id, CAST(4 - len(list_filter(ed, lambda x: x < recency AND x > lo AND x < hi)) AS INTEGER) AS rfm_recency_score,
  CAST(1 + (fr > 1 + (n - 1) * 0.25)::INT + (fr > 1 + (n - 1) * 0.5)::INT + (fr > 1 + (n - 1) * 0.75)::INT AS INTEGER) AS rfm_frequency_score,
  CAST(1 + (mr > 1 + (n - 1) * 0.25)::INT + (mr > 1 + (n - 1) * 0.5)::INT + (mr > 1 + (n - 1) * 0.75)::INT AS INTEGER) AS rfm_monetary_score
FROM r, e""",
        "rfm_base",
    ),
)
def _rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.rfm_scores(settle(profiles(spark, sf_dir, columns=RFM_INPUTS), "rfm"))


@query(
    "rfm_matrix",
    sql(
        """WITH m AS (SELECT customer_id, ln(1 + rec) AS r, CAST(total_orders AS DOUBLE) AS f, ln(1 + GREATEST(total_spend_usd, 1.0)) AS m FROM rfm_base WHERE total_orders > 0)
SELECT customer_id, round((r - (SELECT avg(r) FROM m)) / (SELECT stddev_pop(r) FROM m), 8) AS recency,
  round((f - (SELECT avg(f) FROM m)) / (SELECT stddev_pop(f) FROM m), 8) AS frequency,
  round((m - (SELECT avg(m) FROM m)) / (SELECT stddev_pop(m) FROM m), 8) AS monetary FROM m""",
        "rfm_base",
    ),
)
def _rfm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = rfm.rfm_matrix(profiles(spark, sf_dir, columns=RFM_INPUTS))
    names = ("recency", "frequency", "monetary")
    return matrix.withColumns({c: F.round(c, 8) for c in names})


# ---------- splits ----------


def frac(key: str, seed: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5({key} || '::{seed}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"


@query(
    "stratified_split",
    sql(
        f"SELECT customer_id, churn, CASE WHEN {frac('churn || chr(58) || customer_id', '42')} * 100 < 20 THEN 'test' ELSE 'train' END AS part FROM labels_churn",
        "labels_churn",
    ),
)
def _stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ft.churn_labels(profiles(spark, sf_dir, columns=(ft.ID, ft.LABEL)))
    return splits.stratified_split(labels, "churn", "customer_id")


@query(
    "fold_assignment",
    sql(
        f"SELECT customer_id, churn, CAST(floor({frac('churn || chr(58) || customer_id', 'fold42')} * 5) AS INTEGER) AS fold FROM labels_churn",
        "labels_churn",
    ),
)
def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ft.churn_labels(profiles(spark, sf_dir, columns=(ft.ID, ft.LABEL)))
    return splits.fold_assignment(labels, "churn", "customer_id")


@query(
    "chrono_split",
    """SELECT o_orderkey, CASE WHEN rn >= CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) THEN 'test'
  WHEN rn >= CAST(floor(n * CAST(0.70 AS DOUBLE)) AS BIGINT) THEN 'valid' ELSE 'train' END AS part
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)""",
)
def _chrono(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return splits.chronological_split(orders, "o_orderdate", "o_orderkey").select("o_orderkey", "part")


@query(
    "walk_forward_folds",
    """SELECT o_orderkey, CAST(CASE WHEN rn < n - 5 * s THEN -1 ELSE (rn - (n - 5 * s)) // s END AS INTEGER) AS test_fold
FROM (SELECT *, n // 6 AS s FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders))""",
)
def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    folds = splits.walk_forward_folds(orders, "o_orderdate", "o_orderkey")
    return folds.select("o_orderkey", "test_fold")


# ---------- score evaluation ----------

cte(
    "points",
    ("judged",),
    """points AS (
  SELECT threshold, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n
  FROM (SELECT score AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM judged GROUP BY 1)
  WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))""",
)
AUC = "CAST(sum(neg * (2 * (tp - pos) + pos)) AS DOUBLE) / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))"
AP = "sum(pos * (tp / (tp + fp))) / CAST(sum(pos) AS DOUBLE)"


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("roc_auc", sql(f"SELECT round({AUC}, 9) AS roc_auc FROM points", "points"))
def _auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ranking_metrics(judged(spark, sf_dir)), 9, "roc_auc").select("roc_auc")


@query("average_precision", sql(f"SELECT round({AP}, 9) AS pr_auc FROM points", "points"))
def _ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ranking_metrics(judged(spark, sf_dir)), 9, "pr_auc").select("pr_auc")


@query(
    "binary_metrics",
    sql(
        f"""WITH c AS (SELECT count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn FROM judged)
SELECT round({AUC}, 9) AS roc_auc, round({AP}, 9) AS pr_auc, CAST(sum(pos + neg) AS BIGINT) AS n, round(CAST(sum(pos) AS DOUBLE) / sum(pos + neg), 9) AS pos_rate,
  (SELECT round(tp / (tp + fp), 9) FROM c) AS precision, (SELECT round(tp / (tp + fn), 9) FROM c) AS recall, (SELECT round(2 * tp / (2 * tp + fp + fn), 9) FROM c) AS f1
FROM points""",
        "points",
    ),
)
def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = metrics.binary_metrics(judged(spark, sf_dir))
    return _rounded(result, 9, "roc_auc", "pr_auc", "pos_rate", "precision", "recall", "f1")


@query(
    "document_quality_auc",
    f"""WITH d AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id)),
points AS (SELECT threshold, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp
  FROM (SELECT score AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY 1) WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT round({AUC}, 9) AS roc_auc, round({AP}, 9) AS pr_auc, CAST(sum(pos + neg) AS BIGINT) AS n, round(CAST(sum(pos) AS DOUBLE) / sum(pos + neg), 9) AS pos_rate FROM points""",
)
def _document_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    rated = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").alias("y"), "score")
    return _rounded(metrics.ranking_metrics(rated), 9, "roc_auc", "pr_auc", "pos_rate")


@query(
    "pr_curve",
    sql("SELECT threshold, tp / (tp + fp) AS precision, tp / p AS recall, tp, fp FROM points", "points"),
)
def _pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_curve(judged(spark, sf_dir))


PROFIT = "tp * 500.0::DOUBLE - fp * 50.0::DOUBLE - (p - tp) * 500.0::DOUBLE"


@query(
    "profit_curve",
    sql(f"SELECT threshold, {PROFIT} AS profit, tp / (tp + fp) AS precision, tp / p AS recall FROM points", "points"),
)
def _profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.profit_curve(judged(spark, sf_dir), 500.0, 50.0)


@query(
    "profit_threshold",
    sql(f"SELECT threshold, {PROFIT} AS profit FROM points ORDER BY profit DESC, threshold LIMIT 1", "points"),
)
def _profit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.optimal_threshold(judged(spark, sf_dir), 500.0, 50.0)


@query(
    "f1_threshold",
    sql(
        "SELECT threshold, round(2 * (pr * re) / (pr + re + 1e-12), 9) AS f1 FROM (SELECT threshold, tp / (tp + fp) AS pr, tp / p AS re FROM points WHERE tp > 0) ORDER BY 2 * (pr * re) / (pr + re + 1e-12) DESC, threshold LIMIT 1",
        "points",
    ),
)
def _f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.f1_threshold(judged(spark, sf_dir)), 9, "f1")


@query(
    "youden_threshold",
    sql(
        "SELECT threshold, round((tp * n - fp * p) / (p * n), 9) AS youden FROM points ORDER BY tp * n - fp * p DESC, threshold DESC LIMIT 1",
        "points",
    ),
)
def _youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.youden_threshold(judged(spark, sf_dir)), 9, "youden")


cte(
    "decile",
    ("judged",),
    """decile AS (SELECT *, row_number() OVER (ORDER BY score DESC, customer_id) <= GREATEST(1, CAST(floor(count(*) OVER () * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS top FROM judged)""",
)


@query(
    "lift_top_decile",
    sql("SELECT count(*) FILTER (top) AS k, round(avg(y) FILTER (top) / avg(y), 9) AS lift_top_decile FROM decile", "decile"),
)
def _lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = metrics.top_decile(judged(spark, sf_dir))
    return _rounded(result, 9, "lift_top_decile").select("k", "lift_top_decile")


@query(
    "recall_top_decile",
    sql("SELECT round(CAST(sum(y) FILTER (top) AS DOUBLE) / sum(y), 9) AS recall_top_decile FROM decile", "decile"),
)
def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = metrics.top_decile(judged(spark, sf_dir))
    return _rounded(result, 9, "recall_top_decile").select("recall_top_decile")


@query("brier_score", sql("SELECT round(avg(pow(score - y, 2)), 9) AS brier_score FROM judged", "judged"))
def _brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.brier_score(judged(spark, sf_dir)), 9, "brier_score")


@query(
    "naive_baseline",
    sql("SELECT round(avg(y), 9) AS precision, CAST(1.0 AS DOUBLE) AS recall, round(2 * avg(y) / (avg(y) + 1), 9) AS f1 FROM judged", "judged"),
)
def _naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.naive_baseline(judged(spark, sf_dir)), 9, "precision", "f1")


# Three rule scores stand for base models; folds are hash folds within the class.
cte(
    "votes",
    ("scores", "labels_churn", "rfm_base"),
    f"""votes AS (
  SELECT customer_id, churn AS y, churn_probability AS m1, 1.0 / (1.0 + CAST(total_orders AS DOUBLE)) AS m2,
    recency / 800.0 AS m3, CAST(floor({frac('churn || chr(58) || customer_id', 'fold42')} * 5) AS INTEGER) AS fold
  FROM scores JOIN labels_churn USING (customer_id) JOIN rfm_base USING (customer_id))""",
)
WEIGHTS = (0.5, 0.3, 0.4)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = tuple(dict.fromkeys((*scoring.RULE_INPUTS, *RFM_INPUTS, ft.LABEL)))
    people = settle(profiles(spark, sf_dir, columns=cols), "votes")
    now = rfm.scoring_time(people)
    idle = rfm.days_between(now, F.col("last_order_date")).cast("double")
    longest = people.agg(F.max(idle)).scalar()
    scored = scoring.rule_scores(people, keep=(ft.LABEL, "total_orders", "last_order_date"))
    base = scored.select(
        "customer_id",
        (1 - F.col(ft.LABEL)).cast("int").alias("y"),
        F.col("churn_probability").alias("m1"),
        (F.lit(1.0) / (F.lit(1.0) + F.col("total_orders").cast("double"))).alias("m2"),
        (F.coalesce(idle, longest) / 800.0).alias("m3"),
    )
    return settle(splits.fold_assignment(base, "y", "customer_id"), "votes")


@query(
    "soft_vote",
    sql(
        """SELECT customer_id, round(p, 9) AS churn_probability, CAST(round(p, 9) >= 0.5 AS INTEGER) AS prediction FROM (
  SELECT customer_id, m1 * (0.5::DOUBLE / 1.2::DOUBLE) + m2 * (0.3::DOUBLE / 1.2::DOUBLE) + m3 * (0.4::DOUBLE / 1.2::DOUBLE) AS p FROM votes)""",
        "votes",
    ),
)
def _vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    blended = ensemble.soft_vote(["m1", "m2", "m3"], WEIGHTS)
    p = F.round(blended, 9)
    return votes(spark, sf_dir).select(
        "customer_id", p.alias("churn_probability"), (p >= 0.5).cast("int").alias("prediction")
    )


@query(
    "platt_apply",
    sql(
        "SELECT customer_id, round(1.0 / (1.0 + exp(-(4.0 * score + -2.0))), 9) AS churn_probability FROM judged",
        "judged",
    ),
)
def _platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    calibrated = ensemble.platt(F.col("score"), 4.0, -2.0)
    return judged(spark, sf_dir).select("customer_id", F.round(calibrated, 9).alias("churn_probability"))


cte(
    "fold_scores",
    ("votes",),
    f"""fold_scores AS (
  SELECT model, fold, {AUC} AS roc_auc, {AP} AS pr_auc, CAST(sum(pos) AS DOUBLE) / sum(pos + neg) AS pos_rate FROM (
    SELECT model, fold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
      SELECT model, fold, s, sum(y) AS pos, sum(1 - y) AS neg FROM (
        SELECT unnest(['m1', 'm2', 'm3']) AS model, unnest([m1, m2, m3]) AS s, fold, y FROM votes) GROUP BY ALL)
    WINDOW w AS (PARTITION BY model, fold ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY model, fold)""",
)


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("m1", "m2", "m3")]
    )
    long = votes(spark, sf_dir).select("fold", "y", F.inline(cells))
    return metrics.ranking_metrics(long, by=("model", "fold"))


@query(
    "fold_metrics",
    sql("SELECT model, fold, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc, round(pos_rate, 9) AS pos_rate FROM fold_scores", "fold_scores"),
)
def _fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold_scores(spark, sf_dir).drop("n"), 9, "roc_auc", "pr_auc", "pos_rate")


@query(
    "cv_summary",
    sql(
        """SELECT model, metric, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std FROM (
  SELECT model, unnest(['roc_auc', 'pr_auc', 'pos_rate']) AS metric, unnest([roc_auc, pr_auc, pos_rate]) AS value FROM fold_scores) GROUP BY ALL""",
        "fold_scores",
    ),
)
def _cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = metrics.long_metrics(fold_scores(spark, sf_dir), ["model"], ["roc_auc", "pr_auc", "pos_rate"])
    return _rounded(metrics.summarize_cv(long, ("model", "metric")), 8, "mean", "std")


@query(
    "ensemble_weights",
    sql(
        """WITH w AS (SELECT model, GREATEST(avg(roc_auc) - 0.5, 0) + 1e-6 AS w FROM fold_scores GROUP BY 1)
SELECT model, round(w / (SELECT sum(w) FROM w), 8) AS weight FROM w""",
        "fold_scores",
    ),
)
def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = ensemble.ensemble_weights(fold_scores(spark, sf_dir))
    return _rounded(weights, 8, "weight")
