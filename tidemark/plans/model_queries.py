"""Preprocessing, class balance, guardrails, fitted models, lifetime value, segments."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clv, drift, learning, quality, rfm, segments, splits
from tidemark.operators import features as ft
from tidemark.operators import preprocessing as pp
from tidemark.operators.likelihood import maximise
from tidemark.operators.tree_contributions import with_contributions
from tidemark.plans.base_sql import cte, days, sql
from tidemark.plans.experiment_queries import category_psi_sql, numeric_psi_sql
from tidemark.plans.ranking_queries import _rounded, frac
from tidemark.plans.registry import query
from tidemark.plans.report_queries import OUTPUT_INPUTS
from tidemark.session import settle
from tidemark.sources.profiles import profiles


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = profiles(spark, sf_dir, columns=ft.FEATURE_INPUTS)
    return settle(ft.training_set(people), "training")


NUMERIC = [c for c in ft.FEATURE_COLUMNS if c not in ft.STRING_CATEGORICALS]
CATEGORICAL = list(ft.STRING_CATEGORICALS)

_CONSTANT = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) <= 1 AS constant FROM training""" for c in ft.FEATURE_COLUMNS
)


@query("constant_columns", sql(_CONSTANT, "training"))
def _constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = ft.training_set(profiles(spark, sf_dir, columns=ft.FEATURE_INPUTS))
    columns = pp.candidate_columns(people, "churn")
    flags = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("constant")) for c in columns])
    return pp.is_constant(people, columns).select(F.inline(flags))


def _scaled_sql(c: str) -> str:
    filled = f"COALESCE(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM training))"
    return f"""round(({filled} - (SELECT avg({filled}) FROM training)) / (SELECT CASE WHEN stddev_pop({filled}) = 0 THEN 1 ELSE stddev_pop({filled}) END FROM training), 8) AS x_{c}"""


def _coded_sql(c: str) -> str:
    return f"CAST((SELECT count(DISTINCT o.{c}) FROM training o WHERE o.{c} < t.{c}) AS DOUBLE) AS x_{c}"


PREPARED_SQL = ", ".join([_scaled_sql(c) for c in NUMERIC] + [_coded_sql(c) for c in CATEGORICAL])


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training(spark, sf_dir)
    fitted = pp.fit_preprocessor(rows, NUMERIC, CATEGORICAL)
    return _rounded(fitted.transform(rows).select("customer_id", *fitted.outputs), 8, *fitted.outputs)


@query("preprocess", sql(f"SELECT customer_id, {PREPARED_SQL} FROM training t", "training"))
def _preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir)


# One weight per input of the model, of both signs and different sizes: the query states contributions, not a fit.
WEIGHTS = {f"x_{c}": (0.1 + 0.05 * i) * (-1) ** i for i, c in enumerate(NUMERIC + CATEGORICAL)}
_IMPORTANCE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs({w}::DOUBLE * ({c} - m_{c}))), 7) AS mean_abs_contribution FROM p, m"
    for c, w in WEIGHTS.items()
)
_MEANS = ", ".join(f"avg({c}) AS m_{c}" for c in WEIGHTS)


@query(
    "linear_importance",
    sql(
        f"WITH p AS (SELECT customer_id, {PREPARED_SQL} FROM training t), m AS (SELECT {_MEANS} FROM p) {_IMPORTANCE}",
        "training",
    ),
)
def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = learning.linear_importance(settle(prepared(spark, sf_dir), "prepared"), WEIGHTS)
    return _rounded(result, 7, "mean_abs_contribution")


@query(
    "class_balance",
    sql(
        """SELECT n, round(r, 9) AS positive_rate, round(LEAST(r, 1 - r), 9) AS minority_rate, LEAST(r, 1 - r) < 0.15 AS imbalanced, round((1 - r) / r, 9) AS scale_pos_weight
FROM (SELECT count(*) AS n, avg(recency_churn) AS r FROM labels_recency)""",
        "labels_recency",
    ),
)
def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ft.recency_churn_labels(profiles(spark, sf_dir, columns=(ft.ID, *ft.DATE_COLUMNS)))
    result = pp.class_balance(labels, "recency_churn")
    return _rounded(result, 9, "positive_rate", "minority_rate", "scale_pos_weight")


@query(
    "class_weights",
    sql(
        """SELECT recency_churn AS label, count(*) AS n, round((SELECT count(*) FROM labels_recency) / (2.0 * count(*)), 9) AS weight FROM labels_recency GROUP BY 1""",
        "labels_recency",
    ),
)
def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ft.recency_churn_labels(profiles(spark, sf_dir, columns=(ft.ID, *ft.DATE_COLUMNS)))
    return _rounded(pp.class_weights(labels, "recency_churn", balanced=True), 9, "weight")


_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) FILTER (churn IS NOT NULL) > 0 THEN corr(CAST({c} AS DOUBLE), CAST(churn AS DOUBLE)) END), 8) AS abs_corr FROM training"
    for c in NUMERIC
)


@query(
    "leakage_corr",
    sql(f"SELECT feature, abs_corr, COALESCE(abs_corr > 0.95, false) AS leaky FROM ({_CORR})", "training"),
)
def _corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pp.leakage_corr(training(spark, sf_dir), NUMERIC, "churn"), 8, "abs_corr")


PART = f"CASE WHEN {frac('churn || chr(58) || customer_id', '42')} * 100 < 20 THEN 'test' ELSE 'train' END"
cte("parted", ("training",), f"parted AS (SELECT *, {PART} AS part FROM training)")
_REF, _CUR = "(SELECT * FROM parted WHERE part = 'train')", "(SELECT * FROM parted WHERE part = 'test')"
_PSIS = ", ".join(
    [
        f"CASE WHEN (SELECT count({c}) FROM {_REF}) < 10 OR (SELECT count({c}) FROM {_CUR}) = 0 THEN 0 ELSE {numeric_psi_sql(_REF, _CUR, f'CAST({c} AS DOUBLE)')} END"
        for c in NUMERIC
    ]
    + [category_psi_sql(_REF, _CUR, c) for c in CATEGORICAL]
)
_MISSING = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ft.FEATURE_COLUMNS)


PRINTED = ["customer_id", *ft.FEATURE_COLUMNS, "churn", "recency_churn"]


def _printed_text(column: str) -> str:
    """SQL for a value with its length; averages as decimals, which all engines write alike."""
    text = f"CAST(CAST({column} AS DECIMAL(20,6)) AS VARCHAR)" if column == "avg_rating_given" else f"CAST({column} AS VARCHAR)"
    return f"COALESCE(len({text}) || ':' || {text}, '~')"


_PRINT = " || ".join(map(_printed_text, PRINTED))


@query(
    "model_guardrails",
    sql(
        f"""WITH f AS (SELECT {_MISSING} AS missing, LEAST(avg(churn), 1 - avg(churn)) AS minority FROM training),
d AS (SELECT list_max([{_PSIS}]) AS m),
s AS (SELECT CAST(sum(CAST('0x' || substr(md5({_PRINT}), 1, 16) AS HUGEINT)) AS VARCHAR) AS c FROM training)
SELECT 'data_quality' AS "check", 'pass' AS status, 'missing ' || missing || ', duplicates 0' AS detail FROM f
UNION ALL SELECT 'class_balance', CASE WHEN minority > 0.05 THEN 'pass' ELSE 'warn' END, 'minority rate ' || CAST(CAST(round(minority, 4) AS DECIMAL(20,4)) AS VARCHAR) FROM f
UNION ALL SELECT 'leakage', 'pass', 'removed churn, customer_id, recency_churn'
UNION ALL SELECT 'drift', CASE WHEN m > 0.2 THEN 'warn' ELSE 'pass' END, 'largest index ' || CAST(CAST(round(m, 4) AS DECIMAL(20,4)) AS VARCHAR) FROM d
UNION ALL SELECT 'bias', 'pass', CASE WHEN minority < 0.15 THEN 'class weights applied' ELSE 'balanced classes, no reweighting required' END FROM f
UNION ALL SELECT 'data_poisoning', 'pass', 'checksum ' || c FROM s""",
        "parted",
    ),
)
def _guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(splits.stratified_split(training(spark, sf_dir), "churn", "customer_id"), "split")
    whole = rows.drop("part")
    inputs = list(ft.FEATURE_COLUMNS)
    parts = [rows.where(F.col("part") == p).select(*inputs) for p in ("train", "test")]
    return learning.guardrail_rows(
        whole,
        inputs,
        "churn",
        drift.psi_scores(*parts),
        quality.duplicate_rows(whole),
        quality.table_fingerprint(whole.select(*PRINTED).withColumn("avg_rating_given", F.col("avg_rating_given").cast("decimal(20,6)"))),
    )


# ---------- fitted models: no plain SQL states these ----------

@query("score_customers")
def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.stratified_split(training(spark, sf_dir), "churn", "customer_id")
    model = learning.fit_pipeline(rows.where("part = 'train'").drop("part"), "logistic")
    return learning.score_customers(model, rows.drop("part"))


@query("out_of_fold")
def _oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.out_of_fold(training(spark, sf_dir), list(learning.LEARNERS))


@query("model_comparison")
def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.train_ensemble(training(spark, sf_dir)).comparison


# Depths of both tree learners; a forest's trees of 4, 5 and 6 have the leaves of 15, 31 and 63 or so.
SWEEP_FOLDS = 3
SWEEP = {
    "gbt": [{"maxDepth": d} for d in (4, 6, 8)],
    "random_forest": [{"maxDepth": d} for d in (4, 5, 6)],
}


@query("hyperparameter_sweep")
def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training(spark, sf_dir)
    people = profiles(spark, sf_dir, columns=("customer_id", "last_order_date"))
    timed = splits.walk_forward_folds(
        settle(rows.join(people, "customer_id"), "timed"), "last_order_date", "customer_id", SWEEP_FOLDS
    ).drop("last_order_date")
    return learning.tune(settle(timed, "timed"), SWEEP, folds=range(SWEEP_FOLDS))


@query("model_importance")
def _model_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training(spark, sf_dir)
    model = learning.fit_pipeline(rows, "random_forest")
    return learning.model_importance(model, rows)


@query("tree_contribution_sums", sql("SELECT customer_id, true AS adds_up FROM training", "training"))
def _contribution_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether base and contributions of all inputs add up to the margin of the boosted trees, for every customer."""
    rows = training(spark, sf_dir)
    model = learning.fit_pipeline(rows, "gbt")
    shares = with_contributions(model, rows, "customer_id")
    total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in shares.columns[2:]], F.col("base"))
    margin = model.transform(rows).select("customer_id", vector_to_array("rawPrediction")[1].alias("margin"))
    near = F.abs(F.col("total") - F.col("margin")) <= 1e-9 * (1 + F.abs("margin"))
    return shares.select("customer_id", total.alias("total")).join(margin, "customer_id").select("customer_id", near.alias("adds_up"))


@query("permutation_importance")
def _permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training(spark, sf_dir)
    model = learning.fit_pipeline(rows, "logistic")
    return learning.permutation_importance(model, rows, pp.feature_columns(rows, "churn"))


# ---------- cart propensity and discount sensitivity ----------

CART_INPUTS = (
    "customer_id",
    "total_sessions",
    "preferred_device_sess",
    "preferred_source_sess",
    "has_abandoned_cart",
)
_DUMMIES = ", ".join(
    f"""CAST(COALESCE({c}, 'Missing') = '{v}' AS DOUBLE) AS "{c}_{v}\""""
    for c, vs in (("preferred_device_sess", "012"), ("preferred_source_sess", "0123"))
    for v in [*vs, "Missing"]
)


def cart_features(people: DataFrame) -> DataFrame:
    hot = pp.one_hot(people, ["preferred_device_sess", "preferred_source_sess"])
    return hot.withColumn("total_sessions", F.coalesce("total_sessions", F.lit(0)).cast("double"))


@query(
    "cart_features",
    sql(
        f"SELECT customer_id, CAST(total_sessions AS DOUBLE) AS total_sessions, has_abandoned_cart, {_DUMMIES} FROM profiles",
        "profiles",
    ),
)
def _cart_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cart_features(settle(profiles(spark, sf_dir, columns=CART_INPUTS), "cart"))


@query(
    "discount_sensitivity",
    sql(
        """SELECT customer_id, round((0.6::DOUBLE * (0.05::DOUBLE + 0.9::DOUBLE * CAST(has_abandoned_cart AS DOUBLE)) + 0.4::DOUBLE * (LEAST(GREATEST(COALESCE(avg_discount_pct, 0.0), 0.0), 30.0) / 30.0::DOUBLE)) * 100.0::DOUBLE, 6) AS discount_sensitivity FROM profiles""",
        "profiles",
    ),
)
def _sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.lit(0.05) + F.lit(0.9) * F.col("has_abandoned_cart").cast("double")
    value = clv.discount_sensitivity(p, F.col("avg_discount_pct"))
    people = profiles(spark, sf_dir, columns=("customer_id", "has_abandoned_cart", "avg_discount_pct"))
    return people.select("customer_id", F.round(value, 6).alias("discount_sensitivity"))


def cart_scores(people: DataFrame) -> DataFrame:
    """Abandon probability for everyone from a scaled logistic fitted on the train part."""
    table = settle(
        splits.stratified_split(cart_features(people), "has_abandoned_cart", "customer_id"), "cart"
    )
    inputs = [c for c in table.columns if c not in ("customer_id", "has_abandoned_cart", "part")]
    train = table.where("part = 'train'")
    fitted = pp.fit_preprocessor(train, inputs, [])
    assembler = VectorAssembler(inputCols=fitted.outputs, outputCol="features")
    n = max(train.count(), 1)
    learner = LogisticRegression(
        labelCol="has_abandoned_cart", maxIter=200, regParam=1.0 / n, standardization=False
    )
    model = learner.fit(assembler.transform(fitted.transform(train)))
    scored = model.transform(assembler.transform(fitted.transform(table)))
    probability = vector_to_array(F.col("probability"))[1]
    return scored.select("customer_id", "has_abandoned_cart", "part", probability.alias("cart_abandon_probability"))


@query("cart_propensity")
def _propensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cart_scores(settle(profiles(spark, sf_dir, columns=CART_INPUTS), "cart"))


# ---------- lifetime value ----------

BG = (0.8, 90.0, 1.9, 2.5)
GG = (3.1, 4.2, 210000.0)
CLV_COLUMNS = (
    "customer_id",
    "total_orders",
    "first_order_date",
    "last_order_date",
    "avg_order_value",
    "total_spend_usd",
)
cte(
    "clvin",
    ("profiles",),
    f"""clvin AS (SELECT * FROM (
  SELECT customer_id, CAST(GREATEST(total_orders - 1, 0) AS DOUBLE) AS frequency, CAST(GREATEST({days('last_order_date', 'first_order_date')}, 1) AS DOUBLE) AS recency,
    CAST({days('now_', 'first_order_date')} AS DOUBLE) AS tenure, avg_order_value AS monetary
  FROM profiles, (SELECT max(last_order_date) + INTERVAL 1 DAY AS now_ FROM profiles) WHERE total_orders > 0) WHERE tenure > 0)""",
)


def clv_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clv.clv_inputs(profiles(spark, sf_dir, columns=CLV_COLUMNS))


@query("clv_inputs", sql("SELECT * FROM clvin", "clvin"))
def _clv_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clv_base(spark, sf_dir)


R, ALPHA, A, B = BG
_COMMON = f"lgamma({R} + x) - lgamma({R}) + {R} * ln({ALPHA}) + lgamma({A + B}) + lgamma({B} + x) - lgamma({B}) - lgamma({A + B} + x)"


@query(
    "bgnbd_loglik",
    sql(
        f"""SELECT customer_id, round(CASE WHEN x > 0 THEN GREATEST(u, v) + ln(1 + exp(-abs(u - v))) ELSE u END, 7) AS loglik FROM (
  SELECT customer_id, x, {_COMMON} - ({R} + x) * ln({ALPHA} + tenure) AS u,
    CASE WHEN x > 0 THEN {_COMMON} + ln({A}) - ln({B} + x - 1) - ({R} + x) * ln({ALPHA} + recency) END AS v
  FROM (SELECT *, frequency AS x FROM clvin))""",
        "clvin",
    ),
)
def _loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = clv.bgnbd_loglik(BG, F.col("frequency"), F.col("recency"), F.col("tenure"))
    return clv_base(spark, sf_dir).select("customer_id", F.round(value, 7).alias("loglik"))


P, Q, V = GG


@query(
    "gamma_gamma_loglik",
    sql(
        f"""SELECT customer_id, round(lgamma({P} * x + {Q}) - lgamma({P} * x) - lgamma({Q}) + {Q} * ln({V}) + ({P} * x - 1) * ln(m) + {P} * x * ln(x) - ({P} * x + {Q}) * ln({V} + m * x), 7) AS loglik
FROM (SELECT customer_id, frequency AS x, monetary AS m FROM clvin WHERE frequency >= 1)""",
        "clvin",
    ),
)
def _gg_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = clv.gamma_gamma_loglik(GG, F.col("frequency"), F.col("monetary"))
    repeat = clv_base(spark, sf_dir).where(F.col("frequency") >= 1)
    return repeat.select("customer_id", F.round(value, 7).alias("loglik"))


# The hypergeometric series written out term by term; 600 terms leave nothing at these ratios.
_SERIES = f"""list_sum(list_transform(range(0, 600), lambda n: exp(lgamma({R} + x + n) - lgamma({R} + x) + lgamma({B} + x + n) - lgamma({B} + x)
  - lgamma({A + B - 1} + x + n) + lgamma({A + B - 1} + x) - lgamma(n + 1) + n * ln(z))))"""


@query(
    "expected_transactions",
    sql(
        f"""SELECT customer_id, round(GREATEST(({A + B - 1} + x) / ({A} - 1) * (1 - pow(({ALPHA} + tenure) / ({ALPHA} + tenure + 365), {R} + x) * {_SERIES}), 0), 6) AS expected_orders
FROM (SELECT *, frequency AS x, 365.0::DOUBLE / ({ALPHA} + tenure + 365) AS z FROM clvin)""",
        "clvin",
    ),
)
def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = clv.expected_transactions(BG, 365, F.col("frequency"), F.col("recency"), F.col("tenure"))
    return clv_base(spark, sf_dir).select("customer_id", F.round(value, 6).alias("expected_orders"))


_SPEND = f"(1 - w) * ({V} * {P} / ({Q} - 1)) + w * monetary"
cte(
    "spend",
    ("clvin",),
    f"spend AS (SELECT *, {_SPEND} AS expected_spend FROM (SELECT *, CAST({P} AS DOUBLE) * frequency / (CAST({P} AS DOUBLE) * frequency + {Q} - 1) AS w FROM clvin))",
)


@query(
    "gg_expected_spend",
    sql("SELECT customer_id, round(expected_spend, 5) AS expected_spend FROM spend", "spend"),
)
def _spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = clv.expected_spend(GG, F.col("frequency"), F.col("monetary"))
    return clv_base(spark, sf_dir).select("customer_id", F.round(value, 5).alias("expected_spend"))


@query(
    "clv_tiers",
    sql(
        """WITH c AS (SELECT customer_id, frequency / tenure * 365.0::DOUBLE * (expected_spend / 1000.0) AS v FROM spend),
q AS (SELECT quantile_cont(v, 0.33) AS lo, quantile_cont(v, 0.66) AS hi FROM c WHERE v > 0)
SELECT customer_id, round(v, 6) AS predicted_clv, CASE WHEN v <= 0 THEN 'Low' WHEN v >= hi THEN 'High' WHEN v >= lo THEN 'Medium' ELSE 'Low' END AS predicted_clv_tier FROM c, q""",
        "spend",
    ),
)
def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value from the past order rate and the shrunk spend, in thousands."""
    base = settle(
        clv_base(spark, sf_dir).select(
            "customer_id",
            (F.col("frequency") / F.col("tenure") * 365.0).alias("expected_orders"),
            (clv.expected_spend(GG, F.col("frequency"), F.col("monetary")) / 1000.0).alias("expected_spend"),
        ),
        "clv",
    )
    valued = clv.with_value(base).select("customer_id", "predicted_clv", "predicted_clv_tier")
    return _rounded(valued, 6, "predicted_clv")


@query("bgnbd_fit")
def _bgnbd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = clv.fit_bgnbd(settle(clv_base(spark, sf_dir), "clv"))
    return spark.createDataFrame([tuple(map(float, params))], "r double, alpha double, a double, b double")


@query("gamma_gamma_fit")
def _gg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = clv.fit_gamma_gamma(settle(clv_base(spark, sf_dir), "clv"))
    return spark.createDataFrame([tuple(map(float, params))], "p double, q double, v double")


def _zero_slopes(*names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in names) + ") AS t(parameter, slope_is_zero)"


def _slopes(rows: DataFrame, model, names: tuple[str, ...]) -> DataFrame:
    """Whether the likelihood is level, to 1e-6 per customer and log parameter, where the fit ends."""
    rows = settle(rows, "histories")
    left = clv.fit_slopes(rows, model, maximise(rows, model, [1.0] * len(names)), names)
    return left.select("parameter", (F.abs("slope") <= 1e-6).alias("slope_is_zero"))


@query("bgnbd_fit_slopes", _zero_slopes("r", "alpha", "a", "b"))
def _bgnbd_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(clv.purchase_histories(clv_base(spark, sf_dir)), clv.purchase_model, ("r", "alpha", "a", "b"))


@query("gamma_gamma_fit_slopes", _zero_slopes("p", "q", "v"))
def _gg_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(clv.spend_histories(clv_base(spark, sf_dir)), clv.spend_model, ("p", "q", "v"))


@query("segments")
def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.fit_segmentation(settle(profiles(spark, sf_dir, columns=CLV_COLUMNS), "rfm"))


def customer_models(people: DataFrame, horizon_days: int = 365) -> DataFrame:
    """Segment, RFM scores, lifetime value, cart propensity and discount sensitivity."""
    inputs = settle(clv.clv_inputs(people), "clv")
    bg, gg = clv.fit_bgnbd(inputs), clv.fit_gamma_gamma(inputs)
    x, tx, t = F.col("frequency"), F.col("recency"), F.col("tenure")
    expected = inputs.select(
        "customer_id",
        clv.expected_transactions([float(p) for p in bg], horizon_days, x, tx, t).alias("expected_orders"),
        clv.expected_spend([float(p) for p in gg], x, F.col("monetary")).alias("expected_spend"),
    )
    valued = clv.with_value(settle(expected, "expected"))
    carts = cart_scores(people.select(*CART_INPUTS)).select("customer_id", "cart_abandon_probability")
    joined = (
        segments.fit_segmentation(people)
        .join(rfm.rfm_scores(people), "customer_id")
        .join(valued, "customer_id", "left")
        .join(carts, "customer_id")
        .join(people.select("customer_id", "avg_discount_pct"), "customer_id")
    )
    sensitivity = clv.discount_sensitivity(F.col("cart_abandon_probability"), F.col("avg_discount_pct"))
    return joined.select(
        "customer_id",
        "segment",
        "rfm_recency_score",
        "rfm_frequency_score",
        "rfm_monetary_score",
        F.round(F.coalesce("expected_orders", F.lit(0.0)), 3).alias("predicted_orders_12m"),
        F.round(F.coalesce("predicted_clv", F.lit(0.0)), 2).alias("predicted_clv"),
        F.coalesce("predicted_clv_tier", F.lit("Low")).alias("predicted_clv_tier"),
        F.round("cart_abandon_probability", 4).alias("cart_abandon_probability"),
        F.round(sensitivity, 1).alias("discount_sensitivity"),
    )


@query("customer_models")
def _customer_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = tuple(dict.fromkeys((*CLV_COLUMNS, *CART_INPUTS, *OUTPUT_INPUTS)))
    return customer_models(settle(profiles(spark, sf_dir, columns=columns), "people"))
