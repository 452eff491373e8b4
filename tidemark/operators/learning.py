"""Churn models: training, cross-validation, calibration, importances, scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators import metrics as mt
from tidemark.operators import preprocessing as pp
from tidemark.operators.ensemble import ensemble_weights, platt, soft_vote
from tidemark.operators.scoring import with_tier
from tidemark.operators.splits import fold_assignment, stratified_split
from tidemark.operators.synthetic import synthetic_rows
from tidemark.operators.tree_contributions import tree_importance
from tidemark.session import settle

LEARNERS = {
    "logistic": LogisticRegression,
    "gbt": GBTClassifier,
    "random_forest": RandomForestClassifier,
}
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "logistic": {"maxIter": 100, "regParam": 0.001},
    "gbt": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42, "maxBins": 64},
    "random_forest": {"numTrees": 40, "maxDepth": 6, "seed": 42, "maxBins": 64},
}
LABEL, KEY, WEIGHT = "churn", "customer_id", "_weight"


def make_model(kind: str, params: Mapping[str, Any] | None = None, label: str = LABEL):
    """Unfitted learner; an unknown kind is an error."""
    if kind not in LEARNERS:
        raise ValueError(f"unknown model type: {kind}")
    settings = {**DEFAULT_PARAMS[kind], **(params or {})}
    return LEARNERS[kind](featuresCol="features", labelCol=label, weightCol=WEIGHT, **settings)


def fit_pipeline(
    train: DataFrame,
    kind: str,
    params: Mapping[str, Any] | None = None,
    label: str = LABEL,
    features: Sequence[str] | None = None,
    synthetic: bool = False,
    key: str = KEY,
) -> PipelineModel:
    """Preprocessing, assembly and learner, fitted on ``train`` with balancing weights.

    With ``synthetic``, and a minority below MINORITY_RATE, the learner sees synthetic rows of
    the smaller class as well, made of the prepared rows of ``train`` alone.
    """
    columns = list(features or pp.feature_columns(train, label))
    prepared = pp.fit_preprocessor(
        train, pp.numeric_features(train, columns), pp.categorical_features(train, columns)
    )
    weighted = train.withColumn(WEIGHT, pp.weight_column(train, label))
    assembler = VectorAssembler(inputCols=prepared.outputs, outputCol="features")
    learner = make_model(kind, params, label)
    if not (synthetic and pp.class_balance(train, label).first()["imbalanced"]):
        return Pipeline(stages=[prepared.transformer(), assembler, learner]).fit(weighted)
    real = settle(prepared.transform(weighted).select(key, label, WEIGHT, *prepared.outputs), "prepared")
    made = synthetic_rows(real, label, key, prepared.outputs).withColumn(WEIGHT, pp.weight_column(train, label))
    both = settle(real.drop(key).unionByName(made), "with-synthetic")
    return PipelineModel(stages=[prepared.transformer(), assembler, learner.fit(assembler.transform(both))])


def positive(model: Transformer, df: DataFrame, name: str) -> DataFrame:
    """Add the positive-class probability as ``name`` and keep the other columns of ``df``."""
    scored = model.transform(df)
    probability = vector_to_array(F.col("probability"))[1]
    return scored.select(*df.columns, probability.alias(name))


# ---------- cross-validation ----------


def out_of_fold(
    df: DataFrame,
    kinds: Sequence[str],
    params: Mapping[str, Mapping[str, Any]] | None = None,
    folds: int = 5,
    label: str = LABEL,
    key: str = KEY,
    synthetic: bool = True,
) -> DataFrame:
    """(key, label, fold, one probability per kind): each row scored by models not fitted on it.

    Where the minority is small, each fold's models also learn from ``synthetic`` rows of its training part.
    """
    folded = settle(fold_assignment(df, label, key, folds), "folds")
    columns = pp.feature_columns(folded.drop("fold"), label)
    parts = []
    for fold in range(folds):
        train, valid = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        for kind in kinds:
            model = fit_pipeline(train, kind, (params or {}).get(kind), label, columns, synthetic, key)
            valid = positive(model, valid, f"p_{kind}")
        parts.append(valid.select(key, label, "fold", *[f"p_{k}" for k in kinds]))
    return reduce(DataFrame.unionByName, parts)


def model_rows(scored: DataFrame, kinds: Sequence[str], *keep: str) -> DataFrame:
    """Probability columns as (keep..., model, score) rows."""
    cells = F.array(
        *[F.struct(F.lit(k).alias("model"), F.col(f"p_{k}").alias("score")) for k in kinds]
    )
    return scored.select(*keep, F.inline(cells))


def fold_metrics(oof: DataFrame, kinds: Sequence[str], label: str = LABEL) -> DataFrame:
    """Ranking and threshold metrics per model and fold, all folds in one job."""
    rows = model_rows(oof, kinds, "fold", label)
    return mt.binary_metrics(rows, label, "score", by=("model", "fold"))


def walk_forward_cv(
    df: DataFrame,
    kind: str,
    params: Mapping[str, Any] | None = None,
    label: str = LABEL,
    folds: Sequence[int] = (0, 1, 2, 3, 4),
) -> DataFrame:
    """Metrics per fold of rows carrying ``test_fold``; each trains on everything earlier."""
    columns = pp.feature_columns(df.drop("test_fold"), label)
    parts = []
    for fold in folds:
        train = df.where(F.col("test_fold") < fold)
        model = fit_pipeline(train, kind, params, label, columns)
        valid = positive(model, df.where(F.col("test_fold") == fold), "score")
        parts.append(valid.select("test_fold", label, "score"))
    scored = reduce(DataFrame.unionByName, parts).withColumnRenamed("test_fold", "fold")
    return mt.binary_metrics(scored, label, "score", by=("fold",))


def tune(
    df: DataFrame,
    grids: Mapping[str, Sequence[Mapping[str, Any]]],
    label: str = LABEL,
    folds: Sequence[int] = (0, 1, 2),
) -> DataFrame:
    """Mean average precision of every setting over walk-forward folds; ``best`` marks winners."""
    rows = []
    for kind, grid in grids.items():
        results = []
        for setting in grid:
            per_fold = walk_forward_cv(df, kind, setting, label, folds)
            score = per_fold.agg(F.avg("pr_auc")).first()[0]
            results.append((kind, str(dict(setting)), float(score)))
        top = max(r[2] for r in results)
        winner = next(i for i, r in enumerate(results) if r[2] == top)
        rows += [(*r, i == winner) for i, r in enumerate(results)]
    return df.sparkSession.createDataFrame(rows, "model string, params string, pr_auc double, best boolean")


# ---------- ensemble ----------


def fit_platt(scored: DataFrame, score: str, label: str = LABEL, c: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through the scores (penalty 1 / C)."""
    assembled = VectorAssembler(inputCols=[score], outputCol="_s").transform(scored)
    n = scored.count()
    curve = LogisticRegression(
        featuresCol="_s", labelCol=label, regParam=1.0 / (c * max(n, 1)), standardization=False
    ).fit(assembled)
    return float(curve.coefficients[0]), float(curve.intercept)


@dataclass(frozen=True)
class CalibratedEnsemble:
    """Weighted average of fitted models with a sigmoid on top."""

    models: Mapping[str, PipelineModel]
    weights: Mapping[str, float]
    slope: float | None = None
    intercept: float = 0.0

    def blend(self) -> Column:
        kinds = list(self.models)
        return soft_vote([f"p_{k}" for k in kinds], [self.weights[k] for k in kinds])

    def transform(self, df: DataFrame, name: str = "churn_probability") -> DataFrame:
        """Add the probability; the models run in one pass over ``df``, without joins."""
        scored = df
        for kind, model in self.models.items():
            scored = positive(model, scored, f"p_{kind}")
        blended = self.blend()
        if self.slope is not None:
            blended = platt(blended, self.slope, self.intercept)
        return scored.select(*df.columns, blended.alias(name))


@dataclass(frozen=True)
class TrainingResult:
    ensemble: CalibratedEnsemble
    folds: DataFrame
    comparison: DataFrame
    thresholds: dict[str, float]
    holdout: DataFrame = field(repr=False)


def train_ensemble(
    df: DataFrame,
    kinds: Sequence[str] = ("logistic", "gbt", "random_forest"),
    params: Mapping[str, Mapping[str, Any]] | None = None,
    folds: int = 5,
    label: str = LABEL,
    ltv: float = 500.0,
    incentive_cost: float = 50.0,
) -> TrainingResult:
    """Holdout, out-of-fold scores, weights, calibration, thresholds and final fits."""
    split = settle(stratified_split(df, label, KEY), "split")
    train = split.where("part = 'train'").drop("part")
    test = split.where("part = 'test'").drop("part")
    oof = settle(out_of_fold(train, kinds, params, folds, label), "oof")
    per_fold = settle(fold_metrics(oof, kinds, label), "fold_metrics")
    weights = {r["model"]: r["weight"] for r in ensemble_weights(per_fold).collect()}
    blended = oof.select(label, soft_vote([f"p_{k}" for k in kinds], [weights[k] for k in kinds]).alias("score"))
    blended = settle(blended, "blend")
    slope, intercept = fit_platt(blended, "score", label)
    calibrated = settle(blended.withColumn("score", platt(F.col("score"), slope, intercept)), "calibrated")
    thresholds = {
        "f1": mt.f1_threshold(calibrated, label).first()["threshold"],
        "youden": mt.youden_threshold(calibrated, label).first()["threshold"],
        "profit": mt.optimal_threshold(calibrated, ltv, incentive_cost, label).first()["threshold"],
    }
    columns = pp.feature_columns(train, label)
    models = {k: fit_pipeline(train, k, (params or {}).get(k), label, columns) for k in kinds}
    final = CalibratedEnsemble(models, weights, slope, intercept)
    scored = test
    for kind, model in models.items():
        scored = positive(model, scored, f"p_{kind}")
    ensembled = platt(final.blend(), slope, intercept).alias("p_ensemble")
    scored = settle(scored.select(KEY, label, *[f"p_{k}" for k in kinds], ensembled), "holdout")
    comparison = mt.binary_metrics(
        model_rows(scored, [*kinds, "ensemble"], label), label, "score", by=("model",)
    )
    return TrainingResult(final, per_fold, comparison, thresholds, scored)


def score_customers(model: Transformer | CalibratedEnsemble, features: DataFrame) -> DataFrame:
    """(customer_id, churn_probability, risk_tier); works with any fitted model passed in."""
    if isinstance(model, CalibratedEnsemble):
        scored = model.transform(features)
    else:
        scored = positive(model, features, "churn_probability")
    return with_tier(scored.select(KEY, "churn_probability"))


# ---------- importances ----------


def linear_importance(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Mean absolute contribution of each input of a linear model, exact, in two aggregates."""
    names = list(weights)
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    centred = df.withColumn("_m", means)
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.abs(F.lit(float(weights[c])) * (F.col(c) - F.col(f"_m.{c}")))).alias("mean_abs_contribution"),
        )
        for c in names
    ]
    rows = centred.agg(F.array(*cells).alias("cells"))
    return rows.select(F.inline("cells"))


def model_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Mean absolute contributions to the score of a fitted pipeline, exact for linear models and for trees."""
    learner = model.stages[-1]
    inputs = model.stages[-2].getInputCols()
    if hasattr(learner, "coefficients"):
        prepared = model.stages[0].transform(df)
        return linear_importance(prepared, dict(zip(inputs, map(float, learner.coefficients), strict=True)))
    return tree_importance(model, df, KEY)


def moved_on(column: str, ring: WindowSpec) -> Column:
    """The value of the row before on the ring; the first row of a ring takes the last one's."""
    held = F.struct(F.col(column).alias("v"))  # never NULL, whatever the value
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lag(held, 1).over(ring), F.last(held).over(whole))["v"]


def permutation_importance(
    model: Transformer, df: DataFrame, columns: Sequence[str], label: str = LABEL, key: str = KEY
) -> DataFrame:
    """AUC lost when a column's values are handed to other rows.

    Values, missing ones too, move one row on along a hash ring of the keys in the same small hash
    bucket, so no global shuffle order is needed and a bucket's rows keep its values.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(max(1, df.count() // 1000)))
    ring = Window.partitionBy("_bucket").orderBy(F.xxhash64(F.col(key), F.lit(7)), F.col(key))
    base = df.withColumn("_bucket", bucket)
    scored = positive(model, df, "score").select(F.lit("_none").alias("feature"), label, "score")
    parts = [scored]
    for c in columns:
        shuffled = base.withColumn(c, moved_on(c, ring)).drop("_bucket")
        parts.append(positive(model, shuffled, "score").select(F.lit(c).alias("feature"), label, "score"))
    auc = mt.ranking_metrics(reduce(DataFrame.unionByName, parts), label, "score", by=("feature",))
    whole = auc.where("feature = '_none'").select("roc_auc").scalar()
    return auc.where("feature <> '_none'").select("feature", (whole - F.col("roc_auc")).alias("auc_drop"))


# ---------- guardrails ----------


def guardrail_rows(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    psi: DataFrame,
    duplicates: DataFrame,
    fingerprint: DataFrame,
    gap: float | None = None,
) -> DataFrame:
    """Checks of a training set and its split as (check, status, detail) rows."""
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in features])
    facts = df.agg(missing.alias("missing"), F.avg(F.col(label).cast("double")).alias("rate"))
    facts = facts.withColumns(
        {
            "duplicates": duplicates.scalar(),
            "drift": psi.agg(F.struct(F.max("psi").alias("m"), F.count_if(F.col("psi") > 0.2).alias("n"))).scalar(),
            "print": fingerprint.select("checksum").scalar(),
        }
    )
    minority = F.least(F.col("rate"), 1 - F.col("rate"))
    removed = sorted(c for c in df.columns if c in {*pp.IDENTIFIERS, *pp.LABELS, *pp.LEAKY})

    def check(name: str, fine: Column, detail: Column) -> Column:
        status = F.when(fine, "pass").otherwise("warn")
        return F.struct(F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"))

    def text(value: Column, digits: int) -> Column:
        return F.round(value, digits).cast("decimal(20,4)").cast("string")

    rows = [
        check(
            "data_quality",
            F.col("duplicates") == 0,
            F.concat(F.lit("missing "), F.col("missing").cast("string"), F.lit(", duplicates "), F.col("duplicates").cast("string")),
        ),
        check("class_balance", minority > 0.05, F.concat(F.lit("minority rate "), text(minority, 4))),
        check("leakage", F.lit(True), F.lit("removed " + ", ".join(removed))),
        check(
            "drift",
            F.col("drift.n") == 0,
            F.concat(F.lit("largest index "), text(F.col("drift.m"), 4)),
        ),
        check(
            "bias",
            F.lit(True),
            F.when(minority < pp.MINORITY_RATE, "class weights applied").otherwise(
                "balanced classes, no reweighting required"
            ),
        ),
        check("data_poisoning", F.lit(True), F.concat(F.lit("checksum "), F.col("print"))),
    ]
    if gap is not None:
        rows.append(check("overfitting", F.lit(abs(gap) < 0.05), F.lit(f"gap {gap:.4f}")))
    return facts.select(F.inline(F.array(*rows)))
