"""Feature selection, imputation, scaling, encoding and class weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from tidemark.operators.selection import VALUE_LIMIT, exact_quantiles

# Columns that never enter a model.
IDENTIFIERS = ("customer_id", "name", "email")
LABELS = ("churn", "recency_churn", "is_repeat_customer")
LEAKY = ("total_orders",)
TARGET_LEAKS = {"recency_churn": ("recency_days", "order_session_gap_days")}
MISSING = "MISSING"
MAX_CATEGORIES = 10_000
MINORITY_RATE = 0.15


def is_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: per column, whether it has at most one distinct value. No distinct is counted."""
    return df.agg(
        *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]
    )


def candidate_columns(df: DataFrame, target: str) -> list[str]:
    if target not in df.columns:
        raise ValueError(f"target column not found: {target}")
    banned = {*IDENTIFIERS, *LABELS, *LEAKY, target, *TARGET_LEAKS.get(target, ())}
    dated = (TimestampType, TimestampNTZType, DateType)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in banned and not isinstance(f.dataType, dated)
    ]


def feature_columns(df: DataFrame, target: str = "churn") -> list[str]:
    """Model inputs: no identifier, label, leaky, date or constant column."""
    candidates = candidate_columns(df, target)
    constant = is_constant(df, candidates).first().asDict()
    return [c for c in candidates if not constant[c]]


def numeric_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]


def categorical_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Texts and flags."""
    return [c for c in columns if isinstance(df.schema[c].dataType, (StringType, BooleanType))]


@dataclass(frozen=True)
class Preprocessor:
    """Fitted medians, moments and sorted categories; small enough to be literals."""

    numeric: dict[str, tuple[float, float, float]]
    categories: dict[str, list[str]]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categories]

    @property
    def outputs(self) -> list[str]:
        return [f"x_{c}" for c in self.columns]

    def expressions(self) -> list[str]:
        """SQL expressions of the outputs; unseen categories are -1."""
        exprs = []
        for c, (median, mean, deviation) in self.numeric.items():
            scale = deviation or 1.0
            exprs.append(
                f"(coalesce(cast(`{c}` AS double), {median!r}D) - {mean!r}D) / {scale!r}D AS `x_{c}`"
            )
        for c, values in self.categories.items():
            pairs = ", ".join(f"{_quote(v)}, {i}.0D" for i, v in enumerate(values))
            known = f"try_element_at(map({pairs}), coalesce(cast(`{c}` AS string), '{MISSING}'))"
            exprs.append(f"coalesce({known}, -1.0D) AS `x_{c}`")
        return exprs

    def transformer(self) -> SQLTransformer:
        """As a pipeline stage, so that it is saved and loaded with the model."""
        return SQLTransformer(statement=f"SELECT *, {', '.join(self.expressions())} FROM __THIS__")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.selectExpr("*", *self.expressions())


def _quote(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def fit_preprocessor(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], limit: int = VALUE_LIMIT
) -> Preprocessor:
    """Exact medians, mean and population deviation after imputation, category lists."""
    moments: dict[str, tuple[float, float, float]] = {}
    if numeric:
        quantiles = exact_quantiles(df, {c: F.col(c) for c in numeric}, [0.5], limit)
        medians = {c: (quantiles[c] or [0.0])[0] for c in numeric}
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in numeric}
        row = df.agg(
            *[F.avg(filled[c]).alias(f"m_{c}") for c in numeric],
            *[F.stddev_pop(filled[c]).alias(f"s_{c}") for c in numeric],
        ).first()
        moments = {c: (medians[c], row[f"m_{c}"], row[f"s_{c}"]) for c in numeric}
    categories: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        cells = F.array(
            *[
                F.struct(
                    F.lit(c).alias("c"),
                    F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("v"),
                )
                for c in categorical
            ]
        )
        pairs = df.select(F.inline(cells)).distinct()
        cap = MAX_CATEGORIES * len(categorical)
        rows = pairs.limit(cap + 1).collect()
        if len(rows) > cap:
            raise ValueError(f"more than {cap} categories; drop or hash such columns first")
        for row in rows:
            categories[row["c"]].append(row["v"])
    return Preprocessor(moments, {c: sorted(v) for c, v in categories.items()})


# ---------- class balance ----------


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rates, the imbalance flag and the weight that balances the positives."""
    y = F.col(label).cast("double")
    rate = df.agg(F.count("*").alias("n"), F.avg(y).alias("positive_rate"))
    minority = F.least(F.col("positive_rate"), 1 - F.col("positive_rate"))
    weight = F.when(F.col("positive_rate") > 0, (1 - F.col("positive_rate")) / F.col("positive_rate"))
    return rate.withColumns(
        {
            "minority_rate": minority,
            "imbalanced": minority < MINORITY_RATE,
            "scale_pos_weight": F.coalesce(weight, F.lit(1.0)),
        }
    )


def class_weights(df: DataFrame, label: str, balanced: bool = False) -> DataFrame:
    """Weight per class: positives scaled by neg/pos, or n / (2 n_class) when balanced."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    n = counts.agg(F.struct(F.sum("n").alias("all"), F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("pos")))
    sized = counts.withColumn("t", n.scalar())
    if balanced:
        weight = F.col("t.all") / (2 * F.col("n"))
    else:
        scaled = (F.col("t.all") - F.col("t.pos")) / F.col("t.pos")
        weight = F.when(F.col("label") == 1, scaled).otherwise(1.0)
    return sized.select("label", "n", weight.alias("weight"))


def weight_column(df: DataFrame, label: str) -> Column:
    """The positive-class weight of ``df`` as an expression."""
    row = class_balance(df, label).first()
    return F.when(F.col(label) == 1, F.lit(float(row["scale_pos_weight"]))).otherwise(1.0)


def oversample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Repeat minority rows until the classes are about even; fractions by a hash of the key."""
    row = class_balance(df, label).first()
    rate = row["positive_rate"]
    if not rate or rate == 1:
        return df
    minority, times = (1, (1 - rate) / rate) if rate <= 0.5 else (0, rate / (1 - rate))
    whole, part = int(times), times - int(times)
    extra = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(part * 1_000_000))
    copies = F.when(F.col(label) == minority, F.lit(whole) + extra.cast("int")).otherwise(1)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


# ---------- one-hot ----------


def one_hot(df: DataFrame, columns: Sequence[str], missing: str = "Missing") -> DataFrame:
    """0/1 columns ``column_value`` for every value; NULL is the value ``missing``."""
    fitted = fit_preprocessor(df.fillna(missing, list(columns)), [], columns)
    flags = {
        f"{c}_{v}": (F.coalesce(F.col(c), F.lit(missing)) == v).cast("double")
        for c, values in fitted.categories.items()
        for v in values
    }
    return df.withColumns(flags).drop(*columns)


# ---------- leakage ----------


def leakage_corr(df: DataFrame, columns: Sequence[str], label: str, limit: float = 0.95) -> DataFrame:
    """Absolute correlation of every column with the label, in one aggregate."""
    y = F.col(label).cast("double")
    cells = [
        F.struct(F.lit(c).alias("feature"), F.abs(F.nanvl(F.corr(F.col(c).cast("double"), y), F.lit(None))).alias("abs_corr"))
        for c in columns
    ]
    rows = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return rows.withColumn("leaky", F.coalesce(F.col("abs_corr") > limit, F.lit(False)))
