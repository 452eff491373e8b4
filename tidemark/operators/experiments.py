"""Controlled experiments: sizes, arms, balance, tests, variance reduction, decision.

All statistics come from per-arm aggregates; only one row per arm or look is left when
the closed formulas are applied.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_fraction
from tidemark.functions.special import (
    normal_quantile,
    normal_two_sided_p,
    student_quantile,
    student_two_sided_p,
)
from tidemark.params import DEFAULTS

CONTROL, TREATMENT = "control", "treatment"


# ---------- design ----------


@dataclass(frozen=True)
class SampleSize:
    n_per_group: int
    total_required: int
    mde_absolute: float
    mde_relative: float
    power: float
    alpha: float
    baseline_rate: float
    treatment_rate: float


def sample_size_proportions(
    baseline_rate: float,
    mde_relative: float,
    alpha: float = DEFAULTS.alpha,
    power: float = DEFAULTS.power,
    buffer: float = DEFAULTS.buffer,
) -> SampleSize:
    """Rows per arm to detect a relative drop of a rate, with a safety buffer."""
    for name, value in (
        ("baseline_rate", baseline_rate),
        ("mde_relative", mde_relative),
        ("alpha", alpha),
        ("power", power),
    ):
        if not 0 < value < 1:
            raise ValueError(f"{name} must be between 0 and 1")
    if buffer < 0:
        raise ValueError("buffer cannot be negative")
    treated = baseline_rate * (1 - mde_relative)
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    spread = baseline_rate * (1 - baseline_rate) + treated * (1 - treated)
    n = int(z**2 * spread / (baseline_rate - treated) ** 2 * (1 + buffer)) + 1
    return SampleSize(
        n, 2 * n, baseline_rate - treated, mde_relative, power, alpha, baseline_rate, treated
    )


def sample_size(
    rate: Column,
    mde: Column,
    alpha: float = DEFAULTS.alpha,
    power: float = DEFAULTS.power,
    buffer: float = DEFAULTS.buffer,
) -> Column:
    """Rows per arm as an expression; NULL where the rate is not strictly between 0 and 1."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    treated = rate * (F.lit(1.0) - mde)
    spread = rate * (F.lit(1.0) - rate) + treated * (F.lit(1.0) - treated)
    gap = rate - treated
    needed = F.lit(z * z) * spread / (gap * gap)
    return F.when(
        (rate > 0) & (rate < 1), F.floor(needed * F.lit(1.0 + buffer)) + F.lit(1)
    )


def sample_size_by_stratum(
    df: DataFrame, strata: Sequence[str], label: str, effects: Sequence[float]
) -> DataFrame:
    """Baseline rate per stratum and the rows needed for each effect size."""
    rates = df.groupBy(*strata).agg(F.avg(label).alias("baseline_rate"))
    grid = rates.withColumn("mde_relative", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
    n = sample_size(F.col("baseline_rate"), F.col("mde_relative"))
    return grid.withColumn("n_per_group", n).withColumn(
        "total_required", F.col("n_per_group") * 2
    )


def assign_groups(
    df: DataFrame,
    ratio: float = DEFAULTS.treatment_ratio,
    seed: int = DEFAULTS.assignment_seed,
    key: str = "customer_id",
) -> DataFrame:
    """Add ``assignment`` from a hash of the key; the same seed gives the same arms."""
    if not 0 < ratio < 1:
        raise ValueError("treatment ratio must be between 0 and 1")
    if key not in df.columns:
        raise ValueError(f"column not found: {key}")
    treated = hash_fraction(F.col(key), seed) < F.lit(float(ratio))
    return df.withColumn("assignment", F.when(treated, TREATMENT).otherwise(CONTROL))


def strata_balance(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows and treatment share per stratum; NULL strata are kept."""
    treated = (F.col("assignment") == TREATMENT).cast("int")
    return df.groupBy(*strata).agg(
        F.count("*").alias("n"), F.round(F.avg(treated), 6).alias("treatment_ratio")
    )


def srm_check(df: DataFrame, ratio: float = 0.5, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Chi-square of the arm sizes against the planned ratio."""
    arms = df.agg(
        F.count_if(F.col("assignment") == CONTROL).alias("n_control"),
        F.count_if(F.col("assignment") == TREATMENT).alias("n_treatment"),
    )
    total = F.col("n_control") + F.col("n_treatment")
    chi = F.lit(0.0)
    for arm, share in (("n_control", 1 - ratio), ("n_treatment", ratio)):
        gap = F.col(arm) - total * share
        chi = chi + gap * gap / (total * share)
    limit = normal_quantile(1 - alpha / 2) ** 2
    return arms.withColumn("chi_square", chi).withColumn(
        "mismatch", F.col("chi_square") > limit
    )


# ---------- tests ----------


def arm_stats(df: DataFrame, metric: str) -> DataFrame:
    """Rows, mean and sample variance per arm."""
    return df.groupBy("assignment").agg(
        F.count(metric).alias("n"),
        F.sum(F.col(metric).cast("double")).alias("total"),
        F.avg(metric).alias("mean"),
        F.var_samp(metric).alias("variance"),
    )


def two_arms(df: DataFrame, metric: str) -> DataFrame:
    """One row with n, mean and variance of control (1) and treatment (2)."""
    aggs = []
    for i, arm in ((1, CONTROL), (2, TREATMENT)):
        value = F.when(F.col("assignment") == arm, F.col(metric).cast("double"))
        aggs += [
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.var_samp(value).alias(f"var{i}"),
        ]
    return df.agg(*aggs)


def proportions_z(arms: DataFrame, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Pooled z-test of two rates from n1, x1, n2, x2; the interval is for p2 - p1.

    Significance compares the statistic with the critical value, which is the same as
    comparing the p-value with alpha.
    """
    critical = normal_quantile(1 - alpha / 2)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    checked = arms.withColumn(
        "n1", F.when(empty, F.raise_error(F.lit("both groups need a row"))).otherwise(F.col("n1"))
    )
    rates = checked.withColumns({"p1": F.col("x1") / n1, "p2": F.col("x2") / n2})
    p1, p2 = F.col("p1"), F.col("p2")
    pooled = (F.col("x1") + F.col("x2")) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    margin = critical * F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return rates.withColumns(
        {
            "z_stat": F.when(se > 0, (p1 - p2) / se).otherwise(0.0),
            "lift": F.when(p1 > 0, (p2 - p1) / p1).otherwise(float("inf")),
            "ci_low": (p2 - p1) - margin,
            "ci_high": (p2 - p1) + margin,
        }
    ).withColumn("significant", F.abs("z_stat") > critical)


def churn_counts(df: DataFrame, label: str = "churn") -> DataFrame:
    control, treated = F.col("assignment") == CONTROL, F.col("assignment") == TREATMENT
    y = F.col(label).cast("bigint")
    return df.agg(
        F.count_if(control).alias("n1"),
        F.coalesce(F.sum(F.when(control, y)), F.lit(0)).alias("x1"),
        F.count_if(treated).alias("n2"),
        F.coalesce(F.sum(F.when(treated, y)), F.lit(0)).alias("x2"),
    )


def proportions_z_test(
    df: DataFrame, label: str = "churn", alpha: float = DEFAULTS.alpha
) -> DataFrame:
    cols = ("p1", "p2", "lift", "z_stat", "ci_low", "ci_high", "significant")
    return proportions_z(churn_counts(df, label), alpha).select(*cols)


def welch(arms: DataFrame) -> DataFrame:
    """Difference of means, t and degrees of freedom from the row of ``two_arms``."""
    n1, n2 = F.col("n1"), F.col("n2")
    few = (n1 < 2) | (n2 < 2)
    checked = arms.withColumn(
        "n1", F.when(few, F.raise_error(F.lit("each group needs two rows"))).otherwise(n1)
    )
    a, b = F.col("var1") / n1, F.col("var2") / n2
    se = F.sqrt(a + b)
    df = (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    diff = F.col("mean2") - F.col("mean1")
    return checked.withColumns(
        {
            "mean_diff": diff,
            "std_error": se,
            "t_stat": F.when(se > 0, diff / se).otherwise(0.0),
            "df": F.when(se > 0, df).otherwise((n1 + n2 - 2).cast("double")),
        }
    )


def welch_test(df: DataFrame, metric: str, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Welch test of a metric between the arms, with p-value and interval."""
    row = welch(two_arms(df, metric))
    flat = F.col("std_error") == 0
    p = F.when(flat, 1.0).otherwise(student_two_sided_p(F.col("t_stat"), F.col("df")))
    margin = student_quantile(1 - alpha / 2, F.col("df")) * F.col("std_error")
    return row.select(
        "mean_diff",
        "t_stat",
        "df",
        p.alias("p_value"),
        (F.col("mean_diff") - margin).alias("ci_low"),
        (F.col("mean_diff") + margin).alias("ci_high"),
    ).withColumn("significant", F.col("p_value") < alpha)


# ---------- variance reduction ----------


def _complete(y: str, x: str, group: str) -> Column:
    return F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(group).isNotNull()


def cuped_stats(df: DataFrame, y: str, x: str, group: str = "assignment") -> DataFrame:
    """Pooled slope and covariate mean over complete rows; slope 0 where it is undefined."""
    rows = df.where(_complete(y, x, group))
    slope = F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double"))
    theta = F.when((F.count("*") < 2) | slope.isNull() | F.isnan(slope), 0.0).otherwise(slope)
    return rows.agg(
        theta.alias("theta"), F.avg(x).alias("x_mean"), F.count("*").alias("n")
    )


def apply_cuped(df: DataFrame, y: str, x: str, group: str = "assignment") -> DataFrame:
    """Add ``adjusted``; NULL where the outcome, covariate or arm is missing."""
    stats = cuped_stats(df, y, x, group).select(F.struct("theta", "x_mean")).scalar()
    shifted = F.col(y) - F.col("_s.theta") * (F.col(x) - F.col("_s.x_mean"))
    return (
        df.withColumn("_s", stats)
        .withColumn("adjusted", F.when(_complete(y, x, group), shifted))
        .drop("_s")
    )


def variance_reduction(df: DataFrame, y: str, x: str, group: str = "assignment") -> DataFrame:
    """Share of the outcome variance removed, between 0 and 1."""
    rows = apply_cuped(df, y, x, group).where(_complete(y, x, group))
    raw, adjusted = F.var_samp(y), F.var_samp("adjusted")
    gain = F.least(F.greatest(1 - F.try_divide(adjusted, raw), F.lit(0.0)), F.lit(1.0))
    value = F.when((F.count("*") < 2) | (raw <= 0), 0.0).otherwise(gain)
    return rows.agg(value.alias("variance_reduction"))


# ---------- sequential looks and report ----------


def obrien_fleming_boundary(fraction: float, alpha: float = DEFAULTS.alpha) -> float:
    if not 0 < fraction <= 1:
        raise ValueError("information fraction must be in (0, 1]")
    return normal_quantile(1 - alpha / 2) / math.sqrt(fraction)


def sequential_looks(
    df: DataFrame, first_return_look: str, looks: int, alpha: float = DEFAULTS.alpha
) -> DataFrame:
    """z statistic of not having returned by each look, against its boundary.

    ``first_return_look`` is the 1-based look by which a customer came back, NULL if never.
    All looks come from one aggregate per arm.
    """
    back = F.col(first_return_look)
    aggs = []
    for i, arm in ((1, CONTROL), (2, TREATMENT)):
        inside = F.col("assignment") == arm
        aggs.append(F.count_if(inside).alias(f"n{i}"))
        aggs += [
            F.count_if(inside & (back.isNull() | (back > k))).alias(f"x{i}_{k}")
            for k in range(1, looks + 1)
        ]
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("look"),
                F.lit(k / looks).alias("information_fraction"),
                F.lit(obrien_fleming_boundary(k / looks, alpha)).alias("boundary"),
                F.col(f"x1_{k}").alias("x1"),
                F.col(f"x2_{k}").alias("x2"),
            )
            for k in range(1, looks + 1)
        ]
    )
    arms = df.agg(*aggs).select("n1", "n2", F.inline(cells))
    tested = proportions_z(arms, alpha)
    return tested.select(
        "look",
        "information_fraction",
        "boundary",
        "p1",
        "p2",
        "z_stat",
        (F.abs("z_stat") > F.col("boundary")).alias("crossed"),
    )


def analyze_experiment(df: DataFrame, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """One row: churn test, net-revenue test on adjusted values, decision.

    Needs ``assignment`` and ``churn``; ``revenue``, ``pre_revenue`` and ``discount_cost``
    are optional.
    """
    missing = {"assignment", "churn"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    churn = proportions_z_test(df, "churn", alpha)
    counts = df.agg(
        F.count_if(F.col("assignment") == CONTROL).alias("n_control"),
        F.count_if(F.col("assignment") == TREATMENT).alias("n_treatment"),
    )
    report = counts.withColumn("c", churn.select(F.struct(*churn.columns)).scalar())
    wins = F.col("c.significant") & (F.col("c.p2") < F.col("c.p1"))
    if "revenue" in df.columns:
        cost = F.col("discount_cost") if "discount_cost" in df.columns else F.lit(0.0)
        net = df.withColumn("net", F.col("revenue") - cost)
        if "pre_revenue" in df.columns:
            net = apply_cuped(net, "net", "pre_revenue")
            net = net.withColumn("value", F.coalesce("adjusted", "net"))
        else:
            net = net.withColumn("value", F.col("net"))
        test = welch(two_arms(net, "value"))
        raw = two_arms(net, "net").select(F.struct("mean1", "mean2"))
        report = report.withColumn(
            "r", test.select(F.struct("mean_diff", "t_stat", "df")).scalar()
        ).withColumn("m", raw.scalar())
        lift = F.when(
            F.col("m.mean1") > 0, (F.col("m.mean2") - F.col("m.mean1")) / F.col("m.mean1")
        ).otherwise(float("inf"))
        extra = [
            F.col("r.mean_diff").alias("net_mean_diff"),
            F.col("r.t_stat").alias("net_t_stat"),
            F.col("r.df").alias("net_df"),
            lift.alias("net_lift"),
        ]
        erodes = F.coalesce(F.col("r.mean_diff") < 0, F.lit(False))
    else:
        extra, erodes = [], F.lit(False)
    decision = F.when(wins & ~erodes, "LAUNCH").when(wins & erodes, "OPTIMIZE").otherwise("HOLD")
    return report.select(
        "n_control", "n_treatment", "c.*", *extra, decision.alias("decision")
    )


def with_p_values(report: DataFrame) -> DataFrame:
    """Add the p-values of an experiment report, computed on its one row."""
    out = report.withColumn("p_value", normal_two_sided_p(F.col("z_stat")))
    if "net_t_stat" in report.columns:
        out = out.withColumn("net_p_value", student_two_sided_p(F.col("net_t_stat"), F.col("net_df")))
    return out
