from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.special import normal_two_sided_p, student_quantile, student_two_sided_p
from tidemark.operators import drift
from tidemark.operators import experiments as ex


def test_sample_size():
    size = ex.sample_size_proportions(0.20, 0.20)
    assert 1500 < size.n_per_group < 2000 and size.total_required == 2 * size.n_per_group
    assert 1443 <= ex.sample_size_proportions(0.20, 0.20, buffer=0).n_per_group <= 1450
    assert abs(ex.sample_size_proportions(0.20, 0.15, buffer=0).n_per_group - 2580) < 60
    for bad in ({"baseline_rate": 0}, {"mde_relative": 1}, {"alpha": 0}, {"power": 1}, {"buffer": -1}):
        with pytest.raises(ValueError):
            ex.sample_size_proportions(**({"baseline_rate": 0.2, "mde_relative": 0.2} | bad))


def test_sample_size_column_agrees(spark):
    df = spark.createDataFrame([(0.2, 0.2), (0.0, 0.2), (0.37, 0.1)], "r double, d double")
    got = [r[0] for r in df.select(ex.sample_size(F.col("r"), F.col("d"))).collect()]
    assert got == [
        ex.sample_size_proportions(0.2, 0.2).n_per_group,
        None,
        ex.sample_size_proportions(0.37, 0.1).n_per_group,
    ]


def test_assignment(spark):
    df = spark.createDataFrame([(f"C{i}",) for i in range(200)], "customer_id string")
    arms = {r[0]: r[1] for r in ex.assign_groups(df).collect()}
    assert arms == {r[0]: r[1] for r in ex.assign_groups(df.repartition(7)).collect()}
    assert arms["C0"] == "control"
    assert arms != {r[0]: r[1] for r in ex.assign_groups(df, seed=7).collect()}
    share = ex.assign_groups(df, 0.3).where("assignment = 'treatment'").count() / 200
    assert 0.2 <= share <= 0.4
    for bad in (1.5, 0):
        with pytest.raises(ValueError):
            ex.assign_groups(df, bad)
    with pytest.raises(ValueError):
        ex.assign_groups(df, key="nope")


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_student_and_normal_tails(spark):
    def p(t, df):
        return value(spark, student_two_sided_p(F.lit(float(t)), F.lit(float(df))))

    t = 1.7
    assert p(1.0, 1) == pytest.approx(0.5, rel=1e-12) and p(0, 3) == 1.0
    assert p(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-12)
    # Closed forms in the far tail, and the normal limit.
    assert p(1e6, 1) == pytest.approx(2 / math.pi * math.atan(1e-6), rel=1e-10)
    assert p(1e4, 2) == pytest.approx(1e-8 * (1 - 1.5e-8), rel=1e-7)
    for z in (1e-3, 0.5, 2.0, 6.0, 30.0):
        assert value(spark, normal_two_sided_p(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-12)
        assert p(z, 1e12) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-8)
    # P for four degrees of freedom: x = t / sqrt(4 + t^2), 1 - x (3 - x^2) / 2.
    for t in (0.1, 1.0, 3.0, 8.0):
        x = t / math.sqrt(4 + t * t)
        assert p(t, 4) == pytest.approx(1 - x * (3 - x * x) / 2, rel=1e-9)


def test_student_quantiles(spark):
    def q(p, df):
        return value(spark, student_quantile(p, F.lit(float(df))))

    assert q(0.975, 1e7) == pytest.approx(1.959964, abs=1e-5)
    assert q(0.975, 1) == pytest.approx(math.tan(math.pi * 0.475), rel=1e-10)
    assert q(0.9999, 2) == pytest.approx(2 * 0.4999 * math.sqrt(2 / (1 - 4 * 0.4999**2)), rel=1e-9)
    for df in (1.3, 8.5, 400.0, 123456.0):
        assert value(spark, student_two_sided_p(student_quantile(0.975, F.lit(df)), F.lit(df))) == pytest.approx(0.05, rel=1e-9)



def outcome_frame(spark, control, treatment, n=2500):
    rows = [
        (arm, int(i < n * rate), 0.0 if i < n * rate else 300.0, float(i % 7), 0.0)
        for arm, rate in (("control", control), ("treatment", treatment))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "assignment string, churn int, revenue double, pre_revenue double, discount_cost double"
    )


def test_decisions(spark):
    win = outcome_frame(spark, 0.5, 0.3)
    report = ex.with_p_values(ex.analyze_experiment(win)).first()
    assert report["decision"] == "LAUNCH" and report["z_stat"] > 0 and report["lift"] == pytest.approx(-0.4)
    assert report["p_value"] < 1e-6 and report["net_p_value"] < 1e-6
    costly = win.withColumn("discount_cost", F.when(F.col("assignment") == "treatment", 500.0).otherwise(0.0))
    assert ex.analyze_experiment(costly).first()["decision"] == "OPTIMIZE"
    flat = outcome_frame(spark, 0.4, 0.4)
    assert ex.analyze_experiment(flat).first()["decision"] == "HOLD"
    bare = ex.analyze_experiment(win.select("assignment", "churn")).first()
    assert bare["decision"] == "LAUNCH"
    with pytest.raises(ValueError):
        ex.analyze_experiment(win.drop("churn"))


def test_empty_arm_fails(spark):
    df = outcome_frame(spark, 0.5, 0.3, 50).where("assignment = 'control'")
    with pytest.raises(Exception, match="both groups"):
        ex.proportions_z_test(df).collect()


def test_welch_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(10, 2, 80), rng.normal(11, 3, 60)
    rows = [("control", float(x)) for x in a] + [("treatment", float(x)) for x in b]
    row = ex.welch_test(spark.createDataFrame(rows, "assignment string, v double"), "v").first()
    va, vb = a.var(ddof=1) / 80, b.var(ddof=1) / 60
    assert row["t_stat"] == pytest.approx((b.mean() - a.mean()) / math.sqrt(va + vb))
    assert row["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 79 + vb**2 / 59))
    assert row["ci_low"] < row["mean_diff"] < row["ci_high"]
    same = spark.createDataFrame([("control", 1.0)] * 3 + [("treatment", 1.0)] * 3, "assignment string, v double")
    flat = ex.welch_test(same, "v").first()
    assert (flat["t_stat"], flat["p_value"], flat["df"]) == (0.0, 1.0, 4.0)


def test_cuped(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 2000)
    y = 0.5 * x + rng.normal(0, 0.3, 2000)
    rows = [(float(a), float(b), "control" if i % 2 else "treatment") for i, (a, b) in enumerate(zip(y, x))]
    rows.append((1.0, None, "control"))
    df = spark.createDataFrame(rows, "y double, x double, assignment string")
    assert ex.cuped_stats(df, "y", "x").first()["theta"] == pytest.approx(0.5, abs=0.05)
    assert ex.variance_reduction(df, "y", "x").first()[0] > 0.2
    assert ex.apply_cuped(df, "y", "x").where("adjusted IS NULL").count() == 1
    constant = df.withColumn("x", F.lit(3.0))
    assert ex.cuped_stats(constant, "y", "x").first()["theta"] == 0.0


def test_boundary():
    assert ex.obrien_fleming_boundary(1.0) == pytest.approx(1.96, abs=0.01)
    assert ex.obrien_fleming_boundary(0.25) > ex.obrien_fleming_boundary(0.5)
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            ex.obrien_fleming_boundary(bad)


def test_balance_keeps_null_strata(spark):
    df = spark.createDataFrame([("TR", "control"), (None, "treatment"), (None, "control")], "country string, assignment string")
    got = {r["country"]: (r["n"], r["treatment_ratio"]) for r in ex.strata_balance(df, ["country"]).collect()}
    assert got == {"TR": (1, 0.0), None: (2, 0.5)}


def numbers(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


@pytest.mark.parametrize("limit", [100, 50_000])
def test_psi_against_numpy(spark, limit):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(0, 1, 4000), 3), np.round(rng.normal(0.4, 1, 3000), 3)
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    e, c = (np.clip(np.histogram(v, edges)[0] / len(v), 1e-6, None) for v in (a, b))
    got = drift.psi_scores(numbers(spark, a), numbers(spark, b), limit=limit).first()["psi"]
    assert got == pytest.approx(float(((c - e) * np.log(c / e)).sum()))


def test_drift_flags(spark):
    rng = np.random.default_rng(4)
    base, near, far = (numbers(spark, rng.normal(m, 1, 3000)) for m in (0, 0, 3))
    assert drift.detect_data_drift(base, near).first()["max_psi"] < 0.1
    report = drift.detect_data_drift(base, far).first()
    assert report["drift_detected"] and report["drifted_features"] == ["x"]
    scores = numbers(spark, rng.random(3000)).withColumnRenamed("x", "churn_probability")
    stuck = scores.withColumn("churn_probability", F.lit(0.9))
    assert drift.detect_prediction_drift(scores, stuck).first()["drift_detected"]
    assert drift.psi_scores(numbers(spark, [1, 2]), far).first()["psi"] == 0.0


def test_null_text_is_a_category(spark):
    a = spark.createDataFrame([("x",)] * 8 + [(None,)] * 2, "c string")
    b = spark.createDataFrame([("x",)] * 2 + [(None,)] * 8, "c string")
    assert drift.psi_scores(a, b).first()["psi"] == pytest.approx(2 * 0.6 * math.log(4))


def test_concept_drift_and_retrain(spark):
    df = spark.createDataFrame([(0.70, 0.50), (0.70, 0.68)], "reference_metric double, current_metric double")
    flags = [r["drift_detected"] for r in drift.concept_drift(df).orderBy("current_metric").collect()]
    assert flags == [True, False]
    calm = drift.concept_drift(df.where("current_metric > 0.6"))
    assert not drift.retrain_signal(calm).first()[0]
    assert drift.retrain_signal(calm, drift.concept_drift(df)).first()[0]


def test_check_and_retrain(spark):
    rng = random.Random(1)
    a = numbers(spark, [rng.gauss(0, 1) for _ in range(500)])
    b = numbers(spark, [rng.gauss(4, 1) for _ in range(500)])
    assert drift.check_and_retrain(a, b, lambda d: "m")["retrain_skipped"]
    assert drift.check_and_retrain(a, b, lambda d: "m", dry_run=False)["model"] == "m"
    assert drift.check_and_retrain(a, a, lambda d: "m", dry_run=False)["retrained"] is False
