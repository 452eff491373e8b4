from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import campaigns, quality, reports, scoring
from tidemark.params import JobParams


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(
        [("1", "TR", 0, 1, 0, "2024-01-01", None), ("2", "DE", 2, 0, 1, None, 4.0), ("1", "TR", 1, 0, 0, "2024-01-02", 3.0)],
        "customer_id string, country string, total_orders long, has_abandoned_cart long, is_repeat_customer long, "
        "signup_date string, avg_rating_given double",
    )


def test_quality_report(dirty):
    row = quality.quality_report(dirty).first()
    assert (row["total_rows"], row["unique_customers"], row["duplicated_customer_ids"]) == (3, 2, 1)
    assert (row["no_purchase_count"], row["abandoned_cart_count"], row["repeat_customer_count"]) == (1, 1, 1)
    assert row["invalid_dates"] == 1
    assert row["issues"] == [
        "1 duplicate customer_id",
        "Missing values: {'signup_date': 1, 'avg_rating_given': 1}",
        "1 rows with invalid signup_date",
    ]


def test_clean_frame_has_no_issues(dirty):
    clean = dirty.where("avg_rating_given = 4").withColumn("signup_date", F.lit("2024-01-01"))
    assert quality.quality_report(clean).first()["issues"] == []
    assert quality.missing_values(clean).count() == 0


def test_null_keys_count_as_one(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "customer_id string")
    assert quality.quality_report(df).first()["duplicated_customer_ids"] == 1


def test_constraints_find_failures(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b")], "k int, v string")
    got = quality.constraint_tests({"m": df}, {"m": ["k", "v"]}, {"m": ["k"]})
    assert {(r["column"], r["test"]): r["failures"] for r in got.collect()} == {
        ("k", "not_null"): 1,
        ("v", "not_null"): 1,
        ("k", "unique"): 1,
    }


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(50).selectExpr("id", "cast(id * 2 AS string) AS v")
    same = quality.table_fingerprint(df.orderBy(F.desc("id"))).first()
    assert quality.table_fingerprint(df).first() == same
    changed = df.withColumn("v", F.when(F.col("id") == 7, "x").otherwise(F.col("v")))
    assert quality.table_fingerprint(changed).first()["checksum"] != same["checksum"]


def test_tier_boundaries(spark):
    df = spark.createDataFrame([(p,) for p in (0.05, 0.4, 0.45, 0.6, 0.7, 0.75, 0.9, 1.5)], "churn_probability double")
    got = [r["risk_tier"] for r in scoring.with_tier(df).orderBy("churn_probability").collect()]
    assert got == ["low", "low", "medium", "medium", "medium", "high", "high", None]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [("C1", 0.9, "high"), ("C2", 0.8, "high"), ("C3", 0.5, "medium"), ("C4", 0.2, "low")]
    return spark.createDataFrame(rows, "customer_id string, churn_probability double, risk_tier string")


def test_coupons(scores):
    sent = campaigns.coupon_campaign(scores, 20, 7)
    report = campaigns.campaign_report(sent, 20, 7).first()
    assert report["sent"] == 2 and len(report["coupon_codes"]) == 2
    text = sent.orderBy("customer_id").first()["content"]
    assert text.startswith("Your exclusive 20% discount coupon: COUPON-") and "(valid for 7 days)" in text
    assert campaigns.coupon_campaign(scores, 20, 7, channel="fax").count() == 0
    for bad in ((40, 7), (0, 7), (20, 0)):
        with pytest.raises(ValueError):
            campaigns.coupon_campaign(scores, *bad)


def test_segments(scores):
    got = {r["risk_tier"]: r["customers"] for r in scoring.risk_segments(scores).collect()}
    assert got == {"high": 2, "medium": 1, "low": 1}
    assert scoring.score_summary(scores).first()["avg_churn_probability"] == 0.6


def test_outbox(spark):
    df = spark.createDataFrame([("C1", "hi")], "customer_id string, content string")
    assert campaigns.outbox(df).count() == 3
    assert [r["channel"] for r in campaigns.outbox(df, ["sms", "fax"]).collect()] == ["sms"]
    assert campaigns.outbox(df, ["fax"]).count() == 0


def test_escalation(spark):
    rows = [
        ("a", 500.0, 0.9, 0, False),
        ("b", 500.0, 0.9, 1, True),
        ("c", 2000.0, 0.5, 0, True),
        ("d", 500.0, 0.9, 0, True),
        ("e", 2000.0, 0.4, 0, True),
        ("f", None, None, None, True),
        ("g", 2000.0, 0.0, 0, True),
    ]
    df = spark.createDataFrame(
        rows,
        "customer_id string, total_spend_usd double, churn_probability double, support_complaints int, guardrail_passed boolean",
    )
    routed = campaigns.route(df)
    got = {r["customer_id"]: (r["escalated"], r["priority"]) for r in routed.collect()}
    assert got == {
        "a": (True, "normal"),
        "b": (True, "high"),
        "c": (True, "normal"),
        "d": (False, "normal"),
        "e": (True, "high"),
        "f": (False, "normal"),
        "g": (True, "normal"),
    }
    tasks = campaigns.crm_tasks(
        routed.withColumns({"guardrail_reasons": F.array().cast("array<string>"), "risk_reason": F.lit("r"), "context": F.lit("c")})
    )
    task = tasks.where("task_id = 'CRM-b'").first()
    assert task["status"] == "open" and task["priority"] == "high"
    assert "Reason: High LTV + low confidence (human approval required)" in task["summary"]


def test_distributions_keep_the_top_values(spark):
    rows = [(str(i % 9) if i % 10 else None, 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "country string, churn_probability double")
    got = reports.segment_distributions(df, ["country"], top=3).collect()
    assert len(got) == 3 and {r["position"] for r in got} == {1, 2, 3}
    assert max(r["count"] for r in got) == next(r["count"] for r in got if r["position"] == 1)


def test_customer_view_without_scores_or_outputs(spark):
    from tidemark.sources.csv_profiles import PROFILE_SCHEMA

    row = {f.name: None for f in PROFILE_SCHEMA.fields} | {
        "customer_id": 5, "country": "TR", "age": 30, "age_group": "25-34", "clv_tier": "low", "total_orders": 1,
        "total_spend_usd": 1234567.5, "total_sessions": 2, "has_abandoned_cart": 0, "is_repeat_customer": 0,
    }
    df = spark.createDataFrame([tuple(row.values())], PROFILE_SCHEMA)
    got = reports.customer_360(df).first()
    assert got["risk_tier"] == "low" and got["churn_probability"] == 0.0 and got["segment"] == ""
    assert "total spend 1,234,568;" in got["context"]
    assert got["risk_explanation"].endswith("(0%). Standard retention is sufficient.")


def test_params():
    params = JobParams.from_mapping({"alpha": 0.01, "unknown": 1}, {"trigger_events": ["a"], "ltv": None})
    assert params.alpha == 0.01 and params.trigger_events == ("a",) and params.ltv == 500.0
