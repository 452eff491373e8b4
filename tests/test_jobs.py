from __future__ import annotations

import os

import pytest

from tidemark import jobs
from tidemark.operators.features import FEATURE_INPUTS
from tidemark.plans.experiment_queries import outcomes
from tidemark.sources.profiles import profiles

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_jobs_from_profiles_to_scores(spark, tmp_path):
    people = profiles(spark, SF_DIR, columns=FEATURE_INPUTS)
    jobs.quality_job(people, str(tmp_path / "quality"))
    assert spark.read.json(str(tmp_path / "quality")).first()["total_rows"] == people.count()
    paths = jobs.features_job(people, str(tmp_path / "data"))
    quick = {"random_forest": {"numTrees": 5, "maxDepth": 3, "seed": 1}}
    out = str(tmp_path / "model")
    result = jobs.train_job(
        spark, paths["training_set"], out, ("logistic", "random_forest"), quick, folds=2
    )
    jobs.score_job(spark, out, paths["features"], str(tmp_path / "scores"))
    scores = spark.read.parquet(str(tmp_path / "scores"))
    assert scores.columns == ["customer_id", "churn_probability", "risk_tier"]
    assert scores.count() == people.count()
    again = result.ensemble.transform(spark.read.parquet(paths["features"])).select("customer_id", "churn_probability")
    both = scores.join(again.withColumnRenamed("churn_probability", "p"), "customer_id")
    assert both.where("abs(churn_probability - p) > 1e-9").count() == 0
    assert spark.read.parquet(f"{out}/runs").first()["metrics"]["roc_auc"] > 0.5
    assert spark.read.option("header", True).csv(f"{out}/importances/logistic").count() > 5
    jobs.experiment_job(outcomes(spark, SF_DIR), str(tmp_path / "ab"))
    assert spark.read.json(str(tmp_path / "ab")).first()["decision"] in ("LAUNCH", "HOLD", "OPTIMIZE")
