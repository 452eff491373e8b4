from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning
from tidemark.operators import preprocessing as pp
from tidemark.operators.synthetic import nearest_rows, synthetic_rows


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 1)
    rows = [(i, int(i < 32), *map(float, v)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "customer_id bigint, churn int, a double, b double, c double").repartition(3)


@pytest.mark.parametrize("tile_rows", [7, 4096])
def test_nearest_rows_match_all_pairs(spark, data, tile_rows):
    x, df = data
    points = df.select(F.col("customer_id").alias("row"), F.array("a", "b", "c").alias("x"))
    got: dict = {}
    for r in nearest_rows(points, 3, 4, tile_rows).orderBy("row", "place").collect():
        got.setdefault(r["row"], []).append(r["near"])
    for i in range(300):
        gap = np.zeros(300)
        for d in range(3):
            gap += (x[i, d] - x[:, d]) ** 2
        assert got[i] == [j for j in np.lexsort((np.arange(300), gap)) if j != i][:4]


@pytest.mark.parametrize("tile_rows", [9, 4096])
def test_rows_lie_between_neighbours(spark, data, tile_rows):
    x, df = data
    made = np.array([list(r)[1:] for r in synthetic_rows(df, "churn", "customer_id", ["a", "b", "c"], 5, tile_rows).collect()])
    assert abs(len(made) - (268 - 32)) <= 20
    few = x[:32]
    gap = np.linalg.norm(few[:, None] - few, axis=2)
    near = {(i, int(j)) for i in range(32) for j in np.flatnonzero(gap[i] <= np.sort(gap[i])[5] + 1e-9) if j != i}
    for z in made:
        on = []
        for i, j in near:
            step = few[j] - few[i]
            along = (z - few[i]) @ step / max(step @ step, 1e-30)
            on.append(np.abs(few[i] + along * step - z).max() < 1e-9 and -1e-9 <= along <= 1 + 1e-9)
        assert any(on)
    again = synthetic_rows(df.repartition(5), "churn", "customer_id", ["a", "b", "c"], 5, tile_rows)
    assert sorted(map(tuple, made.tolist())) == sorted(tuple(r)[1:] for r in again.collect())


def test_classes_that_give_no_rows(spark, data):
    _, df = data
    for frame in (df.where("churn = 0"), df.where("customer_id >= 31"), df.where("false"), df.where("customer_id < 64")):
        assert synthetic_rows(frame, "churn", "customer_id", ["a", "b", "c"]).count() == 0


def test_folds_learn_from_their_training_part_alone(spark, data, monkeypatch):
    _, df = data
    seen = []

    def watched(real, label, key, columns):
        seen.append({r[0] for r in real.select(key).collect()})
        return synthetic_rows(real, label, key, columns)

    monkeypatch.setattr(learning, "synthetic_rows", watched)
    oof = learning.out_of_fold(df, ["logistic"], folds=2)
    parts = {f: {r[0] for r in oof.where(F.col("fold") == f).select("customer_id").collect()} for f in (0, 1)}
    assert len(seen) == 2 and seen[0] == parts[1] and seen[1] == parts[0]
    assert oof.count() == 300


def test_oversampling_without_a_minority(spark, data):
    _, df = data
    assert pp.oversample(df.where("churn = 0"), "churn", "customer_id").count() == 268
