from __future__ import annotations

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import learning
from tidemark.operators.tree_contributions import Leaf, base_value, contributions, ensemble_leaves, leaf_contributions, with_contributions


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        x1, x2, x3 = rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4))
        rows.append((i, x1, x2 if i % 9 else None, x3, rng.choice(["TR", "DE", None]), int(x1 * x2 + x3 / 2 + rng.gauss(0, 0.4) > 1)))
    return spark.createDataFrame(rows, "customer_id bigint, x1 double, x2 double, x3 double, country string, churn int").cache()


def worth(leaves, x, known):
    """Mean score of a row of which only the inputs in ``known`` count, by the shares of the paths."""
    total = 0.0
    for leaf in leaves:
        part = leaf.value
        for i, (low, high), share in zip(leaf.inputs, leaf.bounds, leaf.shares, strict=True):
            part *= float(low < x[i] <= high) if i in known else share
        total += part
    return total


def shapley(leaves, x):
    size = len(x)
    out = np.zeros(size)
    for i in range(size):
        others = [j for j in range(size) if j != i]
        for s in range(size):
            for known in combinations(others, s):
                weight = factorial(s) * factorial(size - s - 1) / factorial(size)
                out[i] += weight * (worth(leaves, x, {*known, i}) - worth(leaves, x, {*known}))
    return out


def test_against_all_coalitions():
    rng = np.random.default_rng(0)
    leaves = []
    for _ in range(12):
        inputs = np.sort(rng.choice(5, rng.integers(0, 5), replace=False))
        bounds = np.sort(rng.normal(size=(len(inputs), 2)) * 2, axis=1)
        leaves.append(Leaf(rng.normal(), inputs, bounds, rng.random(len(inputs))))
    x = rng.normal(size=(7, 5))
    got = contributions(leaves, x)
    for row, found in zip(x, got, strict=True):
        assert found == pytest.approx(shapley(leaves, row), abs=1e-12)
        assert base_value(leaves) + found.sum() == pytest.approx(worth(leaves, row, set(range(5))))
    assert contributions(leaves, x[:0]).shape == (0, 5)


def test_one_input_takes_all():
    assert leaf_contributions(np.array([[1.0], [0.0]]), np.array([0.25])).tolist() == [[0.75], [-0.25]]


@pytest.mark.parametrize("kind", ["gbt", "random_forest"])
def test_contributions_add_up_to_the_score(spark, frame, kind):
    model = learning.fit_pipeline(frame, kind, {"maxIter": 5} if kind == "gbt" else {"numTrees": 7})
    found = with_contributions(model, frame.where("customer_id % 2 = 0").unionByName(frame.limit(1)), "customer_id")
    inputs = found.columns[2:]
    assert inputs == list(model.stages[-2].getInputCols())
    score = vector_to_array(F.col("rawPrediction" if kind == "gbt" else "probability"))[1]
    wanted = {r[0]: r[1] for r in model.transform(frame).select("customer_id", score).collect()}
    rows = found.collect()
    assert len(rows) == 151
    for r in rows:
        assert r["base"] + sum(r[c] for c in inputs) == pytest.approx(wanted[r["customer_id"]], abs=1e-9)


def test_leaves_cover_all_rows(spark, frame):
    model = learning.fit_pipeline(frame, "gbt", {"maxIter": 2})
    leaves = ensemble_leaves(model.stages[-1])
    assert sum(leaf.shares.prod() for leaf in leaves) == pytest.approx(2.0)
    got = {r["feature"]: r["mean_abs_contribution"] for r in learning.model_importance(model, frame).collect()}
    assert got["x_country"] < got["x_x1"] and all(v >= 0 for v in got.values())
