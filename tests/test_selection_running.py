"""Order statistics and running totals against brute force, with limits forced low."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import running as rn
from tidemark.operators import selection as sel


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        hot = 7.0 if i % 3 == 0 else rng.gauss(10, 4)
        rows.append((i, hot, rng.choice([1.0, 2.0, 3.0]), None if i % 5 == 0 else rng.random()))
    return rows, spark.createDataFrame(rows, "id bigint, a double, b double, c double").repartition(4).cache()


@pytest.mark.parametrize("limit", [50, 100_000])
def test_quantiles(numbers, limit):
    rows, df = numbers
    probs = [0.0, 0.1, 0.25, 0.33, 0.5, 0.9, 1.0]
    got = sel.exact_quantiles(df, {c: F.col(c) for c in "abc"}, probs, limit)
    for k, c in enumerate("abc", start=1):
        values = [r[k] for r in rows if r[k] is not None]
        assert got[c] == pytest.approx(np.quantile(values, probs), abs=1e-12)


@pytest.mark.parametrize("limit", [40, 100_000])
def test_key_cuts(numbers, limit):
    rows, df = numbers
    order = sorted((r[1], r[0]) for r in rows)
    spots = [0, 399, 1500, 2000, 3999]
    cuts = sel.key_cuts(df, {"a": F.col("a")}, F.col("id"), lambda n: spots, limit)["a"]
    assert [cuts[s] for s in spots] == [order[s] for s in spots]


def test_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert sel.exact_quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": []}


@pytest.mark.parametrize("slice_rows", [100, 1_000_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(numbers, slice_rows, descending):
    rows, df = numbers
    got = rn.running_totals(df, "id", {"t": F.col("b")}, descending, slice_rows=slice_rows)
    seen = {r["id"]: r["t"] for r in got.collect()}
    total, expected = 0.0, {}
    for row in sorted(rows, reverse=descending):
        total += row[2]
        expected[row[0]] = total
    assert seen == expected


@pytest.mark.parametrize("slice_rows", [150, 1_000_000])
@pytest.mark.parametrize("before", [False, True])
def test_running_by_key_with_a_hot_key(spark, slice_rows, before):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 60), i, i * 60, rng.choice([None, 1.0, 2.0])) for i in range(2500)]
    df = spark.createDataFrame(rows, "k int, id bigint, s bigint, v double").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    got = rn.running_by_key(
        df, "k", ["ts", "id"], {"n": F.lit(1)}, {"last": F.col("v")}, slice_rows, before
    )
    seen = {r["id"]: (r["n"], r["last"]) for r in got.collect()}
    counts, lasts, expected = {}, {}, {}
    for k, i, _, v in rows:
        if before:
            expected[i] = (counts.get(k), lasts.get(k))
        counts[k] = counts.get(k, 0) + 1
        lasts[k] = v if v is not None else lasts.get(k)
        if not before:
            expected[i] = (counts[k], lasts[k])
    assert seen == expected


@pytest.mark.parametrize("slice_rows", [200, 1_000_000])
def test_hot_keys_of_different_spans_and_equal_times(spark, slice_rows):
    """A key within a second, one over years, one of equal times told apart by id, and a null key."""
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        k = rng.choice([1, 1, 2, 2, 3, 3, None, rng.randrange(10, 90)])
        at = {1: i * 1e-6, 2: i * 90_000.0, 3: 5.0}.get(k, rng.random() * 1e6)
        rows.append((k, i, at, rng.choice([None, 1.0, 2.0]), {} if i % 2 else None))
    df = spark.createDataFrame([r[:4] for r in rows], "k int, id bigint, s double, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = rn.running_by_key(df.repartition(5), "k", ["ts", "id"], {"n": F.lit(1)}, {"last": F.col("v")}, slice_rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
    seen = {r["id"]: (r["n"], r["last"]) for r in got.collect()}
    counts, lasts, expected = {}, {}, {}
    for k, i, at, v, _ in sorted(rows, key=lambda r: (round(r[2], 6), r[1])):
        counts[k] = counts.get(k, 0) + 1
        lasts[k] = v if v is not None else lasts.get(k)
        expected[i] = (counts[k], lasts[k])
    assert seen == expected
