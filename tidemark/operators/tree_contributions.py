"""What each input adds to the score of a fitted tree ensemble, row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path


@dataclass(frozen=True)
class Leaf:
    """A leaf's value and, for each input on its path, what a row must meet and the share of rows that does.

    ``bounds`` has a lower (excluded) and an upper bound for each of ``inputs``, over all splits of that input;
    ``shares`` the product of the fractions of training rows that went this way at those splits.
    """

    value: float
    inputs: np.ndarray
    bounds: np.ndarray
    shares: np.ndarray


def ensemble_leaves(model) -> list[Leaf]:
    """All leaves of a fitted MLlib ensemble (boosted trees: of the margin, forests: of the probability of class 1).

    The nodes are read from the model as its writer stores it, in the shared folder.
    """
    session = SparkSession.getActiveSession()
    path = scratch_path(session, "trees")
    model.write().save(path)
    stored = session.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    boosted = hasattr(model, "treeWeights") and "GBT" in type(model).__name__
    weights = list(model.treeWeights) if boosted else [1.0 / len(model.trees)] * len(model.trees)
    trees: dict[int, dict] = {}
    for node in stored:
        trees.setdefault(node["treeID"], {})[node["id"]] = node

    def cover(node) -> float:
        return node["impurityStats"][0] if boosted else sum(node["impurityStats"])

    def value(node) -> float:
        return node["prediction"] if boosted else node["impurityStats"][1] / sum(node["impurityStats"])

    out = []
    for number, nodes in trees.items():
        stack = [(nodes[0], {})]
        while stack:
            node, path_inputs = stack.pop()
            if node["leftChild"] < 0:
                names = sorted(path_inputs)
                parts = [path_inputs[i] for i in names]
                out.append(
                    Leaf(
                        weights[number] * value(node),
                        np.array(names, np.int64),
                        np.array([p[:2] for p in parts]).reshape(-1, 2),
                        np.array([p[2] for p in parts]),
                    )
                )
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ValueError("only splits at thresholds are attributed")
            at, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, share = path_inputs.get(at, (-np.inf, np.inf, 1.0))
            for child, bounds in ((nodes[node["leftChild"]], (low, min(high, cut))), (nodes[node["rightChild"]], (max(low, cut), high))):
                stack.append((child, {**path_inputs, at: (*bounds, share * cover(child) / cover(node))}))
    return out


def leaf_contributions(met: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """For each row of 0/1 ``met`` what each input of a leaf of value 1 adds: its Shapley value.

    A coalition's worth is the product of ``met`` over its members and of ``shares`` over the others. ``sums[:, s]``
    adds up those products over all coalitions of s of the other inputs.
    """
    n, size = met.shape
    out = np.empty((n, size))
    weight = [factorial(s) * factorial(size - s - 1) / factorial(size) for s in range(size)]
    for i in range(size):
        sums = np.zeros((n, size))
        sums[:, 0] = 1.0
        for j in range(size):
            if j != i:
                grown = sums * shares[j]
                grown[:, 1:] += sums[:, :-1] * met[:, j, None]
                sums = grown
        out[:, i] = (met[:, i] - shares[i]) * (sums @ weight)
    return out


def contributions(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` by inputs: what each adds to the base, the mean over the training rows.

    Rows that meet the same conditions of a leaf share its values, so each pattern is worked out once.
    """
    out = np.zeros(x.shape)
    for leaf in leaves:
        size = len(leaf.inputs)
        if not size:
            continue
        values = x[:, leaf.inputs]
        met = (values > leaf.bounds[:, 0]) & (values <= leaf.bounds[:, 1])
        patterns, which = np.unique(met, axis=0, return_inverse=True)
        out[:, leaf.inputs] += (leaf.value * leaf_contributions(patterns.astype(float), leaf.shares))[which.ravel()]
    return out


def base_value(leaves: list[Leaf]) -> float:
    """The score's mean over the training rows, by the shares of the paths."""
    return float(sum(leaf.value * leaf.shares.prod() for leaf in leaves))


def with_contributions(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """``key``, ``base`` and one column per model input: base and inputs add up to the score of the row.

    The score is the margin of boosted trees, before the sigmoid, or the probability of a forest. Rows are worked on in
    Arrow batches where they lie; nothing is shuffled.
    """
    learner, inputs = model.stages[-1], list(model.stages[-2].getInputCols())
    leaves = ensemble_leaves(learner)
    base = base_value(leaves)
    prepared = model.stages[0].transform(df).select(key, *[F.col(f"`{c}`").cast("double") for c in inputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]) if batch.num_rows else np.zeros((0, len(inputs)))
            found = contributions(leaves, x)
            columns = [pa.array(np.full(len(x), base)), *[pa.array(found[:, i].copy()) for i in range(len(inputs))]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "base", *inputs])

    kind = prepared.schema[key].dataType.simpleString()
    return prepared.mapInArrow(run, f"`{key}` {kind}, base double, " + ", ".join(f"`{c}` double" for c in inputs))


def tree_importance(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """``feature, mean_abs_contribution`` over the rows of ``df``."""
    found = with_contributions(model, df, key)
    inputs = found.columns[2:]
    means = found.agg(*[F.avg(F.abs(f"`{c}`")).alias(c) for c in inputs])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("mean_abs_contribution")) for c in inputs])
    return means.select(F.inline(cells))
