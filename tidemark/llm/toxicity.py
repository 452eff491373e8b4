"""Toxicity scores by non-negative positive-unlabelled learning on hashed word features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import FOLD, WORD_BYTES, byte_slices, fresh_names, mix, span_hashes, text_buffer, word_spans
from tidemark.session import settle

# Buckets of hashed features; a word gives its prefixes of these many bytes and itself.
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)

# Rows the classifier is fitted on, at most: confirmed toxic ones and unlabelled ones, by the order of a hash of their id.
MOST_POSITIVE = 6_000
MOST_UNLABELLED = 18_000
# Features kept, at most: those whose share of the positives exceeds that of the unlabelled by the most deviations.
MOST_FEATURES = 4_096


def text_features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, bucket, count)`` of every feature of every text, by row, and the texts' numbers of words."""
    raw, offsets = text_buffer(column)
    data = FOLD[raw]
    starts, ends, rows = word_spans(data, offsets, WORD_BYTES)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    parts = [span_hashes(data, starts, ends)]
    where = [row]
    for k, size in enumerate(PREFIXES, 1):
        long = ends - starts > size
        parts.append(mix(span_hashes(data, starts[long], starts[long] + size) + np.uint64(k)))
        where.append(row[long])
    bucket = (np.concatenate(parts) >> np.uint64(44)).astype(np.int64)
    key, count = np.unique(np.concatenate(where) * BUCKETS + bucket, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count, np.diff(rows)


@dataclass(frozen=True)
class Classifier:
    """A logistic model over some buckets: damped counts relative to the text's length.

    A text without any of the buckets shows nothing: its log odds are ``blank``, the bias, or the prior's where the bias
    alone would call it positive.
    """

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    blank: float

    def scores(self, column) -> np.ndarray:
        row, at, value, rows = selected_features(column, self.buckets)
        total = np.bincount(row, value * self.weights[at], rows) if len(row) else np.zeros(rows)
        some = np.zeros(rows, bool)
        some[row] = True
        return sigmoid(np.where(some, total + self.bias, self.blank))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def selected_features(column, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, index into ``buckets`` (sorted) and value of each selected feature of the texts, and the number of texts."""
    row, bucket, count, words = text_features(column)
    wanted = np.zeros(BUCKETS, bool)
    wanted[buckets] = True
    keep = wanted[bucket]
    row, bucket, count = row[keep], bucket[keep], count[keep]
    return row, np.searchsorted(buckets, bucket), feature_value(count, words[row]), len(words)


def feature_value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Occurrences per hundred words, damped; short texts count as thirty words."""
    return np.log1p(100 * count / np.maximum(words, 30))


def fit_nonnegative(row, at, value, positive: np.ndarray, features: int, prior: float, steps: int = 400, rate: float = 0.1, ridge: float = 2e-4, start=None):
    """Weights and bias that minimise the non-negative risk of positive-unlabelled learning under the logistic loss.

    The risk is ``prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])``: unlabelled texts count as
    negative, less the share of them that the class prior says is positive. Where the corrected part falls below zero
    the fit has turned to memorising single texts, and the step goes the other way on that part alone.
    """
    total = len(positive)
    weights = np.zeros(features) if start is None else start.copy()
    bias = np.log(prior / (1 - prior))
    share_p = positive / max(1, positive.sum())
    share_u = ~positive / max(1, (~positive).sum())
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(row, value * weights[at], total) + bias
        p = sigmoid(margin)
        loss = np.logaddexp(0, margin)  # of calling a text negative
        corrected = share_u @ loss - prior * (share_p @ loss)
        if corrected >= 0:
            slope = prior * share_p * (p - 1) + share_u * p - prior * share_p * p
        else:
            slope = -(share_u * p - prior * share_p * p)
        grad = np.append(np.bincount(at, value * slope[row], features) + ridge * weights, slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights = weights - move[:-1]
        bias = bias - move[-1]
    return weights, float(bias)


# Deviations by which a feature's share of the positives must exceed its share of the unlabelled, and texts it is in.
LEAST_DEVIATIONS, LEAST_TEXTS = 2.5, 3


def held_out(key: str):
    """The fold of ids whose CRC-32 (of the id as text) is a multiple of five; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str) -> Classifier:
    """Fit a classifier on documents outside the held-out fold: labelled 1, against those without a label.

    Rows of ``labels`` with a null key or label are no labels; of several labels of a key the largest counts, and of
    the zeros only their number, for the class prior. At most MOST_POSITIVE and MOST_UNLABELLED keys are used, those of
    the least hash, so that the sample does not depend on order or partitions. Feature counts are added up before they
    are shuffled; the driver gets the selected buckets and the sample's few selected features. Without positives or
    unlabelled documents, the prior (0 without labels) is everyone's score.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    known = settle(known.groupBy("id").agg(F.max("y").alias("y")).where(~held_out("id")), "labels")
    prior = known.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0] or 0.0
    ids = docs.select(F.col(key).alias("id")).where(F.col("id").isNotNull() & ~held_out("id"))
    order = F.xxhash64("id")
    positive = known.where("y = 1").select("id").orderBy(order, "id").limit(MOST_POSITIVE)
    unlabelled = ids.join(known, "id", "left_anti").distinct().orderBy(order, "id").limit(MOST_UNLABELLED)
    # At most MOST_POSITIVE + MOST_UNLABELLED ids.
    chosen = F.broadcast(positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False))))
    sample = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    sample = settle(sample.join(chosen, "id").select(F.xxhash64("id", "text").alias("at"), "text", "positive"), "toxic-sample")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    bias = float(np.log(np.clip(prior, 1e-9, 1 - 1e-9) / (1 - np.clip(prior, 1e-9, 1 - 1e-9))))
    if len(sizes) < 2 or not 0 < prior < 1:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), bias, bias)

    def count(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in byte_slices(batches, "text"):
            row, bucket, _, _ = text_features(batch.column("text"))
            side = batch.column("positive").to_numpy(zero_copy_only=False)[row]
            for k in (0, 1):
                seen[k] += np.bincount(bucket[side == bool(k)], minlength=BUCKETS)
        found = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[1, found]), pa.array(seen[0, found])], ["bucket", "p", "u"])

    counts = sample.mapInArrow(count, "bucket bigint, p bigint, u bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    n_p, n_u = sizes[True], sizes[False]
    p, u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    z = (p - u) / F.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u)
    best = counts.withColumn("z", z).where((F.col("z") > LEAST_DEVIATIONS) & (F.col("p") >= LEAST_TEXTS))
    buckets = np.array(sorted(r["bucket"] for r in best.orderBy(F.desc("z"), "bucket").limit(MOST_FEATURES).collect()), np.int64)

    def select(batches):
        for batch in byte_slices(batches, "text"):
            row, at, value, rows = selected_features(batch.column("text"), buckets)
            ends = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at, value)]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("positive"), *lists], ["key", "positive", "at", "value"])

    chosen_features = sample.mapInArrow(select, "key bigint, positive boolean, at array<bigint>, value array<double>").collect()
    chosen_features.sort(key=lambda r: (r["key"], r["positive"], r["at"], r["value"]))
    side = np.array([r["positive"] for r in chosen_features])
    row = np.repeat(np.arange(len(side)), [len(r["at"]) for r in chosen_features])
    at = np.array([i for r in chosen_features for i in r["at"]], np.int64)
    value = np.array([v for r in chosen_features for v in r["value"]], float)
    prior_odds = bias
    weights, bias = fit_nonnegative(row, at, value, side, len(buckets), prior)
    return Classifier(buckets, weights, bias, bias if bias < 0 else min(bias, prior_odds))


def score_texts(docs: DataFrame, keys: list[str], text: str, model: Classifier) -> DataFrame:
    """``keys`` and ``score`` of every row, in no case shuffled; null, empty and other texts without known words
    get the score of the bias, or of the prior where that is not below one half."""
    name, = fresh_names(keys, "text")
    picked = docs.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias(name))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keys)]) + ", score double"

    def run(batches):
        for batch in byte_slices(batches, len(keys)):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(model.scores(batch.column(len(keys))))], [*keys, "score"])

    return picked.mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, text: str, model: Classifier, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, all columns as they are."""
    at = docs.schema.names.index(text)

    def run(batches):
        for batch in byte_slices(batches, at):
            yield batch.filter(pa.array(model.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
