"""Exact top-k retrieval, by shared words (through the inverted index) or by cosine.

For vectors the queries are the small side. While they fit fixed limits they travel to the
tasks and every corpus partition keeps only its own best k per query. Beyond the limits both
sides are cut into bounded blocks that meet by shuffle. Neither way ships query-vector pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.text_index import SEED_POSTINGS, top_documents
from tidemark.params import DEFAULTS

MAX_QUERIES = 4_000
MAX_QUERY_ITEMS = 2_000_000
BLOCK_CORPUS_ITEMS = 20_000_000
CHUNK_ROWS = 512

HIT_SCHEMA = "query string, doc_id bigint, score double"
Scorer = Callable[[pd.DataFrame], np.ndarray]


class Best:
    """Running best k documents per query, by score and then by smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.empty((0, queries))
        self.ids = np.empty((0, queries), dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        every = np.vstack([self.scores, scores])
        names = np.vstack([self.ids, np.broadcast_to(ids[:, None], scores.shape)])
        order = np.lexsort((names, -every), axis=0)[: self.k]
        self.scores = np.take_along_axis(every, order, axis=0)
        self.ids = np.take_along_axis(names, order, axis=0)

    def frame(self, keys: list[str]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "query": np.repeat(np.asarray(keys, dtype=object), len(self.ids)),
                "doc_id": self.ids.T.ravel(),
                "score": self.scores.T.ravel(),
            }
        )


def vector_scorer(queries: pd.DataFrame) -> Scorer:
    """Cosine of vectors; a zero vector scores 0."""

    def unit(vectors: pd.Series) -> np.ndarray:
        matrix = np.vstack([np.asarray(v, dtype=float) for v in vectors])
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms == 0, 1.0, norms)

    targets = unit(queries["items"]).T

    def score(docs: pd.DataFrame) -> np.ndarray:
        return unit(docs["items"]) @ targets

    return score


def _fold(best: Best, docs: pd.DataFrame, score: Scorer) -> None:
    for start in range(0, len(docs), CHUNK_ROWS):
        chunk = docs.iloc[start : start + CHUNK_ROWS]
        best.add(chunk["doc_id"].to_numpy(dtype=np.int64), score(chunk))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """Final ranking; Spark limits each group before the shuffle as well."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    scorer: Callable[[pd.DataFrame], Scorer],
    k: int,
    max_queries: int = MAX_QUERIES,
    max_query_items: int = MAX_QUERY_ITEMS,
    block_corpus_items: int = BLOCK_CORPUS_ITEMS,
) -> DataFrame:
    """(query, doc_id, score, rank) of the best ``k`` documents of each query.

    ``queries``: query, items, size. ``corpus``: doc_id, items. Documents sharing nothing
    with a query score 0 and still fill its k places.
    """
    k = max(1, k)
    load = queries.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("items")
    ).first()
    blocks = max(
        math.ceil(load["n"] / max_queries), math.ceil(load["items"] / max_query_items), 1
    )
    if blocks == 1:
        held = queries.toPandas().sort_values("query", ignore_index=True)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if held.empty:
                return
            score, best = scorer(held), Best(len(held), k)
            for docs in batches:
                _fold(best, docs, score)
            yield best.frame(list(held["query"]))

        return _ranked(corpus.select("doc_id", "items").mapInPandas(scan, HIT_SCHEMA), k)

    size = corpus.agg(F.sum(F.size("items")).alias("items"), F.count("*").alias("n")).first()
    salts = max(math.ceil(max(size["items"] or 0, size["n"]) / block_corpus_items), 1)
    left = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    right = corpus.withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))

    def meet(held: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        best = Best(len(held), k)
        if len(held) and len(docs):
            _fold(best, docs, scorer(held))
        return best.frame(list(held["query"]))

    met = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt"))
    return _ranked(met.applyInPandas(meet, HIT_SCHEMA), k)


def retrieve(
    queries: DataFrame,
    documents: DataFrame,
    k: int = DEFAULTS.top_k_retrieval,
    seed_postings: int = SEED_POSTINGS,
) -> DataFrame:
    """(query_id, doc_id, score, rank): best documents by Jaccard of word sets.

    ``queries``: query_id, text. ``documents``: doc_id, text.
    """
    named, hits = top_documents(queries, documents, k, seed_postings)
    return named.join(hits, "query").drop("query")


def retrieve_contexts(
    queries: DataFrame,
    documents: DataFrame,
    k: int = DEFAULTS.top_k_retrieval,
    seed_postings: int = SEED_POSTINGS,
) -> DataFrame:
    """(query_id, context, sources): texts of the best documents in rank order.

    Texts are fetched once per signature, not per query, so a document that is the best
    of very many queries is not joined with each of them.
    """
    named, hits = top_documents(queries, documents, k, seed_postings)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text")))
    texts = (
        hits.join(documents.select("doc_id", "text"), "doc_id")
        .groupBy("query")
        .agg(ranked.alias("parts"))
        .select(
            "query",
            F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("context"),
            F.transform("parts", lambda p: p["doc_id"]).alias("sources"),
        )
    )
    return named.join(texts, "query").drop("query")


def similar_vectors(
    queries: DataFrame, vectors: DataFrame, k: int = DEFAULTS.top_k_retrieval, max_queries: int = MAX_QUERIES
) -> DataFrame:
    """(query, doc_id, score, rank): nearest vectors by cosine.

    ``queries``: query, items. ``vectors``: doc_id, items.
    """
    sized = queries.select(F.col("query").cast("string"), "items", F.size("items").alias("size"))
    return top_k(sized, vectors, vector_scorer, k, max_queries)


def mean_vectors(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, averaged per dimension."""
    cells = vectors.select(group, F.posexplode(vector).alias("at", "x"))
    means = cells.groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "m")))
    return means.groupBy(group).agg(F.transform(ordered, lambda s: s["m"]).alias("items"))


def passages(documents: DataFrame) -> DataFrame:
    """Non-empty passages between blank lines, numbered per document."""
    parts: Column = F.split("text", r"\n[ \t]*\n")
    kept = F.filter(parts, lambda p: F.length(F.trim(p)) > 0)
    return documents.select("doc_id", F.posexplode(kept).alias("position", "passage"))
