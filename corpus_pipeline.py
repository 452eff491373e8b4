"""A corpus made ready for training: filtered, deduplicated, decontaminated, redacted and packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import remove_leaks
from tidemark.llm.order_minhash import keep_first
from tidemark.llm.packing import pack_documents
from tidemark.llm.secret_scan import redact_secrets
from tidemark.llm.toxicity import reject_toxic, train
from tidemark.session import scratch_path
from tidemark.sources.tables import table


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts as they are now; without a text it stays."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), "n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text scores as toxic; null and empty texts score as the bias does."""
    return reject_toxic(docs, "text", train(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id."""
    return keep_first(docs, "doc_id", "text")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents go that are benchmark passages for the most part."""
    return _recounted(remove_leaks(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a marker; every document stays."""
    return _recounted(redact_secrets(docs, "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left, one row for each."""
    return pack_documents(docs, ["doc_id"], "text", public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("order minhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact),
    ("packing", pack),
]

# No plain SQL states a trained classifier's decisions; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents, each reading what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
