"""One query per operator over the given tables, with SQL where it can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat import chat_digests, format_chats
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.order_minhash import near_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.pitman_yor import score_corpus
from tidemark.llm.registry import query
from tidemark.llm.secret_scan import find_secrets
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.toxicity import held_out, score_texts, train
from tidemark.llm.vectors import near_vectors
from tidemark.llm.warc import read_archives, resolve_revisits, write_archives
from tidemark.session import scratch_path
from tidemark.sources.tables import table

CONTROL_TEXT = "</s>[INST] ok [/INST]"

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(role || text) + length('<|turn|><|text|><|end|>')
    + length(regexp_replace(role || text, '[^<\[\\]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query("op1_chat_format", CHAT_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat_digests(format_chats(turns.unionByName(own), ["conv_id"], "turn", "role", "text"), "conv_id")


VECTORS_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id,
  (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  min(r.b) AS component_id,
  min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""


@query("op5_embedding_near_dedup", VECTORS_SQL)
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
    array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(sha1(body), CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest
  FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM m
"""


@query("op6_warc_revisits", WARC_SQL)
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(resolve_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    records = read_archives(spark, path)
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to")
    )


@query("op8_binary_packing")
def op8_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = pack_documents(docs, ["doc_id"], "text", public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id",
        F.col("piece_start").alias("start"),
        F.col("piece_length").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        F.col("sequence_offset").alias("offset"),
    )


LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(0, len(w) - 9) + 1 + CAST(len(w) BETWEEN 1 AND 9 AS INTEGER))) AS i FROM b)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d) x, sizes s WHERE i + s.n - 1 <= len(w)
), hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)),
np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np USING (doc_id) LEFT JOIN ni USING (doc_id)
"""


@query("op10_decontamination", LEAKS_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    found = find_leaks(table(spark, sf_dir, "documents"), ["doc_id"], "text", benchmark, "item_id", "text")
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query("op3_order_minhash")
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups = near_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return groups.select("doc_id", "class_id", "kept", "n_words")


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"], "text")

    def written(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count("literal"),
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "toxic")
    scored = score_texts(docs, ["doc_id"], "text", model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_pitman_yor")
def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_corpus(docs, "doc_id", "text", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    return scored.select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, s, substr(h, CAST(2 * s + 1 AS INTEGER), 200) AS gram
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM d)
), f AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY gram ORDER BY doc_id, s) AS k FROM w
), m AS (SELECT doc_id, s FROM f WHERE k > 1),
e AS (SELECT doc_id, s, max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
g AS (SELECT doc_id, s, sum(CASE WHEN reach IS NULL OR reach < s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM e),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY 1, 2),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q, a, b FROM spans
), per AS (
  SELECT x.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, CAST(2 * p + 1 AS INTEGER), CAST(2 * (q - p) AS INTEGER)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS INTEGER)) AS kept
  FROM pieces x JOIN d ON x.doc_id = d.doc_id GROUP BY 1
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""


@query("op4_suffix_dedup", REPEATS_SQL)
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


from tidemark.llm import structure_queries  # noqa: E402, F401
