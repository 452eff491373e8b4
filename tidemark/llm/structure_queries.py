"""Queries of the operators on words, conversation prefixes and vector search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.posting_lists import nearest_vectors
from tidemark.llm.prefix_trie import conversation_trie
from tidemark.llm.registry import query
from tidemark.llm.spelling import spelling_variants
from tidemark.sources.tables import table

# crc32 of the bytes of a text, by a table of 256 values.
CRC_TABLE = """
SELECT [list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(256)] AS tbl
"""


def crc_of(text: str) -> str:
    """SQL for the unsigned crc32 of a text column's UTF-8 bytes; needs ``tbl`` in scope."""
    codes = f"[CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT) FOR i IN range(octet_length(encode({text})))]"
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, tbl[1 + (xor(c, b) & 255)])), 4294967295)"


SPELLING_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS seed, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), spelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k
  FROM (SELECT run, k, {crc_of('seed')} AS h FROM runs, crc)
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cuts AS (
  SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, other)) AS name FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN name END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM words
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.at AND e.form IS NULL
"""


@query("op11_spelling_variants", SPELLING_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), "doc_id", "text")


NEAREST_SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)])) AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""


@query("op13_nearest_vectors", NEAREST_SQL)
def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


TRIE_SQL = rf"""
WITH crc AS ({CRC_TABLE}), items AS (
  SELECT conv_id, turn, coalesce(role, '') AS role,
    substr(sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS item,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'item': item, 'words': words}} ORDER BY turn NULLS FIRST, role, item) AS s FROM items GROUP BY conv_id
), seeds AS (
  SELECT conv_id, s, {crc_of('CAST(conv_id AS VARCHAR)')} % 4 AS h, conv_id - conv_id % 20 AS base FROM own, crc
), built AS (
  SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM seeds a LEFT JOIN own b ON b.conv_id = a.base
), paths AS (
  SELECT conv_id, len(s) AS size, d, array_to_string([x.item FOR x IN s[1:d]], '') AS path,
    CASE WHEN d > 0 THEN s[d].words ELSE 0 END AS words
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)
), nodes AS (
  SELECT path, any_value(d) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = size), '')) AS ends_sha256
  FROM paths GROUP BY path
), kids AS (
  SELECT substr(path, 1, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)
), above AS (
  SELECT substr(path, 1, 32 * CAST(a AS INTEGER)) AS path, leaf, saved
  FROM (SELECT path, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * words AS saved, unnest(range(0, depth + 1)) AS a FROM full_nodes)
), totals AS (SELECT path, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN totals t USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = substr(n.path, 1, length(n.path) - 32)
"""


@query("op12_conversation_trie", TRIE_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
