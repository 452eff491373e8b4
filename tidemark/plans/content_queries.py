"""Text rules, retrieval, prompts and the re-engagement batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import campaigns as cp
from tidemark.operators import content, retrieval
from tidemark.plans.base_sql import cte, sql
from tidemark.plans.registry import query
from tidemark.plans.report_queries import customer_view
from tidemark.session import settle
from tidemark.sources.tables import spread, table

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
REASON = "High churn risk: elevated recency, low purchase activity"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "doc_tokens",
    f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(list_sort(w), ' ')) AS words_md5
FROM (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents)""",
)
def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.word_set(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.size(words).alias("n_words"),
        F.md5(F.array_join(F.array_sort(words), " ")).alias("words_md5"),
    )


def mask_sql(expr: str) -> str:
    return (
        r"regexp_replace(regexp_replace(regexp_replace(" + expr +
        r", '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL]', 'g')"
        r", '\b\d{10,16}\b', '[CARD]', 'g'), '\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b', '[PHONE]', 'g')"
    )


@query(
    "mask_pii",
    f"SELECT doc_id, m <> text AS masked, md5(m) AS text_md5 FROM (SELECT doc_id, text, {mask_sql('text')} AS m FROM documents)",
)
def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = tx.mask_pii(F.col("text"))
    return (
        documents(spark, sf_dir)
        .withColumn("m", masked)
        .select("doc_id", (F.col("m") != F.col("text")).alias("masked"), F.md5("m").alias("text_md5"))
    )


def guard_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, a AS no_pii_leak, b AS no_forbidden_terms, c AS discount_within_limit, a AND b AND c AS guardrail_passed,
  list_filter([CASE WHEN NOT a THEN 'no_pii_leak' END, CASE WHEN NOT b THEN 'no_forbidden_terms' END, CASE WHEN NOT c THEN 'discount_within_limit' END], lambda x: x IS NOT NULL) AS guardrail_reasons
FROM (SELECT {keys}, {mask_sql('text')} = text AS a,
  NOT contains(lower(text), 'unlimited free trial') AND NOT contains(lower(text), '100% money-back guarantee') AS b,
  len(list_filter(regexp_extract_all(text, '[0-9]+\\s*%|%\\s*[0-9]+'), lambda x: CAST(regexp_extract(x, '[0-9]+') AS DOUBLE) > 30)) = 0 AS c FROM {source})"""


GUARD_COLUMNS = (
    "no_pii_leak",
    "no_forbidden_terms",
    "discount_within_limit",
    "guardrail_passed",
    "guardrail_reasons",
)


@query("guardrails", guard_sql("documents", "doc_id"))
def _guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.guardrails(documents(spark, sf_dir), "text").select("doc_id", *GUARD_COLUMNS)


@query("conversation_guardrails", guard_sql("conversations", "conv_id, turn"))
def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = content.guardrails(table(spark, sf_dir, "conversations"), "text")
    return checked.select("conv_id", "turn", *GUARD_COLUMNS)


@query(
    "grounding",
    """SELECT doc_id, contains(lower(text), 'discount') OR contains(lower(text), 'offer') OR contains(lower(text), 'product') OR contains(lower(text), 'cart') AS grounded FROM documents""",
)
def _grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", content.grounded(F.col("text")).alias("grounded"))


def jaccard_sql(queries: str, k: int = 5) -> str:
    """Brute-force ranking of ``queries`` (query_id, text) over the documents."""
    return f"""q AS (SELECT query_id, list_distinct({WORDS}) AS w FROM {queries}),
qn AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM q),
d AS (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents),
dn AS (SELECT doc_id, unnest(w) AS word FROM d),
shared AS (SELECT query_id, doc_id, count(*) AS c FROM qn JOIN dn USING (word) GROUP BY 1, 2),
hits AS (
  SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (
    SELECT q.query_id, d.doc_id, CASE WHEN len(d.w) = 0 THEN 0.0 ELSE COALESCE(c, 0) / CAST(len(q.w) + len(d.w) - COALESCE(c, 0) AS DOUBLE) END AS score
    FROM q CROSS JOIN d LEFT JOIN shared s ON s.query_id = q.query_id AND s.doc_id = d.doc_id)
  QUALIFY rank <= {k})"""


@query(
    "rag_topk",
    f"WITH {jaccard_sql('(SELECT item_id AS query_id, text FROM benchmark)')} SELECT query_id, doc_id, round(score, 9) AS score, rank FROM hits",
)
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = retrieval.retrieve(queries, documents(spark, sf_dir))
    return hits.withColumn("score", F.round("score", 9))


cte(
    "risky",
    ("profiles", "scores", "customer360"),
    f"""risky AS (
  SELECT s.customer_id AS query_id, s.customer_id, p.total_spend_usd, s.churn_probability, c.context AS profile_text,
    s.customer_id || ' {REASON} country ' || p.country || ' spend ' || CAST(p.total_spend_usd AS VARCHAR) || ' discount campaign product offer' AS text
  FROM scores s JOIN profiles p USING (customer_id) JOIN customer360 c USING (customer_id) WHERE s.risk_tier = 'high')""",
)
cte("ranked_docs", ("risky",), jaccard_sql("risky"))
cte(
    "context_docs",
    ("ranked_docs",),
    """context_docs AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context, list(doc_id ORDER BY rank) AS sources
  FROM hits JOIN documents USING (doc_id) GROUP BY 1)""",
)


def high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-risk customers with profile text and the words to retrieve by."""
    view = customer_view(spark, sf_dir).where(F.col("risk_tier") == "high")
    two = F.col("total_spend_usd").cast("decimal(28,2)").cast("string")
    spend = F.regexp_replace(two, "0$", "")
    words = content.retrieval_query(F.col("customer_id"), F.lit(REASON), F.col("country"), spend)
    return settle(
        view.select(
            F.col("customer_id").alias("query_id"),
            "customer_id",
            "total_spend_usd",
            "churn_probability",
            F.col("context").alias("profile_text"),
            words.alias("text"),
        ),
        "risky",
    )


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = high_risk(spark, sf_dir)
    docs = documents(spark, sf_dir)
    found = retrieval.retrieve_contexts(people.select("query_id", "text"), docs)
    return people.drop("text").join(found, "query_id").drop("query_id")


@query(
    "rag_context",
    sql("SELECT query_id AS customer_id, sources, md5(context) AS context_md5 FROM context_docs", "context_docs"),
)
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir).select("customer_id", "sources", F.md5("context").alias("context_md5"))


@query(
    "prompt_text",
    sql(
        f"""SELECT customer_id, md5('Customer profile: ' || {mask_sql('profile_text')} || chr(10) || 'Churn risk reason: {REASON}' || chr(10) || 'Relevant context: ' || context ||
  chr(10) || chr(10) || 'Write a personalized win-back email for this customer that does not exceed the discount limit.') AS prompt_md5
FROM context_docs JOIN risky USING (query_id)""",
        "context_docs",
    ),
)
def _prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = content.email_prompt(F.col("profile_text"), F.col("context"), F.lit(REASON))
    return retrieved(spark, sf_dir).select("customer_id", F.md5(prompt).alias("prompt_md5"))


@query(
    "reengagement_batch",
    sql(
        f"""SELECT customer_id, sources, true AS guardrail_passed, escalated, CASE WHEN escalated THEN 'ESCALATED' ELSE 'SENT' END AS decision,
  CASE WHEN ltv >= 1000 AND confidence < 0.5 THEN 'high' ELSE 'normal' END AS priority, CASE WHEN NOT escalated THEN '{content.EMAIL_TEMPLATE.replace("'", "''")}' END AS final_email
FROM (SELECT *, ltv >= 1000 AND confidence < 0.8 AS escalated FROM (
  SELECT customer_id, sources, total_spend_usd AS ltv, CASE WHEN churn_probability = 0 THEN 0.5 ELSE churn_probability END AS confidence
  FROM context_docs JOIN risky USING (query_id)))""",
        "context_docs",
    ),
)
def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval, draft, checks and routing for every high-risk customer."""
    drafts = retrieved(spark, sf_dir).withColumns(
        {"content": F.lit(content.EMAIL_TEMPLATE), "support_complaints": F.lit(0)}
    )
    routed = cp.route(content.guardrails(drafts, "content"))
    email = F.when(~F.col("escalated"), F.col("content"))
    return routed.select(
        "customer_id",
        "sources",
        "guardrail_passed",
        "escalated",
        "decision",
        "priority",
        email.alias("final_email"),
    )


@query(
    "vector_topk",
    """WITH m AS (SELECT label, at_, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS at_ FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY at_) AS v FROM m GROUP BY 1),
s AS (SELECT CAST(c.label AS VARCHAR) AS query, vec_id AS doc_id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS score FROM c CROSS JOIN embeddings)
SELECT query, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
)
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest embeddings to the mean embedding of each label."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = retrieval.mean_vectors(vectors, "label", "embedding").withColumnRenamed("label", "query")
    corpus = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("items"))
    return retrieval.similar_vectors(queries, corpus).withColumn("score", F.round("score", 6))


@query(
    "doc_chunks",
    r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, p[i] AS passage FROM (
  SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: length(trim(x)) > 0) AS p FROM documents))""",
)
def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.passages(documents(spark, sf_dir))
