"""Best documents by shared words: an inverted index with bounds, on joins and sums alone.

A query's words stand in order of how many documents hold them. The rarest ones and a sample of the
documents give every query a threshold that its k-th best document reaches. With it most of the work falls away: a
document that shares none but a query's most frequent words cannot reach the threshold, nor can one
with too many other words. The rest is counted word by word next to its documents, so that one row
for each surviving pair, not one for each shared word, is all that could move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import word_set
from tidemark.session import settle

# Documents that are looked at for thresholds: of a query's rarest words, and drawn by hash.
SEED_POSTINGS = 2_000
# Room for rounding where a bound meets a threshold.
SLACK = 1e-12


def known_words(text: str) -> Column:
    """The word set of a text; a NULL text has no words."""
    return F.coalesce(word_set(F.col(text)), F.array().cast("array<string>"))


def posting_index(documents: DataFrame, words: DataFrame) -> DataFrame:
    """``row, doc_id, size, codes``: a document's number of words, and the codes of those that ``words`` lists.

    ``words`` has ``word, code``; documents that hold none of them are left out. ``row`` tells documents apart that
    share an id. Written once, as every later step reads it.
    """
    held = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", known_words("text").alias("words"))
    met = held.select("row", "doc_id", F.size("words").alias("size"), F.explode("words").alias("word")).join(words, "word")
    return settle(met.groupBy("row", "doc_id", "size").agg(F.collect_list("code").alias("codes")), "posting-index")


def postings(index: DataFrame) -> DataFrame:
    return index.select("row", "doc_id", "size", F.explode("codes").alias("code"))


def jaccard(shared: Column, one: Column, other: Column) -> Column:
    return shared / (one + other - shared)


def ranked_words(queries: DataFrame, index: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(named, terms)``: the signature ``query`` of each query text, and the terms of each signature.

    A ranking depends on a query's number of words and on those the documents know, so texts that differ in an
    unknown word share a signature. ``terms`` has ``query, n`` (words), ``known`` (of them in documents), ``code``,
    ``frequency`` (documents with it), ``place`` (1 for the rarest) and ``before`` (frequencies of the rarer ones).
    """
    frequency = postings(index).groupBy("code").agg(F.count(F.lit(1)).alias("frequency"))
    frequency = settle(words.join(frequency, "code"), "word-frequencies")
    texts = queries.select("query_id", known_words("text").alias("words")).distinct()
    texts = settle(texts.select(F.monotonically_increasing_id().alias("number"), "query_id", "words", F.size("words").alias("n")), "query-texts")
    found = texts.select("number", F.explode("words").alias("word")).join(frequency, "word")
    codes = found.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("frequency", "code"))).alias("terms"))
    named = texts.join(codes, "number", "left").select("query_id", "n", F.coalesce("terms", F.array().cast("array<struct<frequency:bigint,code:bigint>>")).alias("terms"))
    distinct = settle(named.select("n", "terms").distinct().withColumn("query", F.monotonically_increasing_id()), "query-signatures")
    named = settle(named.join(distinct, ["n", "terms"]).select("query_id", "query"), "named-queries")
    placed = distinct.select("query", "n", F.size("terms").alias("known"), "terms", F.posexplode("terms").alias("place", "term"))
    before = F.aggregate(F.slice("terms", 1, F.col("place")), F.lit(0).cast("bigint"), lambda total, x: total + x["frequency"])
    terms = placed.select("query", "n", "known", F.col("term.code").alias("code"), F.col("term.frequency").alias("frequency"), (F.col("place") + 1).alias("place"), before.alias("before"))
    return named, settle(terms, "query-terms")


def thresholds(terms: DataFrame, index: DataFrame, k: int, seed_postings: int) -> DataFrame:
    """``query, threshold``: what the k-th best document scores at least; queries with fewer candidates are left out.

    Two sets of documents bound it from below: those of each query's rarest words, by the shared ones of these, some
    ``seed_postings`` postings of them; and a sample of as many documents, drawn by hash, by all shared words.
    """
    share = min(1.0, seed_postings / max(index.count(), 1))
    drawn = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))
    rare = F.col("before") < seed_postings
    met = index.select("row", "size", drawn.alias("drawn"), F.explode("codes").alias("code")).join(terms.select("query", "n", "code", rare.alias("rare")), "code")
    met = met.where("drawn or rare").groupBy("query", "row").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.first("size").alias("size"))
    least = met.select("query", jaccard(F.col("shared"), F.col("n"), F.col("size")).alias("least"))
    order = Window.partitionBy("query").orderBy(F.col("least").desc())
    best = least.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.groupBy("query").agg(F.min("least").alias("threshold"), F.count(F.lit(1)).alias("found")).where(F.col("found") == k).drop("found")


def best_matches(terms: DataFrame, index: DataFrame, k: int, seed_postings: int) -> DataFrame:
    """``query, doc_id, score``, ``k`` at most: documents that share a word with a query, best first."""
    threshold = F.coalesce("threshold", F.lit(0.0)) - SLACK
    limits = terms.join(thresholds(terms, index, k, seed_postings), "query", "left").withColumn("threshold", threshold)
    # A document whose rarest shared word stands at this place shares no more than the words from there on.
    room = F.col("known") - F.col("place") + 1
    limits = settle(limits.withColumn("leads", room >= F.col("threshold") * F.col("n")), "query-limits")
    # All of a query's known words in a document of ``longest`` words just reach the threshold.
    longest = F.when(F.col("threshold") > 0, F.floor(F.col("known") / F.col("threshold") + F.col("known") - F.col("n") + 1e-6)).otherwise((1 << 31) - 1)
    per_query = limits.groupBy("query", "n", "known", "threshold").agg(
        F.count_if("leads").alias("leading"), F.collect_list(F.when(~F.col("leads"), F.col("code"))).alias("rest")
    )
    leading = limits.where("leads").select("query", "code", longest.alias("longest"))
    met = postings(index.repartition("row")).join(leading, "code").where(F.col("size") <= F.col("longest"))
    # Words of a document lie in one task, and so does its count.
    pairs = met.groupBy("row", "query").agg(F.count(F.lit(1)).alias("shared"), F.first("size").alias("size"))
    most = F.least(F.col("shared") + F.col("known") - F.col("leading"), F.col("size"))
    pairs = pairs.join(per_query, "query").where(jaccard(most, F.col("n"), F.col("size")) >= F.col("threshold"))
    # The frequent words that were left out are looked up for the pairs that remain.
    full = pairs.drop("size").join(index.repartition("row").select("row", "doc_id", "size", "codes"), "row")
    shared = F.col("shared") + F.size(F.array_intersect("codes", "rest"))
    scored = full.select("query", "doc_id", "row", jaccard(shared, F.col("n"), F.col("size")).alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "doc_id", "score")


def top_documents(queries: DataFrame, documents: DataFrame, k: int, seed_postings: int = SEED_POSTINGS) -> tuple[DataFrame, DataFrame]:
    """``(named, hits)``: ``query_id, query`` of each query text, and ``query, doc_id, score, rank`` of its best ``k``.

    ``queries``: query_id, text. ``documents``: doc_id, text. Scores are Jaccard of the word sets, ties go to the
    smaller id. Documents that share nothing score 0 and fill the places that are left, smallest ids first.
    """
    k = max(1, k)
    vocabulary = queries.select(F.explode(known_words("text")).alias("word")).distinct()
    words = settle(vocabulary.withColumn("code", F.monotonically_increasing_id()), "query-words")
    index = posting_index(documents, words)
    named, terms = ranked_words(queries, index, words)
    hits = settle(best_matches(terms, index, k, seed_postings), "word-hits")

    # A query short of hits has fewer than k, so among the 2 k smallest ids enough are left that share nothing.
    smallest = [r["doc_id"] for r in documents.select("doc_id").orderBy(F.col("doc_id").asc_nulls_last()).limit(2 * k).collect()]
    filler = documents.sparkSession.createDataFrame([(d, smallest.count(d)) for d in dict.fromkeys(smallest)], "doc_id bigint, rows int")
    counts = hits.groupBy("query").agg(F.count(F.lit(1)).alias("found"))
    short = named.select("query").distinct().join(counts, "query", "left").where(F.coalesce("found", F.lit(0)) < k).select("query")
    used = hits.groupBy("query", F.col("doc_id").alias("used")).agg(F.count(F.lit(1)).alias("taken"))
    listed = short.join(F.broadcast(filler))
    same = (F.col("r.query") == F.col("u.query")) & F.col("doc_id").eqNullSafe(F.col("used"))
    free = listed.alias("r").join(used.alias("u"), same, "left").select("r.query", "doc_id", (F.col("rows") - F.coalesce("taken", F.lit(0))).alias("free"))
    zeros = free.where("free > 0").select("query", "doc_id", F.lit(0.0).alias("score"), F.explode(F.sequence(F.lit(1), "free"))).drop("col")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    every = hits.unionByName(zeros).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return named, every
