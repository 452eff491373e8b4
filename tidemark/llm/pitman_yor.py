"""Hierarchical Pitman-Yor language model of word pairs, seated by Gibbs sampling on partitioned restaurants."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import VISIBLE_BYTES, byte_slices, hashed_words, mix, ragged_ranges, segment_sums
from tidemark.llm.packets import join_small, narrow, pack, split_small, unpack
from tidemark.session import settle

# Discounts and strengths of the restaurants of one context word and of their parent, which serves every word.
PAIR_DISCOUNT, PAIR_STRENGTH = 0.8, 1.0
WORD_DISCOUNT, WORD_STRENGTH = 0.6, 10.0
# Sweeps before and with a sample.
BURN_IN, SAMPLES = 1, 3
# Customers of one dish up to which tables are drawn from their exact conditional; more are seated block by block.
EXACT = 32
# A block is this share of the customers seated before.
BLOCK = 1 / 16

# Tokens of one chunk of documents and, about, of one bucket of restaurants.
CHUNK_TOKENS, BUCKET_TOKENS = 2_000_000, 1_500_000
# A context with a larger share of the tokens has its dishes spread over all buckets.
HEAVY_SHARE = 1e-3
# Smallest word hashes from which the vocabulary's size is estimated for the seating.
KEPT_HASHES = 1024

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """``[c, t]``: log of the generalised Stirling number, which weighs all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0
    t = np.arange(most + 2)
    for c in range(1, most):
        stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + stay[1:])
    return out


def sample_tables(customers, others, base, discount: float, strength: float, table: np.ndarray, rng) -> np.ndarray:
    """Draw each dish's number of tables given its customers, the restaurant's other tables and the parent's probability.

    Up to EXACT customers this is a Gibbs step from the exact conditional: Stirling number times the chances of opening
    the tables. More customers are seated by the restaurant's rule, a block at a time.
    """
    customers = np.asarray(customers, np.int64)
    others = np.broadcast_to(others, customers.shape)
    tables = np.minimum(customers, 1)
    several = np.flatnonzero(customers > 1)
    several = several[np.argsort(customers[several], kind="stable")]
    edges = np.searchsorted(customers[several], np.arange(2, EXACT + 2))
    for count, low, high in zip(range(2, EXACT + 1), edges[:-1], edges[1:], strict=True):
        if low == high:
            continue
        rows = several[low:high]
        opening = np.log(strength + discount * (others[rows, None] + np.arange(1, count)))
        opening += np.log(base[rows])[:, None]
        weights = np.cumsum(opening, axis=1) + (table[count, 2 : count + 1] - table[count, 1])
        top = np.maximum(weights.max(axis=1), 0)
        cumulative = np.cumsum(np.exp(np.column_stack([-top, weights - top[:, None]])), axis=1)
        draw = rng.random(len(rows)) * cumulative[:, -1]
        tables[rows] = 1 + (cumulative[:, :-1] < draw[:, None]).sum(axis=1)
    many = several[edges[-1] :]
    tables[many] = _seat_many(customers[many], others[many], base[many], discount, strength, rng)
    return tables


def _seat_many(customers, others, base, discount, strength, rng) -> np.ndarray:
    """Tables of dishes with many customers: a block opens as many as its first customer's chance gives, independently."""
    tables = np.ones(len(customers), np.int64)
    seated = np.ones(len(customers), np.int64)
    open_ = np.arange(len(customers))
    while len(open_):
        t, j = tables[open_], seated[open_]
        chance = (strength + discount * (others[open_] + t)) * base[open_]
        block = np.minimum(np.maximum(1, (j * BLOCK).astype(np.int64)), customers[open_] - j)
        tables[open_] += rng.binomial(block, chance / (chance + j - discount * t))
        seated[open_] += block
        open_ = open_[seated[open_] < customers[open_]]
    return tables


@dataclass(frozen=True)
class Layout:
    """What all tasks agree on: buckets, contexts with many tokens (sorted) and the estimated size of the vocabulary."""

    buckets: int
    heavy: np.ndarray
    words: float
    seed: int

    def bucket_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        home = mix(context + np.uint64(1))
        if len(self.heavy):
            at = np.searchsorted(self.heavy, context)
            at[at == len(self.heavy)] = 0
            home = np.where(self.heavy[at] == context, mix(context * _FACTOR + word), home)
        return (home % np.uint64(self.buckets)).astype(np.int64)

    def owner_of(self, word: np.ndarray) -> np.ndarray:
        return (mix(word + np.uint64(7)) % np.uint64(self.buckets)).astype(np.int64)


def _pairs_of(words: np.ndarray, rows: np.ndarray):
    """Context, word and row of every token of the texts, whose last token is the end."""
    counts = np.diff(rows)
    ends = np.cumsum(counts + 1)
    starts = ends - counts - 1
    tokens = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    tokens[ragged_ranges(starts, counts)] = words
    tokens[ends - 1] = END
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[starts] = START
    return context, tokens, np.repeat(np.arange(len(counts)), counts + 1)


def _count(batches):
    """Tokens, the frequent words and the least hashes of what a task reads."""
    for batch in byte_slices(batches, "text"):
        words, rows = hashed_words(batch.column("text"), VISIBLE_BYTES)
        context, tokens, row = _pairs_of(words, rows)
        trains = batch.column("train").to_numpy(zero_copy_only=False)[row]
        values, counts = np.unique(context, return_counts=True)
        many = counts >= max(2, HEAVY_SHARE / 2 * len(context))
        least = np.unique(mix(tokens[trains]))[:KEPT_HASHES]
        kinds = np.repeat([0, 1, 2], [1, many.sum(), len(least)])
        keys = np.concatenate([[0], values[many].astype(np.int64), least.astype(np.int64)])
        number = np.concatenate([[len(tokens)], counts[many], np.zeros(len(least), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(number)], ["kind", "key", "n"])


def plan_layout(docs: DataFrame, seed: int) -> Layout:
    """Read the corpus once for the layout; the driver gets three small results of bounded size."""
    found = docs.mapInArrow(_count, "kind bigint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    found = settle(found, "word-counts")
    total = found.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    heavy = found.where((F.col("kind") == 1) & (F.col("n") >= HEAVY_SHARE * total)).select("key").collect()
    # Hashes are unsigned: those with the top bit set come last.
    least = found.where("kind = 2").orderBy(F.col("key") < 0, "key").limit(KEPT_HASHES).select("key").collect()
    top = int(np.uint64(np.int64(least[-1]["key"]))) if len(least) == KEPT_HASHES else 0
    words = (KEPT_HASHES - 1) * 2.0**64 / top if top else float(len(least))
    contexts = np.sort(np.array([r["key"] for r in heavy], np.int64).astype(np.uint64))
    return Layout(max(1, -(-total // BUCKET_TOKENS)), contexts, max(1.0, words), seed)


PACKET = "bucket bigint, chunk bigint, kind bigint, body binary"


def _chunks(layout: Layout, key: str):
    """Send every bucket the word pairs of a chunk of documents that belong there, and one bucket the list of documents."""
    from pyspark import TaskContext

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        held, size = [], 0
        for batch in byte_slices(batches, "text"):
            words, rows = hashed_words(batch.column("text"), VISIBLE_BYTES)
            held.append((*_pairs_of(words, rows), batch.column("train").to_numpy(zero_copy_only=False), batch.column(key)))
            size += len(held[-1][0])
            if size >= CHUNK_TOKENS:
                yield from emit(held, number)
                number, held, size = number + 1, [], 0
        if held:
            yield from emit(held, number)

    def emit(held, number):
        first = np.cumsum([0, *(len(h[3]) for h in held)])
        context, word = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        doc = np.concatenate([h[2] + f for h, f in zip(held, first[:-1], strict=True)])
        train = np.concatenate([h[3] for h in held])
        tokens = np.bincount(doc, minlength=len(train))
        bucket = layout.bucket_of(context, word)
        pair = mix(context * _FACTOR + word)
        # By bucket, then context, then pair, then document (the order of tokens).
        order = np.argsort(pair, kind="stable")
        order = order[np.argsort(context[order], kind="stable")]
        order = order[np.argsort(bucket[order], kind="stable")]
        context, word, doc, bucket, pair = (x[order] for x in (context, word, doc, bucket, pair))
        edges = np.searchsorted(bucket, np.arange(layout.buckets + 1))
        bodies, places, kinds = [], [], []
        for b in np.flatnonzero(np.diff(edges)):
            s = slice(edges[b], edges[b + 1])
            new = np.concatenate([[True], pair[s][1:] != pair[s][:-1]])
            heads = np.flatnonzero(new)
            new_context = np.concatenate([[True], context[s][heads][1:] != context[s][heads][:-1]])
            context_heads = np.flatnonzero(new_context)
            ends = np.append(heads, len(new))
            learnt = segment_sums(train[doc[s]].astype(np.int64), ends)
            bodies.append(
                pack(
                    context[s][heads][context_heads], narrow(np.diff(np.append(context_heads, len(heads)))), word[s][heads],
                    *split_small(np.diff(ends)), *split_small(learnt), narrow(doc[s]),
                )
            )
            places.append(b)
            kinds.append(0)
        ids = pa.chunked_array([h[4] for h in held]).combine_chunks()
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        bodies.append(pack(ids.fill_null(0).to_numpy().astype("<i8"), missing.astype("u1"), train.astype("u1"), narrow(tokens)))
        places.append(number % layout.buckets)
        kinds.append(1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int64()), pa.array([number] * len(bodies), pa.int64()), pa.array(kinds, pa.int64()), pa.array(bodies, pa.binary())],
            ["bucket", "chunk", "kind", "body"],
        )

    return run


class Bucket:
    """The word pairs of a bucket, merged from all chunks, and samples of the tables in its restaurants."""

    def __init__(self, table: pa.Table, layout: Layout):
        kind = table.column("kind").to_numpy()
        order = np.lexsort((table.column("chunk").to_numpy(), kind))
        order = order[kind[order] == 0]
        self.chunks = table.column("chunk").to_numpy()[order]
        bodies = table.column("body")
        contexts, words, learnt, self.tokens, self.docs = [], [], [], [], []
        for i in order:
            parts = unpack(bodies[int(i)].as_py())
            context, per_context, word = next(parts), next(parts), next(parts)
            contexts.append(np.repeat(context, per_context.astype(np.int64)))
            words.append(word)
            self.tokens.append(join_small(parts))
            learnt.append(join_small(parts))
            self.docs.append(next(parts))
        self.sizes = [len(w) for w in words]
        context, word = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (contexts, words))
        learnt = np.concatenate(learnt) if learnt else np.zeros(0, np.int64)
        _, first, self.pair = np.unique(mix(context * _FACTOR + word), return_index=True, return_inverse=True)
        self.customers = np.bincount(self.pair, learnt, len(first)).astype(np.int64)
        self.contexts, self.context = np.unique(context[first], return_inverse=True)
        self.words, self.word = np.unique(word[first], return_inverse=True)
        self.heavy = np.isin(self.contexts, layout.heavy)

    def sample(self, layout: Layout, bucket: int) -> list[np.ndarray]:
        """Tables of every pair, SAMPLES times, by Gibbs sweeps over this bucket's restaurants and their own parent."""
        rng = np.random.default_rng([layout.seed, bucket, 1])
        pair_table, word_table = log_stirling(PAIR_DISCOUNT), log_stirling(WORD_DISCOUNT)
        flat = np.full(len(self.words), 1 / (layout.words + 1))
        tables = np.minimum(self.customers, 1)
        parent_tables = np.minimum(np.bincount(self.word, tables, len(self.words)), 1).astype(np.int64)
        out = []
        for sweep in range(BURN_IN + SAMPLES):
            parent = np.bincount(self.word, tables, len(self.words)).astype(np.int64)
            parent_tables = sample_tables(parent, parent_tables.sum() - parent_tables, flat, WORD_DISCOUNT, WORD_STRENGTH, word_table, rng)
            base = word_probability(parent, parent_tables, parent.sum(), parent_tables.sum(), layout.words)
            others = np.bincount(self.context, tables, len(self.contexts))[self.context].astype(np.int64) - tables
            tables = sample_tables(self.customers, others, base[self.word], PAIR_DISCOUNT, PAIR_STRENGTH, pair_table, rng)
            if sweep >= BURN_IN:
                out.append(tables)
        return out

    def tables(self, body: bytes) -> list[np.ndarray]:
        """The samples as sent: tables of pairs with several customers; one customer has one table."""
        parts, out = unpack(body), []
        for _ in range(SAMPLES):
            out.append(np.minimum(self.customers, 1))
            out[-1][self.customers > 1] = join_small(parts)
        return out


def word_probability(customers, tables, all_customers, all_tables, words: float):
    """The parent's predictive probability of a word; ``words`` known ones and one unknown share its base evenly."""
    rest = (WORD_STRENGTH + WORD_DISCOUNT * all_tables) / (words + 1)
    return (customers - WORD_DISCOUNT * tables + rest) / (WORD_STRENGTH + all_customers)


REQUEST = "owner bigint, bucket bigint, body binary"


def _requests(layout: Layout):
    """From a bucket to the owner of each of its words: training tokens and sampled tables; heavy contexts likewise.

    The tables of pairs that have a choice go to the bucket itself, by way of an owner without a number.
    """

    def run(key, table):
        number = key[0].as_py()
        bucket = Bucket(table, layout)
        samples = bucket.sample(layout, number)
        seen = np.bincount(bucket.word, bucket.customers, len(bucket.words)).astype(np.int64)
        served = [np.bincount(bucket.word, t, len(bucket.words)).astype(np.int64) for t in samples]
        heavy = np.flatnonzero(bucket.heavy)
        here = [np.bincount(bucket.context, x, len(bucket.contexts)).astype(np.int64)[heavy] for x in (bucket.customers, *samples)]
        word_owner, context_owner = layout.owner_of(bucket.words), layout.owner_of(bucket.contexts[heavy])
        bodies = []
        for owner in range(layout.buckets):
            w, u = np.flatnonzero(word_owner == owner), np.flatnonzero(context_owner == owner)
            parts = [bucket.words[w]]
            for x in (seen, *served):
                parts += split_small(x[w])
            parts.append(bucket.contexts[heavy][u])
            for x in here:
                parts += split_small(x[u])
            bodies.append(pack(*parts))
        free = bucket.customers > 1
        bodies.append(pack(*(x for t in samples for x in split_small(t[free]))))
        owners = np.append(np.arange(layout.buckets), -1 - number)
        return pa.table({"owner": owners, "bucket": np.full(len(owners), number), "body": pa.array(bodies, pa.binary())})

    return run


def _replies(layout: Layout):
    """From an owner of words to every bucket: the words' counts and tables in the parent, and heavy contexts' totals."""

    def run(key, table):
        if key[0].as_py() < 0:
            return table.select(["bucket", "owner", "body"])
        rng = np.random.default_rng([layout.seed, key[0].as_py(), 2])
        word_table = log_stirling(WORD_DISCOUNT)
        order = np.argsort(table.column("bucket").to_numpy())
        buckets = table.column("bucket").to_numpy()[order]
        words, contexts, word_counts, context_counts = [], [], [], []
        for i in order:
            parts = unpack(table.column("body")[int(i)].as_py())
            words.append(next(parts))
            word_counts.append([join_small(parts) for _ in range(1 + SAMPLES)])
            contexts.append(next(parts))
            context_counts.append([join_small(parts) for _ in range(1 + SAMPLES)])

        def summed(keys, counts):
            values, at = np.unique(np.concatenate(keys), return_inverse=True)
            return np.split(at, np.cumsum([len(k) for k in keys])[:-1]), [
                np.bincount(at, np.concatenate([c[k] for c in counts]), len(values)).astype(np.int64) for k in range(1 + SAMPLES)
            ]

        word_at, (seen, *served) = summed(words, word_counts)
        context_at, totals = summed(contexts, context_counts)
        flat = np.full(len(seen), 1 / (layout.words + 1))
        tables = []
        for customers in served:
            t = np.minimum(customers, 1)
            for _ in range(BURN_IN):
                # The other owners' tables are taken to be as many as here: words are spread by hash.
                t = sample_tables(customers, layout.buckets * t.sum() - t, flat, WORD_DISCOUNT, WORD_STRENGTH, word_table, rng)
            tables.append(t)
        head = np.array([seen.sum(), (seen > 0).sum(), *(c.sum() for c in served), *(t.sum() for t in tables)], "<i8")
        bodies = []
        for w, u in zip(word_at, context_at, strict=True):
            parts = [head]
            for x in (seen, *served, *tables):
                parts += split_small(x[w])
            for x in totals:
                parts += split_small(x[u])
            bodies.append(pack(*parts))
        return pa.table({"bucket": buckets, "owner": np.full(len(buckets), key[0].as_py()), "body": pa.array(bodies, pa.binary())})

    return run


SUMS = "chunk bigint, kind bigint, body binary"


def _scores(layout: Layout):
    """Each chunk's sums over documents of what a bucket's word pairs are worth; lists of documents pass through."""

    def run(key, table, replies):
        bucket = Bucket(table, layout)
        own = replies.column("owner").to_numpy()
        samples = bucket.tables(replies.column("body")[int(np.flatnonzero(own < 0)[0])].as_py())
        replies = replies.take(pa.array(np.flatnonzero(own >= 0)))
        word_owner = layout.owner_of(bucket.words)
        heavy = np.flatnonzero(bucket.heavy)
        context_owner = layout.owner_of(bucket.contexts[heavy])
        seen = np.zeros(len(bucket.words), np.int64)
        served, parent = (np.zeros((SAMPLES, len(bucket.words)), np.int64) for _ in range(2))
        eaters = np.bincount(bucket.context, bucket.customers, len(bucket.contexts)).astype(np.int64)
        laid = np.array([np.bincount(bucket.context, t, len(bucket.contexts)) for t in samples]).astype(np.int64)
        head = np.zeros(2 + 2 * SAMPLES, np.int64)
        for owner, body in zip(replies.column("owner").to_numpy(), replies.column("body"), strict=True):
            parts = unpack(body.as_py())
            head = head + next(parts)
            w = np.flatnonzero(word_owner == owner)
            seen[w] = join_small(parts)
            for k in range(SAMPLES):
                served[k, w] = join_small(parts)
            for k in range(SAMPLES):
                parent[k, w] = join_small(parts)
            u = heavy[context_owner == owner]
            eaters[u] = join_small(parts)
            for k in range(SAMPLES):
                laid[k, u] = join_small(parts)
        probability = np.zeros(len(bucket.customers))
        for k in range(SAMPLES):
            base = word_probability(served[k], parent[k], head[2 + k], head[2 + SAMPLES + k], float(head[1]))[bucket.word]
            own = np.maximum(bucket.customers - PAIR_DISCOUNT * samples[k], 0)
            new = PAIR_STRENGTH + PAIR_DISCOUNT * laid[k]
            total = (PAIR_STRENGTH + eaters)[bucket.context]
            known = eaters[bucket.context] > 0
            probability += np.where(known, (own + new[bucket.context] * base) / total, base) / SAMPLES
        score = np.log10(np.maximum(probability, 1e-300))
        # The norm goes off each token, not off the sum, so that equal parts leave nothing.
        plain = (np.log10(seen + 0.5) - np.log10(head[0] + 0.5 * (head[1] + 1)))[bucket.word]
        found = (seen > 0)[bucket.word]
        chunks, bodies = [], []
        edges = np.cumsum([0, *bucket.sizes])
        for i, chunk in enumerate(bucket.chunks):
            pair = np.repeat(bucket.pair[edges[i] : edges[i + 1]], bucket.tokens[i])
            docs, at = np.unique(bucket.docs[i], return_inverse=True)
            sums = [np.bincount(at, x[pair], len(docs)) for x in (score, plain, found)]
            bodies.append(pack(narrow(docs), sums[0], sums[1], narrow(sums[2].astype(np.int64)), head[:2].astype("<i8")))
            chunks.append(chunk)
        lists = np.flatnonzero(table.column("kind").to_numpy() == 1)
        bodies += [table.column("body")[int(i)].as_py() for i in lists]
        chunks += table.column("chunk").to_numpy()[lists].tolist()
        kinds = np.repeat([0, 1], [len(bodies) - len(lists), len(lists)])
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "kind": kinds, "body": pa.array(bodies, pa.binary())})

    return run


def _documents(key: str, kind: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(-table.column("kind").to_numpy(), kind="stable")
        first, *rest = (table.column("body")[int(i)].as_py() for i in order)
        ids, missing, train, tokens = unpack(first)
        score, plain, known, head = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(2, np.int64)
        for body in sorted(rest):
            docs, a, b, c, head = unpack(body)
            score[docs] += a
            plain[docs] += b
            known[docs] += c.astype(np.int64)
        return pa.table(
            {
                key: pa.array(ids, mask=missing.astype(bool)).cast(kind),
                "trained": train.astype(bool),
                "n_tokens": tokens.astype(np.int64),
                "n_known": known,
                "train_tokens": np.full(len(ids), head[0]),
                "base_score": plain,
                "score": score,
            }
        )

    return run


def score_corpus(docs: DataFrame, key: str, text: str, training: Column, seed: int = 20) -> DataFrame:
    """Train on the rows for which ``training`` holds and score every row.

    Returns ``key`` (long), ``trained``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (log10 probability under counts plus one half) and ``score`` (log10 probability under the model,
    averaged over samples of its seating). Tokens are runs of bytes other than ASCII white space, ASCII letters folded,
    and one end for each text; null texts are empty and hold the end alone. A null in ``training`` is no. Keys may be
    null or repeated, each row is scored; other columns are ignored, an empty table gives no rows, and without
    training rows every probability is the base's.

    A word is a dish of its context's restaurant (the word before it); all of these share one parent, which serves from
    an even base over the known words and one unknown. Tasks read chunks of documents and send each bucket of contexts
    its word pairs, once per chunk however frequent; a bucket samples its restaurants, with a parent of its own, and
    sends the tables of each sample to the owners of the words, who seat the shared parent; with their replies the
    bucket values its pairs and sends sums per document back to the chunks. Contexts with more than HEAVY_SHARE of all
    tokens are spread over the buckets by word, and their totals meet at an owner as well. Nothing but the layout passes
    through the driver. Chunks are numbered by task, so input must be read in the same order when a task is repeated,
    as files are.
    """
    picked = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    layout = plan_layout(picked.select("text", "train"), seed)
    packets = picked.mapInArrow(_chunks(layout, "id"), PACKET)
    grouped = packets.groupBy("bucket")
    requests = grouped.applyInArrow(_requests(layout), REQUEST)
    replies = requests.groupBy("owner").applyInArrow(_replies(layout), "bucket bigint, owner bigint, body binary")
    sums = grouped.cogroup(replies.groupBy("bucket")).applyInArrow(_scores(layout), SUMS)
    schema = f"`{key}` bigint, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return sums.groupBy("chunk").applyInArrow(_documents(key, pa.int64()), schema)
