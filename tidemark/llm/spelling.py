"""Spelling variants of a corpus' words, found by pivotal grams."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import FOLD, SLICE_BYTES, byte_slices, mix, ragged_ranges, span_hashes, text_buffer
from tidemark.session import settle

# Letters of a word: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
# Grams of a word's prefix: one edit touches at most two bigrams, so of three one is left.
PREFIX = 3

_LETTER_BYTES = np.zeros(256, bool)
_LETTER_BYTES[97:123] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


_CRC = _crc_table()


def crc32_spans(states: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each byte span after the text whose crc32 is its state, all spans byte by byte side by side."""
    order = np.argsort(-lengths, kind="stable")
    crc, at = ~states[order].astype(np.uint32), starts[order]
    counts = np.bincount(lengths) if len(lengths) else np.zeros(1, np.int64)
    left = len(lengths) - np.cumsum(counts)  # spans longer than each length
    for i in range(len(counts) - 1):
        n = left[i]
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + i]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[order] = ~crc
    return out


def spell_runs(keys: list[str], column, least: int, every: int) -> pa.LargeStringArray:
    """The words of all runs of letters in the texts, those left with fewer than ``least`` letters excepted.

    A run is lower-cased in A-Z. Where ``every`` divides the crc32 h of its text's key, a colon and the run, letter
    number h modulo its length is left out.
    """
    raw, offsets = text_buffer(column)
    data = FOLD[raw]
    lead = data == _LEAD
    inside = _LETTER_BYTES[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(first)])
    letters = before[ends] - before[starts]
    long = letters >= least
    starts, ends, letters = starts[long], ends[long], letters[long]

    states = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    h = crc32_spans(states[owner] if len(starts) else np.zeros(0, np.uint32), data, starts, ends - starts)
    hit = np.flatnonzero(h % np.uint32(every) == 0)
    gone = np.flatnonzero(first)[before[starts[hit]] + h[hit] % letters[hit]] if len(hit) else hit
    width = np.where(data[gone] == _LEAD, 2, 1) if len(hit) else hit

    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    drop = ragged_ranges(at[hit] + gone - starts[hit], width)
    packed = np.delete(data[ragged_ranges(starts, sizes)], drop)
    sizes[hit] -= width
    words = pa.LargeStringArray.from_buffers(
        len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(packed)
    )
    letters[hit] -= 1
    return words.filter(pa.array(letters >= least)) if len(hit) else words


def count_words(docs: DataFrame, key: str, text: str, least: int, every: int) -> DataFrame:
    """``word, n`` of ``spell_runs`` over all texts; counts are added up within slices and tasks before they move."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in byte_slices(batches, "text", 4 * SLICE_BYTES):
            words = spell_runs(batch.column("key").to_pylist(), batch.column("text"), least, every)
            found = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_letters(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, the byte where each letter starts and the end, letters as numbers, and each word's first."""
    data, offsets = text_buffer(column)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    after = data[np.minimum(at + 1, len(data) - 1)] if len(at) else at
    number = np.where(data[at] == _LEAD, 26 + after.astype(np.int64) - 0x80, data[at].astype(np.int64) - 97)
    return data, np.concatenate([at, [len(data)]]), number, np.searchsorted(at, offsets)


def word_grams(number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, place and code of every pair of neighbouring letters."""
    counts = np.maximum(np.diff(first) - 1, 0)
    at = ragged_ranges(first[:-1], counts)
    word = np.repeat(np.arange(len(counts)), counts)
    code = number[at] * LETTERS + number[at + 1] if len(at) else at
    return word, at, code


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each of the LETTERS ** 2 bigrams stands in the words, added up per task and then over tasks."""

    def run(batches):
        total = np.zeros(LETTERS**2, np.int64)
        for batch in batches:
            _, _, number, first = word_letters(batch.column("word"))
            total += np.bincount(word_grams(number, first)[2], minlength=LETTERS**2)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    out = np.zeros(LETTERS**2, np.int64)
    # At most LETTERS ** 2 rows, whatever the corpus.
    for r in words.select("word").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def gram_prefixes(word: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each word's PREFIX rarest grams and of all equal to the last of these, in text order; and each word's
    last rank. Rows of a word are consecutive and in text order."""
    order = np.lexsort((at, rank, word))
    sizes = np.bincount(word) if len(word) else np.zeros(0, np.int64)
    firsts = np.cumsum(sizes) - sizes
    last = rank[order[firsts + np.minimum(PREFIX, sizes) - 1]] if len(word) else rank
    return np.flatnonzero(rank <= last[word]) if len(word) else order, last


def pivots(word: np.ndarray, place: np.ndarray, rank: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the rows of the two disjoint grams of its prefix of least cost, the left one and the right one.

    Dynamic programming over the grams in text order: ``best`` holds the cheapest single gram so far (by ``rank``, the
    order of costs), and each gram is joined to the cheapest one that ends before it starts (of the earlier ones only
    the next neighbour can overlap, as places differ).
    """
    n = len(word)
    if not n:
        return word, word
    bits = n.bit_length()
    # Later words lie below all earlier ones, so that one running minimum serves every word by itself.
    value = ((rank - word * LETTERS**2) << bits) | np.arange(n)
    best = np.minimum.accumulate(value)
    fresh = np.concatenate([[True], word[1:] != word[:-1]])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rows = np.arange(n)
    apart = np.zeros(n, bool)
    apart[1:] = place[1:] - place[:-1] >= 2
    back = rows - np.where(apart, 1, 2)
    ok = back >= begin
    partner = best[np.maximum(back, 0)] & ((1 << bits) - 1)
    total = np.where(ok, cost + cost[partner], np.iinfo(np.int64).max)
    order = np.lexsort((rows, total, word))
    right = order[np.flatnonzero(fresh)]
    return partner[right], right


def _sides(gram_at: np.ndarray, low: np.ndarray, high: np.ndarray, pivot: bool):
    """Letter spans that one edit leaves whole, as ``(row, kind, span, second span)``, around the grams at ``gram_at``
    of words that reach from ``low`` to ``high``.

    An edit right of a gram leaves the word whole up to the gram's end, and one half of what follows; an edit left of
    it, the word from the gram on and one half of what precedes. Halves are those of the pivot's word, so the other
    word, shorter or longer by one letter at most, takes both sizes its partner's half may have.
    """
    rows = np.arange(len(gram_at))
    stop = gram_at + 2
    rest, before = high - stop, gram_at - low
    for step in (0,) if pivot else (-1, 1):
        for kind in range(4):
            room = rest if kind < 2 else before
            # The halves nearer to the word's start take the odd letter's lack, the others the odd letter.
            size = (room + step) // 2 if kind in (0, 3) else (room + step + 1) // 2
            ok = (size >= 0) & (size <= room)
            r, n = rows[ok], size[ok]
            lo, hi, at, end = low[ok], high[ok], gram_at[ok], stop[ok]
            if kind == 0:
                yield r, kind, (lo, end + n), (lo, lo)
            elif kind == 1:
                yield r, kind, (lo, end), (hi - n, hi)
            elif kind == 2:
                yield r, kind, (at - n, hi), (hi, hi)
            else:
                yield r, kind, (lo, lo + n), (at, hi)


def _keys(batch: pa.RecordBatch, counts: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
    data, start, number, first = word_letters(batch.column("word"))
    word, at, code = word_grams(number, first)
    chosen, last = gram_prefixes(word, at, ranks[code])
    word, at, code = word[chosen], at[chosen], code[chosen]
    left, right = pivots(word, at, ranks[code], counts[code])
    owners, keys, roles = [], [], []
    for rows, pivot in ((np.arange(len(word)), False), (left, True), (right, True)):
        for r, kind, one, two in _sides(at[rows], first[word[rows]], first[word[rows] + 1], pivot):
            # A left pivot serves edits on its right, a right pivot those on its left.
            if pivot and (kind < 2) != (rows is left):
                continue
            spans = [span_hashes(data, start[lo], start[hi]) for lo, hi in (one, two)]
            owners.append(word[rows[r]])
            keys.append(mix(mix(spans[0] + np.uint64(kind + 1)) + spans[1]))
            roles.append(np.full(len(r), pivot))
    owner = np.concatenate(owners)
    taken = pa.array(owner)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(keys).view(np.int64)),
            pa.array(np.concatenate(roles)),
            pa.array(last[owner].astype(np.int32)),
            batch.column("word").take(taken),
            batch.column("n").take(taken),
        ],
        ["key", "pivot", "last", "word", "n"],
    )


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, other_n`` for all pairs of the distinct words that differ by one letter, both ways round.

    Words of at least four letters a-z and U+00C0 to U+00FF with their counts ``n``; other columns are ignored. Every
    word has a prefix, its rarest grams, and two pivots, the cheapest disjoint grams of it. An edit spares one pivot
    at least, which also lies in the other word's prefix if that reaches at least as far in the order of grams. If the
    edit is right of the left pivot, both words are equal up to that pivot's end; else they are equal from the right
    pivot on. So pivots meet prefix grams only where places agree from that side, and where half of the other side is
    whole too (``_sides``): buckets stay short in large vocabularies. Keys are hashes; the words decide.
    """
    counts = gram_counts(words)
    ranks = np.empty(len(counts), np.int64)
    ranks[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))

    def run(batches):
        for batch in batches:
            yield _keys(batch, counts, ranks)

    schema = "key bigint, pivot boolean, last int, word string, n bigint"
    keys = settle(words.select("word", "n").mapInArrow(run, schema), "word-grams")
    probes = keys.where("pivot").drop("pivot")
    index = keys.where("not pivot").select("key", F.col("last").alias("other_last"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    close = (
        probes.join(index, "key")
        .where("last < other_last or (last = other_last and word < other)")
        .where("abs(char_length(word) - char_length(other)) <= 1")
        .where(F.levenshtein("word", "other", 1) == 1)
    )
    ways = F.array(
        F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )
    return close.select(F.explode(ways).alias("p")).select("p.*").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain of forms, by joining chains end to end."""
    chain = settle(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain = settle(chain.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        if chain.where("moved").isEmpty():
            return chain.select("word", "root")
        chain = chain.drop("moved")


def spelling_variants(
    docs: DataFrame, key: str, text: str, least_letters: int = 6, least_count: int = 5, factor: int = 5, every: int = 199
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words come from ``spell_runs`` over the whole texts (null: none) and are kept with ``least_letters`` letters and
    ``least_count`` occurrences, ``n``. Words that differ by exactly one inserted, deleted or replaced letter are
    near; ``n_near`` counts them. A word's form is its near word of largest ``n`` (ties: the smallest by code points)
    if that has at least ``factor`` times the word's ``n``, else null; ``root`` follows forms to the last.

    Keys may be null (as an empty key) or repeated; every row counts. No texts or no words give no rows; other columns
    are ignored. Counts are added up map-side, so frequent words are no hot keys, and the only table that comes to the
    driver is that of bigram counts, LETTERS squared in number.
    """
    if least_letters < 4:
        raise ValueError("words need at least four letters: three bigrams")
    words = settle(count_words(docs, key, text, least_letters, every).where(F.col("n") >= least_count), "words")
    top = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    per_word = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), top.alias("top"))
    out = words.join(per_word, "word", "left")
    enough = F.coalesce(-F.col("top.n") >= factor * F.col("n"), F.lit(False))
    out = settle(
        out.select(
            "word",
            F.when(enough, F.col("top.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, -F.col("top.n")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
