"""Benchmark decontamination with a suffix automaton over all items of a shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import FOLD, WORD_BYTES, byte_slices, fresh_names, hashed_words, text_buffer, word_spans
from tidemark.session import settle

# Words of one automaton; larger benchmarks are cut into shards of whole items, each broadcast and streamed over.
SHARD_WORDS = 200_000

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


class Automaton:
    """Generalised suffix automaton of the word ids of many items.

    ``follow``: transitions by state and word id; ``link``, ``length``: suffix links and longest lengths;
    ``items``: the items (by index) with the window that ends in a state; ``whole``: short items that end there.
    """

    def __init__(self, items: list[list[int]], window: int):
        self.window = window
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # Prefix ends know their items; sets of windows are gathered by walking to the state of window length.
        found: dict[int, set[int]] = {}
        self.whole: dict[int, set[int]] = {}
        for index, words in enumerate(items):
            state = 0
            for count, w in enumerate(words, 1):
                state = self.follow[state][w]
                if count >= window:
                    found.setdefault(self.cut(state), set()).add(index)
            if 0 < len(words) < window:
                self.whole.setdefault(state, set()).add(index)
        self.items = {k: np.array(sorted(v)) for k, v in found.items()}

    def _extend(self, last: int, w: int) -> int:
        follow, link, length = self.follow, self.link, self.length
        if w in follow[last]:
            q = follow[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p >= 0:
            q = follow[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        follow, link, length = self.follow, self.link, self.length
        copy = len(follow)
        follow.append(dict(follow[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and follow[p].get(w) == q:
            follow[p][w] = copy
            p = link[p]
        return copy

    def cut(self, state: int) -> int:
        """The state of the last ``window`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, words: list[int]):
        """For each word the longest match that ends with it: its length and state."""
        state = size = 0
        follow, link, length = self.follow, self.link, self.length
        for w in words:
            while state and w not in follow[state]:
                state = link[state]
                size = length[state]
            if w in follow[state]:
                state = follow[state][w]
                size += 1
            yield size, state


class Shard:
    """An automaton and the tables that find the stretches of a corpus worth streaming through it."""

    def __init__(self, names: list[str], words: list[np.ndarray], window: int):
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary, ids = np.unique(flat, return_inverse=True)
        ends = np.cumsum(sizes)
        self.names = names
        self.least = int(min(window, sizes.min(initial=window)))
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        self.pairs = np.unique(ids[:-1][inner[:-1]] * len(self.vocabulary) + ids[1:][inner[:-1]]) if len(flat) else np.zeros(0, np.int64)
        self.automaton = Automaton([ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)], window)

    def matches(self, words: np.ndarray, rows: np.ndarray):
        """Yield (row, start, stop, items) of each stretch of hits, positions counted in the row.

        Words outside the vocabulary, and neighbours that no item has in that order, end every match; only runs
        between them that are as long as the shortest window go through the automaton, word by word.
        """
        if not len(words) or not len(self.vocabulary):
            return
        ids = np.searchsorted(self.vocabulary, words)
        ids[ids == len(self.vocabulary)] = 0
        known = self.vocabulary[ids] == words
        pair = ids[:-1] * len(self.vocabulary) + ids[1:]
        joined = np.zeros(len(words), bool)  # with the word before
        if len(self.pairs):
            at = np.searchsorted(self.pairs, pair)
            at[at == len(self.pairs)] = 0
            joined[1:] = (self.pairs[at] == pair) & known[1:] & known[:-1]
        joined[rows[:-1][rows[:-1] < len(words)]] = False
        heads = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        worth = ends - heads >= self.least
        window, automaton = self.automaton.window, self.automaton
        for low, high in zip(heads[worth].tolist(), ends[worth].tolist(), strict=True):
            row = int(np.searchsorted(rows, low, side="right")) - 1
            for i, (size, state) in enumerate(automaton.stream(ids[low:high].tolist()), low - int(rows[row]) + 1):
                if size >= window:
                    yield row, i - size, i, automaton.items[automaton.cut(state)]
                if automaton.whole:
                    s = state
                    while s > 0:
                        if s in automaton.whole and automaton.length[s] <= size:
                            yield row, i - automaton.length[s], i, np.array(sorted(automaton.whole[s]))
                        s = automaton.link[s]


def _shards(benchmark: DataFrame, item: str, text: str, window: int):
    """Yield shards of whole items: SHARD_WORDS words and at most one item more, read one shard at a time."""

    def run(batches):
        for batch in byte_slices(batches, "text"):
            words, rows = hashed_words(batch.column("text"))
            parts = [words[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(parts, pa.binary())], ["item", "words"])

    picked = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    hashed = picked.mapInArrow(run, "item string, words binary").where(F.octet_length("words") > 0)
    names, words, held = [], [], 0
    for r in hashed.toLocalIterator():
        names.append(r["item"])
        words.append(np.frombuffer(r["words"], np.uint64))
        held += len(words[-1])
        if held >= SHARD_WORDS:
            yield Shard(names, words, window)
            names, words, held = [], [], 0
    if names:
        yield Shard(names, words, window)


def mark_leaks(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int, names: list[str], then=None) -> DataFrame:
    """``docs`` and three columns, called ``names``: count of words, hit spans (in words, merged) and items found.

    The corpus passes by one shard after the other, without a shuffle; between two shards it is written, so that a
    task holds one automaton (of some SHARD_WORDS words) at a time. ``then``, where given, makes batches of the columns
    of ``docs`` out of the marked ones in the last pass: a second Python operator would take a worker more for each task.
    """
    context = docs.sparkSession.sparkContext
    fields, at = docs.schema.names, docs.schema.names.index(text)
    wanted = docs.select("*", F.lit(None).cast("bigint"), F.lit(None).cast("array<struct<start:bigint,stop:bigint>>"), F.lit(None).cast("array<string>")).toDF(*fields, *names)
    schema, held = wanted.schema, None

    def adder(shard):
        def run(batches):
            for batch in byte_slices(batches, at):
                words, rows = hashed_words(batch.column(at))
                spans, items = ([x.to_pylist() for x in batch.columns[-2:]])
                for row, start, stop, found in shard.value.matches(words, rows):
                    spans[row] = [*(spans[row] or ()), {"start": start, "stop": stop}]
                    items[row] = {*(items[row] or ()), *(shard.value.names[k] or "" for k in found)}
                spans = [[{"start": a, "stop": b} for a, b in merged((x["start"], x["stop"]) for x in r or ())] for r in spans]
                added = [pa.array(np.diff(rows)), pa.array(spans, _SPANS), pa.array([sorted(x or ()) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *added], [*fields, *names])

        return run

    for shard in _shards(benchmark, item, item_text, window):
        if held is not None:
            wanted = settle(wanted.mapInArrow(adder(held), schema), "leaks")
        held = context.broadcast(shard)
    add = adder(context.broadcast(Shard([], [], window)) if held is None else held)
    return wanted.mapInArrow(add, schema) if then is None else wanted.mapInArrow(lambda batches: then(add(batches)), docs.schema)


def find_leaks(docs: DataFrame, keys: list[str], text: str, benchmark: DataFrame, item: str, item_text: str, window: int = 10) -> DataFrame:
    """One row per document: ``keys, n_words, hits, items``.

    Words are runs of ASCII letters (folded) and digits and of any other non-ASCII characters. A hit word lies in an
    occurrence of ``window`` consecutive words of an item, or of a whole item that has fewer; ``hits`` holds the
    stretches of hit words, merged. Null and empty texts have no words, and items without words are never found;
    ``items`` names each item id once (a null one as the empty string), sorted as text. Repeated documents are reported
    each, ``keys`` may be null and may have any names but those of the results, and other columns are ignored. An
    empty benchmark gives documents without hits.
    """
    picked = docs.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias(fresh_names(keys, "text")[0]))
    names = ["n_words", "hits", "items"]
    return mark_leaks(picked, picked.columns[-1], benchmark, item, item_text, window, names).select(*keys, *names)


def remove_leaks(
    docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int = 10, most: float = 0.5
) -> DataFrame:
    """``docs`` without leaked passages: hit spans go from ``text``; documents go if more than ``most`` of their words are hit.

    A span goes from its first word's first byte to its last word's last. Texts without hits (null ones too) stay as
    they are, as do all other columns and repeated rows.
    """
    fields = docs.schema.names
    at = fields.index(text)

    def cut(batches):
        for batch in batches:
            found, own = batch.column(len(fields) + 1), batch.columns[: len(fields)]
            hit = np.flatnonzero(found.value_lengths().to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, bool)
            if len(hit):
                data, offsets = text_buffer(batch.column(at))
                starts, ends, first = word_spans(FOLD[data], offsets, WORD_BYTES)
                texts = batch.column(at).to_pylist()
                for row in hit.tolist():
                    spans = [(x["start"], x["stop"]) for x in found[row].as_py()]
                    if sum(b - a for a, b in spans) > most * (first[row + 1] - first[row]):
                        keep[row] = False
                        continue
                    raw, base = data[offsets[row] : offsets[row + 1]].tobytes(), int(offsets[row])
                    parts, last = [], 0
                    for a, b in spans:
                        parts.append(raw[last : starts[first[row] + a] - base])
                        last = int(ends[first[row] + b - 1]) - base
                    texts[row] = (b"".join(parts) + raw[last:]).decode()
                own[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(own, fields).filter(pa.array(keep))

    return mark_leaks(docs, text, benchmark, item, item_text, window, fresh_names(fields, "n_words", "hits", "items"), cut)


def merged(spans) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]
