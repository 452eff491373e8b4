"""Token sequences by power-of-two decomposition of documents."""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import FOLD, SLICE_BYTES, byte_slices, fresh_names, ragged_ranges, text_buffer

PIECES = (
    "piece_start bigint, piece_length bigint, ids binary, doc_tokens bigint, sequence_id bigint, sequence_offset bigint, batch_id bigint"
)
_NAMES = [x.split()[0] for x in PIECES.split(", ")]

# Rows numbered by one task; Spark's own monotonically increasing ids leave as many.
_PER_TASK = 1 << 33

# Bytes of pieces and their ids that a worker remembers, some 400,000 pieces.
KNOWN_BYTES = 64 << 20
# What a remembered piece takes besides its text and ids.
_ENTRY = 150

# Words of Latin letters that stay as they are when normalised, and how many are encoded side by side.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_JOINED = 512

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


class Pieces:
    """Token ids of pieces of text, remembered within a worker.

    When KNOWN_BYTES are taken, the half goes that was not asked for of late.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        upper = string.ascii_uppercase
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # Whether capitals may be folded first, and letters and digits be parted from stops.
        self.folds = normalizer is not None and normalizer.normalize_str(upper) == upper.lower()
        self.splits = splitter is not None and [x for x, _ in splitter.pre_tokenize_str("ab.c,d;e:f!g?h.i")] == list(
            re.findall("[a-z]+|[^a-z]", "ab.c,d;e:f!g?h.i")
        )
        # Which ids end a word, where a tokenizer marks that: words side by side can then be told apart.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if self.folds and self.splits and suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.taken = 0

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are not remembered; plain words are encoded many at a time, as each has one end."""
        plain = [i for i, p in enumerate(pieces) if self.ends is not None and _PLAIN.fullmatch(p)]
        out: list = [None] * len(pieces)
        texts = [" ".join([pieces[i] for i in plain[low : low + _JOINED]]) for low in range(0, len(plain), _JOINED)]
        for n, coded in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(coded.ids, np.uint32)
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            body = ids.tobytes()
            start = 0
            for i, stop in zip(plain[n * _JOINED : (n + 1) * _JOINED], stops, strict=True):
                out[i] = body[start:stop]
                start = stop
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, coded in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", coded.ids).tobytes()
        return out

    def ids(self, pieces: list[str]) -> list[bytes]:
        recent, older = self.recent, self.older
        found = [recent.get(p) for p in pieces]
        absent = [i for i, ids in enumerate(found) if ids is None]
        for i in absent:
            found[i] = older.get(pieces[i])
        missing = [i for i in absent if found[i] is None]
        for i, ids in zip(missing, self.encode([pieces[i] for i in missing]), strict=True):
            found[i] = ids
        for i in absent:
            p, ids = pieces[i], found[i]
            recent[p] = ids
            self.taken += len(p) + len(ids) + _ENTRY
        if self.taken > KNOWN_BYTES // 2:
            self.recent, self.older, self.taken = {}, recent, 0
        return found


_KNOWN: dict[str, Pieces] = {}


def known_pieces(path: str) -> Pieces:
    """The remembered pieces of a tokenizer file, once per process."""
    if path not in _KNOWN:
        _KNOWN[path] = Pieces(path)
    return _KNOWN[path]


def encode_texts(column, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts (null: empty) in one array, and the offset of each text.

    For tokenizers that drop white space and never join across it: texts are cut at blanks and line ends, and where the
    tokenizer allows it, capitals are folded and stops parted from letters, so that few pieces differ.
    """
    data, offsets = text_buffer(column)
    inside = (data != 32) & (data != 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    if known.folds:
        angle = np.flatnonzero(data == 60)
        # A word with an angle bracket may hold a special token, whose case counts.
        word = np.cumsum(start) if len(angle) else None
        kept = np.isin(word, word[angle]) if len(angle) else None
        data = np.where(kept, data, FOLD[data]) if len(angle) else FOLD[data]
    if known.splits:
        stop, alnum = _STOP[data], _ALNUM[data]
        start[1:] |= (stop[1:] & alnum[:-1] | alnum[1:] & stop[:-1]) & inside[1:]
    packed = data[inside]
    at = np.concatenate([np.flatnonzero(start[inside]), [len(packed)]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(packed))
    coded = pc.dictionary_encode(words)
    ids = known.ids(coded.dictionary.to_pylist())
    counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), np.uint32)
    first = np.cumsum(counts) - counts
    code = coded.indices.to_numpy(zero_copy_only=False)
    per_word = counts[code] if len(code) else np.zeros(0, np.int64)
    tokens = flat[ragged_ranges(first[code], per_word)] if len(code) else np.zeros(0, np.uint32)
    total = np.concatenate([[0], np.cumsum(per_word)])
    return tokens, total[np.searchsorted(np.flatnonzero(start), offsets)]


def binary_pieces(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut runs of ``lengths`` into powers of two, the largest first, none above ``longest`` (itself one).

    Returns the lengths of all pieces, run by run, and the number of pieces of each run.
    """
    bits = longest.bit_length() - 1
    powers = 1 << np.arange(bits, -1, -1, dtype=np.int64)
    counts = np.empty((len(lengths), bits + 1), np.int64)
    counts[:, 0] = lengths >> bits
    counts[:, 1:] = (lengths[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.repeat(np.tile(powers, len(lengths)), counts.ravel()), counts.sum(axis=1)


def pack_documents(
    docs: DataFrame, keys: list[str], text: str, tokenizer_path: str, end_id: int = 1, longest: int = 2048, batch_tokens: int = 16384
) -> DataFrame:
    """One row per piece: ``keys`` and PIECES, with ``ids`` as little-endian unsigned 32-bit numbers.

    A document's tokens are those of its text (null or empty: none) and ``end_id``. Each piece is a sequence of its
    own whose length is a power of two up to ``longest``, so that no sequence crosses documents and none is padded.
    Equal lengths share a bucket, and a bucket's pieces fill batches of ``batch_tokens`` in turn: all sequences of a
    ``batch_id`` are equally long, and each task leaves at most one batch of each length unfilled. Sequence and batch
    ids count from the task's number times 2**33; repeated rows give sequences of their own. No documents give no
    rows; ``keys`` may be null and have any name but those of PIECES, other columns are ignored, and no shuffle takes
    place.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    if batch_tokens < longest:
        raise ValueError("a batch must hold the longest sequence")
    if clash := {x.lower() for x in keys} & set(_NAMES):
        raise ValueError(f"keys have names of results: {sorted(clash)}")
    name, = fresh_names(keys, "text")
    picked = docs.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias(name))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keys)]) + ", " + PIECES
    buckets = longest.bit_length()

    def run(batches):
        known = known_pieces(tokenizer_path)
        number = batch_number = TaskContext.get().partitionId() * _PER_TASK
        # Of each bucket: pieces in its open batch, and the number of that batch.
        filled, batch_of = np.zeros(buckets, np.int64), np.full(buckets, -1, np.int64)
        room = batch_tokens >> np.arange(buckets)
        for batch in byte_slices(batches, len(keys), 2 * SLICE_BYTES):
            tokens, at = encode_texts(batch.column(len(keys)), known)
            sizes = np.diff(at) + 1
            ends = np.cumsum(sizes)
            ids = np.full(int(ends[-1]), end_id, np.uint32)
            ids[ragged_ranges(ends - sizes, sizes - 1)] = tokens
            lengths, per_doc = binary_pieces(sizes, longest)
            stops = np.cumsum(lengths)
            row = np.repeat(np.arange(len(sizes)), per_doc)
            starts = stops - lengths - (ends - sizes)[row]
            bucket = np.log2(lengths).astype(np.int64)
            batch_ids = np.empty(len(lengths), np.int64)
            for b in np.unique(bucket).tolist():
                rows = np.flatnonzero(bucket == b)
                place = filled[b] + np.arange(len(rows))
                fresh = place // room[b]
                # The open batch is filled up first, then new ones are numbered.
                batch_ids[rows] = np.where((fresh == 0) & (batch_of[b] >= 0), batch_of[b], batch_number + fresh - (batch_of[b] >= 0))
                batch_number += int(fresh[-1]) + (batch_of[b] < 0)
                batch_of[b], filled[b] = batch_ids[rows[-1]], place[-1] % room[b] + 1
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], stops * 4])), pa.py_buffer(ids.astype("<u4"))]
            ).cast(pa.binary())
            taken = [batch.column(k).take(pa.array(row)) for k in range(len(keys))]
            numbers = number + np.arange(len(lengths))
            number += len(lengths)
            results = [starts, lengths, packed, sizes[row], numbers, np.zeros(len(lengths), np.int64), batch_ids]
            yield pa.RecordBatch.from_arrays([*taken, *map(pa.array, results[:2]), packed, *map(pa.array, results[3:])], [*keys, *_NAMES])

    return picked.mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces bucket by bucket, one folder for each length, so that a reader batches equal lengths only."""
    pieces.write.partitionBy("piece_length").parquet(path)
