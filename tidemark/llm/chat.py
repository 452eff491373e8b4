"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import byte_slices, ragged_ranges, text_buffer

# The template. In roles and texts every byte of ESCAPED is followed by a backslash, so that no marker, nor any
# other control string that opens with "<" or "[" and goes on without a backslash, can occur in them.
TURN, BODY, END = b"<|turn|>", b"<|text|>", b"<|end|>"
ESCAPED = b"<[\\"

_MARK = ord("\\")
_IS_ESCAPED = np.zeros(256, bool)
_IS_ESCAPED[list(ESCAPED)] = True
_MARKED = re.compile(r"([<\[\\])\\")

FORMATTED = "formatted string, spans array<struct<start:bigint,stop:bigint>>, n_turns bigint"


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the mark behind every escaped byte of a flat text column."""
    special = _IS_ESCAPED[data]
    moved = np.concatenate([[0], np.cumsum(special)])
    out = np.full(len(data) + int(moved[-1]), _MARK, np.uint8)
    out[np.arange(len(data)) + moved[:-1]] = data
    return out, offsets + moved[offsets]


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return _MARKED.sub(r"\1", text)


def assemble(roles, texts, groups: np.ndarray, loss_role: bytes = b"assistant"):
    """Format turns that stand in order; ``groups`` holds the first row of each conversation and the row count.

    Every turn is five segments: marker, role, marker, text, marker. Their lengths give cumulative offsets, and one
    scatter per kind copies all of them into a buffer allocated once. Returns the bytes, each conversation's offsets
    and, for the texts under the loss, their rows and code-point spans counted from their conversation's start.
    """
    raw_role, raw_role_at = text_buffer(roles)
    role, role_at = escape(raw_role, raw_role_at)
    text, text_at = escape(*text_buffer(texts))
    rows = len(role_at) - 1
    lengths = np.empty((rows, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(TURN), len(BODY), len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(rows, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, 4]) if rows else 0, np.uint8)
    for segment, marker in ((0, TURN), (2, BODY), (4, END)):
        out[starts[:, segment, None] + np.arange(len(marker))] = np.frombuffer(marker, np.uint8)
    for segment, data in ((1, role), (3, text)):
        out[ragged_ranges(starts[:, segment], lengths[:, segment])] = data

    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    at = np.concatenate([starts[:, 0], [len(out)]])[groups]
    wanted = np.diff(raw_role_at) == len(loss_role)
    for i, byte in enumerate(loss_role):
        wanted[wanted] = raw_role[raw_role_at[:-1][wanted] + i] == byte
    loss = np.flatnonzero(wanted)
    home = points[at[np.searchsorted(groups, loss, side="right") - 1]]
    return out, at, loss, points[starts[loss, 3]] - home, points[ends[loss, 3]] - home


def format_chats(turns: DataFrame, keys: list[str], order: str, role: str, text: str, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``keys``, ``formatted``, ``spans`` (the loss mask) and ``n_turns``.

    ``keys`` name a conversation; rows with the same keys are its turns, by ``order``, then role, then text, so that
    repeated turns have one result. Null order comes first; a null role or text counts as empty; null keys are a key
    like any other. ``spans`` holds, in code points of ``formatted``, the escaped text of every turn of
    ``loss_role``, empty ones too. Other columns are ignored. No turns give no rows.

    Turns are spread by key and sorted inside their partition, so only the conversation at hand and one batch are held.
    """
    assert not {"formatted", "spans", "n_turns"} & set(keys)
    picked = turns.select(
        *[F.col(k) for k in keys], F.col(order).alias("_order"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    )
    spread = picked.repartition(*keys).sortWithinPartitions(*keys, "_order", "_role", "_text").drop("_order")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keys)]) + ", " + FORMATTED

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in byte_slices(batches, "_text"):
            new = _new_group(batch, keys, held[-1] if held else None)
            if not new.any():
                held.append(batch)
                continue
            last = int(np.flatnonzero(new)[-1])
            done = pa.Table.from_batches([*held, batch.slice(0, last)]) if held or last else None
            if done is not None and done.num_rows:
                yield _formatted(done.combine_chunks().to_batches()[0], keys, loss_role.encode())
            held = [batch.slice(last)]
        if held:
            yield _formatted(pa.Table.from_batches(held).combine_chunks().to_batches()[0], keys, loss_role.encode())

    return spread.mapInArrow(run, schema)


def _new_group(batch: pa.RecordBatch, keys: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row starts a conversation, given the batch before."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
        if before is None or batch.column(k)[0].as_py() != before.column(k)[-1].as_py():
            new[0] = True
    return new


def _formatted(batch: pa.RecordBatch, keys: list[str], loss_role: bytes) -> pa.RecordBatch:
    first = np.flatnonzero(_new_group(batch, keys, None))
    groups = np.append(first, batch.num_rows)
    out, at, loss, start, stop = assemble(batch.column("_role"), batch.column("_text"), groups, loss_role)
    texts = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(loss, groups).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"])
    )
    columns = [batch.column(k).take(pa.array(first)) for k in keys]
    return pa.RecordBatch.from_arrays([*columns, texts, spans, pa.array(np.diff(groups))], [*keys, "formatted", "spans", "n_turns"])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    turns = []
    for piece in formatted.split(TURN.decode())[1:]:
        role, _, rest = piece.partition(BODY.decode())
        turns.append((unescape(role), unescape(rest.removesuffix(END.decode()))))
    return turns


def chat_digests(formatted: DataFrame, key: str) -> DataFrame:
    """Read formatted conversations back: counts and digests of turns and of the texts under the loss mask."""
    schema = f"{key} bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches):
        for batch in batches:
            rows = []
            for k, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((k, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return formatted.select(F.col(key).cast("bigint").alias(key), "formatted", "spans").mapInArrow(run, schema)
