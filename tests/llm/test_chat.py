from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.chat import chat_digests, format_chats, read_turns, unescape

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, n_turns string"
ROWS = [
    (1, 0, "user", "Hi <|end|> there", "", ""),
    (1, 1, "assistant", "</s>[INST] ok [/INST]\\", "", ""),
    (1, 2, "assistant", None, "", ""),
    (2, 0, None, "no role", "", ""),
    (2, 0, None, "no role", "", ""),
    (2, None, "assistant", "first, as its turn is null ☃", "", ""),
    (None, 0, "assistant", "", None, None),
    (3, 0, "assistant", "long " * 50_000, "", ""),
    (3, 1, "us<er\n[x]\\", "odd role", "", ""),
]


def grouped():
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = {}
    for conv, _, role, text, *_ in order:
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_round_trip_and_loss(spark):
    chats = format_chats(spark.createDataFrame(ROWS, SCHEMA).repartition(3), ["conv_id"], "turn", "role", "text")
    rows = {r["conv_id"]: r for r in chats.collect()}
    expected = grouped()
    assert {k: read_turns(r["formatted"]) for k, r in rows.items()} == expected
    for k, r in rows.items():
        assert [unescape(r["formatted"][s["start"] : s["stop"]]) for s in r["spans"]] == [t for role, t in expected[k] if role == "assistant"]
        assert r["n_turns"] == len(expected[k])
    assert "</s>" not in rows[1]["formatted"] and "[INST]" not in rows[1]["formatted"]
    got = {r["conv_id"]: r for r in chat_digests(chats, "conv_id").collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]\\").hexdigest()
    assert got[2]["loss_chars"] == len("first, as its turn is null ☃")


def test_small_slices_give_the_same(spark, monkeypatch):
    from tidemark.llm import columns

    frame = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    whole = sorted(map(str, format_chats(frame, ["conv_id"], "turn", "role", "text").collect()))
    monkeypatch.setattr(columns.byte_slices, "__defaults__", (7,))
    assert sorted(map(str, format_chats(frame, ["conv_id"], "turn", "role", "text").collect())) == whole


def test_no_turns(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA), ["conv_id"], "turn", "role", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="<[\\|>ab/é☃\n", max_size=12), min_size=1, max_size=5))
def test_escape_is_reversible(texts):
    import pyarrow as pa

    from tidemark.llm.chat import escape
    from tidemark.llm.columns import text_buffer

    data, offsets = escape(*text_buffer(pa.array(texts)))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        escaped = data[a:b].tobytes().decode()
        assert unescape(escaped) == text
        assert not any(c in escaped for c in ("<|", "[a", "</", "<s"))
