from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.llm.edges import ROWS, documents
from tidemark.llm import packing
from tidemark.llm.packing import binary_pieces, encode_texts, pack_documents, write_buckets

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("taken", [1, 48 << 20])
def test_pieces_encode_as_whole_texts(tokenizer, monkeypatch, taken):
    monkeypatch.setattr(packing, "KNOWN_BYTES", taken)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:80]
    texts += [None, "", " ", "a b c\td", "it's  <|endoftext|> x<|startoftext|>y", "é ́x ΑΣ ΑΣ\nİ ǅ", "12 345,6"]
    texts += ["IT'S We'Ll a.'s b:'re, C.D;E ...x? 3.14 v1.2.", "<|ENDOFTEXT|> A<|endoftext|>.B", "I\u0307 A\u030a.A ;\u0338x", "don't.'ll I.I'd", "ÀÉ.x Σ.Σ"]
    known = packing.Pieces(PATH)
    assert known.folds and known.splits
    for part in (texts[:50], texts[50:], texts[20:60]):
        tokens, at = encode_texts(pa.array(part, pa.string()), known)
        assert [tokens[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole(tokenizer, t) for t in part]
    assert known.taken <= taken // 2


def test_random_texts_encode_as_whole(tokenizer):
    rng = np.random.default_rng(1)
    letters = list("aBcS'.,;:!? \n-<|>é3") + ["'s", "'LL", "<|endoftext|>", " The", "ﬁ", "\u0301"]
    texts = ["".join(rng.choice(letters, 40)) for _ in range(400)]
    tokens, at = encode_texts(pa.array(texts, pa.string()), packing.Pieces(PATH))
    assert [tokens[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole(tokenizer, t) for t in texts]


def test_binary_pieces():
    lengths, counts = binary_pieces(np.array([1, 7, 8, 21, 0]), 8)
    assert lengths.tolist() == [1, 4, 2, 1, 8, 8, 8, 4, 1]
    assert counts.tolist() == [1, 3, 1, 4, 0]


def test_every_id_is_in_one_piece(spark, tokenizer):
    rows = pack_documents(documents(spark).repartition(3), ["doc_id"], "text", PATH, longest=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    found: dict = {}
    for r in sorted(rows, key=lambda r: r["piece_start"]):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["piece_length"] and r["piece_length"] & (r["piece_length"] - 1) == 0 and r["piece_length"] <= 64
        assert r["sequence_offset"] == 0
        found.setdefault(r["doc_id"], []).extend(ids)
    expected: dict = {}
    for doc_id, text, *_ in ROWS:
        expected.setdefault(doc_id, []).extend([*whole(tokenizer, text), 1])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert found[5] == expected[5]
    assert pack_documents(documents(spark).where("false"), ["doc_id"], "text", PATH).count() == 0
    with pytest.raises(ValueError):
        pack_documents(documents(spark), ["doc_id"], "text", PATH, longest=100)


def test_digest_is_of_the_ids(spark):
    from tidemark.llm.queries import op8_binary_packing

    row = op8_binary_packing(spark, "/root/testdata/sf0.001").first()
    assert 0 <= row["ids_crc32"] < 1 << 32 and row["offset"] == 0
    assert zlib.crc32(np.array([1], "<u4").tobytes()) > 0


def test_batches_hold_one_length(spark, tmp_path):
    frame = documents(spark, [(i, "word " * (i % 50), *[None] * 8) for i in range(300)]).repartition(2)
    pieces = pack_documents(frame, ["doc_id"], "text", PATH, longest=16, batch_tokens=32)
    held: dict = {}
    for r in pieces.collect():
        held.setdefault(r["batch_id"], []).append(r["piece_length"])
    assert all(len(set(v)) == 1 and sum(v) <= 32 for v in held.values())
    # Each of two tasks leaves one batch of a length unfilled at most.
    open_batches = [v[0] for v in held.values() if sum(v) < 32]
    assert max(map(open_batches.count, open_batches)) <= 2
    write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.groupBy("batch_id").agg({"piece_length": "sum"}).count() == len(held)


def test_names_of_keys(spark):
    frame = documents(spark).withColumnsRenamed({"doc_id": "text_", "row": "_text"}).select("text_", "_text", "text")
    got = pack_documents(frame, ["_text", "text_"], "text", PATH)
    assert got.columns[:2] == ["_text", "text_"] and got.count() >= 10
    with pytest.raises(ValueError):
        pack_documents(frame.withColumnRenamed("_text", "IDS"), ["IDS"], "text", PATH)
