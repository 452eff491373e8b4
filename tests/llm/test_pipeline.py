"""The pipeline on rows with everything a stage may meet, each stage held against a plain rule."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.edges import LONG, PLAIN

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = [f"word{i}" for i in range(300)]
ITEM = " ".join(f"bench{i}" for i in range(14))
SECRET = "api_key = 'Zx81kQ7pLm20aB'"


def write_tables(spark, path):
    rng = random.Random(12)

    def prose(n):
        return " ".join(rng.choices(VOCABULARY, k=n))

    rows, toxic = [], []
    for i in range(240):
        bad = i % 6 == 0
        toxic.append((i, 1, int(bad)))
        rows.append((i, prose(60) + (" hateful slur insult" * 8 if bad else ""), "en", "a", 0))
    base = prose(100)
    near = base.split()
    near[50] = "changed"
    rows += [(1001, base, "en", "a", 0), (1002, base, "en", "b", 0), (1003, " ".join(near), None, None, None)]
    rows += [(1100, prose(40) + " " + ITEM + " " + prose(40), "en", "a", 0), (1101, ITEM, "en", "a", 0)]
    rows += [(1200, prose(30) + "\n" + SECRET + "\n" + prose(30), "en", "a", 0)]
    rows += [(1300, None, None, None, None), (1301, "", "en", "a", 0), (1302, " \n", "en", "a", 2), (None, PLAIN, "en", "a", 63), (1303, LONG, "en", "a", len(LONG)), (1304, "☃ 漢字 ünï", "de", "b", 8)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("item", ITEM), (None, None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_each_stage_decides_and_passes_on(spark, tmp_path):
    rows = write_tables(spark, tmp_path)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(docs.collect())
    ids = [[r["doc_id"] for r in part] for part in kept]
    bad = {i for i in range(240) if i % 6 == 0}
    assert len(bad & set(ids[0])) <= 2 and set(range(240)) - bad <= set(ids[0])
    assert {1001, 1002, 1003} & set(ids[1]) == {1001} and len(ids[1]) == len(set(ids[1]))
    assert {1300, 1301} & set(ids[1]) == {1300} and None in ids[1]
    texts = {r["doc_id"]: r["text"] for r in kept[2]}
    assert 1101 not in texts and "bench0" not in texts[1100] and texts[1303] == LONG
    before = {r["doc_id"]: r["text"] for r in kept[1]}
    assert all(texts[i] == before[i] for i in texts if i not in (1100,))
    redacted = {r["doc_id"]: r["text"] for r in kept[3]}
    assert "Zx81kQ7pLm20aB" not in redacted[1200] and all(redacted[i] == texts[i] for i in texts if i != 1200)
    packed: dict = {}
    for r in sorted(kept[4], key=lambda r: r["piece_start"]):
        packed.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert packed == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in redacted.items()}
    assert len(rows) > len(ids[1]) > 190


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
