"""The pipeline's stages against brute force, each on its own input."""

import re

import public_tokenizers
import pytest

import corpus_pipeline as C
from panelkiln.llm import common, pii

from .test_llm import DOC, WORDS, brute_bytes, brute_similar, corpus, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(11)
    d = tmp_path_factory.mktemp("data")
    rows = corpus(2)
    rows += [(1000 + i, " | ".join(rng.choice(WORDS) + "$$$ %%%" for _ in range(40))) for i in range(80)]
    rows += [(2000 + i, prose(rng, 60)) for i in range(80)]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", 0) for i, t in rows], DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 2000), 0) for i, _ in rows if i >= 1000], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    frames = []
    for name, stage in C.STAGES:
        docs = common.settle(stage(spark, docs, folder), name)
        frames.append(docs)
    good, near, cut, clean, packed = frames
    assert all(f.columns == columns for f in frames[:4])
    kept = {r.doc_id: r.text for r in good.collect()}
    assert not any(1000 <= i < 2000 for i in kept) and all(i in kept for i in before if i >= 2000)
    want = brute_similar(list(kept.items()))
    assert {r.doc_id for r in near.collect()} == {i for i in want if want[i] == i}
    rows = [(r.doc_id, r.text) for r in near.collect()]
    bytes_left = brute_bytes(rows)
    after = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in after.items()} == {i: b[3].decode(errors="ignore") for i, b in bytes_left.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert all(not pii.base_spans(r.text) for r in clean.collect())
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_run_and_order(spark, folder):
    from panelkiln.llm import packing

    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "personal_data", "packing"]
    got = C.run(spark, folder).collect()
    ids = {}
    for r in got:
        ids.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for own in ids.values():
        own.sort()
        assert sum(n for _, n, _ in own) == own[0][2] and own[0][0] == 0
    assert packing and public_tokenizers and re


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
