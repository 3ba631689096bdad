"""Cases that several operators share: very long texts, and tables without rows."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import cube_mix, katz, queries, shards, token_files, weak_quality

LONG = "A long text, of many words and lines.\n" * 40_000


@pytest.fixture
def docs(spark):
    rows = [(i, f"Some words of document {i}, and more of them than one.", "en", f"s{i % 2}", 1) for i in range(60)]
    rows += [(60, LONG, "en", "s0", 1), (61, LONG, "en", "s1", 1), (62, None, None, None, None), (63, "x" * 1_500_000, "en", "s0", 1), (None, "", "", "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)


def test_long_texts_are_judged_whole(docs):
    got = {r.doc_id: r for r in weak_quality.classify(docs).collect()}
    assert len(got) == 65 and got[60].score == got[61].score
    kept = weak_quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert weak_quality.keep_good(docs.limit(0)).count() == 0


def test_long_texts_are_scored_and_mixed_whole(docs):
    scores, _ = katz.katz(docs, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r for r in scores.collect()}
    words = len(LONG.split())
    assert got[60].n_tokens == got[61].n_tokens == words + 1 and got[60].score == got[61].score
    assert got[63].n_tokens == 2 and all(math.isfinite(r.score) for r in got.values())
    mixed = {r.doc_id: r for r in cube_mix.mix(docs).collect()}
    assert mixed[60].size == words and mixed[63].size == 1 and mixed[62].size == 0
    assert all(r.taken <= 3 * r.size for r in mixed.values())


def test_long_texts_are_stored_and_counted_whole(spark, docs, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=100_000, fan=2, base_bytes=1000)
    for part in shards.arrivals(docs, 3):
        store.append(part)
        store.compact()
    store.compact_all()
    assert {r.doc_id: len(r.text or "") for r in store.read(docs.schema).collect()} == {r.doc_id: len(r.text or "") for r in docs.collect()}
    counted = {r.doc_id: r for r in token_files.count_documents(docs, queries.RANKS, queries.PATTERN, queries.END_OF_DOCUMENT, block_bytes=1 << 16).collect()}
    assert counted[60].n_tokens == counted[61].n_tokens > 300_000 and counted[62].n_tokens == counted[None].n_tokens == 0
    assert token_files.count_documents(docs.limit(0), queries.RANKS, queries.PATTERN, queries.END_OF_DOCUMENT).count() == 0


def test_every_stage_takes_a_table_without_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), "")
        assert out.count() == 0, name
