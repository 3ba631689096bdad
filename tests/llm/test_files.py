"""Flat token files and shard compaction."""

import random

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from chatloom.llm import bpe, shards, token_files

PATTERN = public_tokenizers.PATTERN
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(ids, sep):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == sep:
            out.append((start, i - start, True))
            start = i + 1
    return out + [(start, len(ids) - start, False)] * (start < len(ids))


@pytest.mark.parametrize("block,span", [(8, 2), (64, 3), (1 << 20, 1024)])
def test_scan_equals_brute_force(spark, tmp_path, block, span):
    r = random.Random(block)
    files = {}
    for k, (n, p) in enumerate([(0, 0.5), (1, 1), (1, 0), (700, 0.1), (700, 0.005), (300, 0.9), (513, 0.02)]):
        ids = [0 if r.random() < p else r.randint(1, 9) for _ in range(n)]
        path = tmp_path / f"{k}.tokens"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        files[f"file://{path}"] = (ids, 2 * n)
    table = spark.createDataFrame([(f, n) for f, (_, n) in files.items()], "file string, length long")
    got = {}
    for row in token_files.scan(table, 0, "<u2", block, span).collect():
        got.setdefault(row.file, []).append((row.ordinal, row.start, row.n_tokens, row.closed))
    for f, (ids, _) in files.items():
        assert sorted(got.get(f, [])) == [(i, *x) for i, x in enumerate(brute(ids, 0))]


def test_count_documents(spark):
    texts = [None, "", "a", "a", "the cat " * 9000, "x y\n\n z"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    c = bpe.Codec(bpe.vocabulary(RANKS), PATTERN)
    want = sorted((str(i if i != 3 else None), len(c.encode(t or "")) // 4) for i, t in enumerate(texts))
    got = token_files.count_documents(docs, RANKS, PATTERN, 50256, block_bytes=4096).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert all(r.closed for r in got)
    assert token_files.count_documents(docs.limit(0), RANKS, PATTERN, 50256).count() == 0


def test_identifiers_fit_whatever_the_separator(spark, tmp_path):
    """A vocabulary of more than 65,536 identifiers with a free low one as the separator."""
    import base64

    ranks = {bytes([b]): b for b in range(256)}
    free = 300
    rank = 256
    for a in range(256):
        for b in range(256):
            rank += 1 + (rank + 1 == free)
            ranks[bytes([a, b])] = rank
    path = tmp_path / "large.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    assert max(ranks.values()) >= 1 << 16 and free not in ranks.values()
    texts = ["a\xffz\u0101 \U0001f642 " * 50, "", "\xff" * 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = bpe.Codec(bpe.vocabulary(str(path)), PATTERN)
    got = {r.doc_id: r.n_tokens for r in token_files.count_documents(docs, str(path), PATTERN, free).collect()}
    assert got == {i: len(c.encode(t)) // 4 for i, t in enumerate(texts)}
    rows, dtype = token_files.write_token_files(docs, str(path), PATTERN, free)
    assert dtype == "<u4"
    for taken in (301, -1):
        with pytest.raises(ValueError):
            token_files.write_token_files(docs, str(path), PATTERN, taken)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_shards_merge_and_versions_stay_whole(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=20_000, fan=3, base_bytes=1000)
    schema = "doc_id long, text string, shard_bin string, shard_number int, `Shard_Path` string"
    rows = [(i if i % 7 else None, None if i % 11 == 0 else "t" * (i % 90), "clash", i % 3, "x") for i in range(400)] + [(5, "long " * 20_000, "clash", 0, "x")] * 3
    assert store.version() == 0 and store.read(schema).count() == 0 and store.compact() is None and store.sweep(0) == 0
    docs = spark.createDataFrame(rows, schema)
    for part in shards.arrivals(docs, 4):
        store.append(part.repartition(3))
    v = store.version()
    assert v == 4
    before = store.entries().collect()
    planned = {(r.path, r.bin) for r in store.plan().collect()}
    last = store.compact_all()
    after = store.entries().collect()
    assert last > v and len(after) < len(before) and sum(r.rows for r in after) == len(rows)
    # Each bin of the first round became one file, and no tier is full any more.
    first = store.entries(v + 1).filter(f"version = {v + 1}").collect()
    assert len(first) == len({b for _, b in planned}) and all(r.bytes < 2 * store.target for r in first)
    names = docs.schema
    assert rows_of(store.read(names)) == rows_of(store.read(names, v)) == rows_of(docs)
    assert store.compact() is None
    with pytest.raises(shards.Conflict):
        store._commit(store.entries(), last)
    assert store.expire() >= len(before)
    assert rows_of(store.read(names)) == rows_of(docs)
    store.append(docs.limit(0))
    assert store.read(names).count() == len(rows)


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    make = lambda: shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=10_000, fan=2, base_bytes=1000)
    one, two = make(), make()
    docs = spark.range(100).withColumn("text", F.lit("abc"))
    for part in shards.arrivals(docs, 4, "id"):
        one.append(part.coalesce(1))
    commit = shards.ShardStore._commit

    def late(self, entries, version):
        """The other writer is first, once."""
        monkeypatch.setattr(shards.ShardStore, "_commit", commit)
        two.append(spark.range(100, 110).withColumn("text", F.lit("new")).coalesce(1))
        return commit(self, entries, version)

    monkeypatch.setattr(shards.ShardStore, "_commit", late)
    assert one.append(spark.range(200, 205).withColumn("text", F.lit("mine")).coalesce(1)) == 6
    monkeypatch.setattr(shards.ShardStore, "_commit", late)
    version = one.compact()
    assert version == 8 and one.read("id long, text string").count() == 125

    def gone(self, entries, version):
        """The other writer has merged the same shards."""
        monkeypatch.setattr(shards.ShardStore, "_commit", commit)
        two.compact()
        return commit(self, entries, version)

    for part in shards.arrivals(docs, 4, "id"):
        one.append(part.coalesce(1))
    monkeypatch.setattr(shards.ShardStore, "_commit", gone)
    with pytest.raises(shards.Conflict):
        one.compact()
    want = rows_of(one.read("id long, text string"))
    assert len(want) == 225
    one.expire()
    assert one.sweep(3600) == 0
    assert one.sweep(0) > 0 and rows_of(one.read("id long, text string")) == want and one.sweep(0) == 0
