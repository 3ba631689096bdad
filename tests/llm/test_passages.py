"""Repeated passages against brute force over all windows of words."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chatloom.llm import paragraph_dedup, passages, queries, words
from chatloom.llm.paragraph_dedup import repeated_paragraphs


def brute(rows, least):
    """{(doc, start): (first doc, first start, places)} of the windows that repeat, for distinct ids and texts."""
    at = defaultdict(list)
    for i, text in rows:
        w = (text or "").split()
        for s in range(len(w) - least + 1):
            at[tuple(w[s : s + least])].append((i is None, i, s))
    return {p[1:]: (*min(places)[1:], len(places)) for places in at.values() if len(places) > 1 for p in places}


def spread(found, least):
    """The same of spans; their runs must be longest ones."""
    out, links = {}, {}
    for x in found:
        for s in range(x.n_words - least + 1):
            assert (x.doc_id, x.start_word + s) not in out
            out[x.doc_id, x.start_word + s] = (x.class_doc, x.class_word + s)
        links[x.doc_id, x.start_word, x.n_words] = x.n_links
        assert x.kept == ((x.doc_id, x.start_word) == (x.class_doc, x.class_word))
    return out, links


@pytest.mark.parametrize("least, gram", [(51, 26), (7, 4), (5, 5), (6, 1)])
def test_passages_equal_brute_force(spark, least, gram):
    r = random.Random(least)
    words = [f"w{i}" for i in range(3000 if least > 9 else 40)]
    line = lambda n: [r.choice(words) for _ in range(n)]
    base, rows = [line(r.randint(least, 3 * least)) for _ in range(8)], []
    for i in range(60):
        t = line(r.randrange(2 * least))
        for _ in range(r.randrange(3)):
            p = r.choice(base)
            a = r.randrange(len(p) - least + 1)
            t += p[a : r.randint(a + least - 1, len(p))] + line(r.randrange(5))
        rows.append((i, "".join(w + r.choice(" \n\t  ") for w in t) + f" end{i}"))
    rows += [(60, None), (61, ""), (62, "a b c " * least), (None, " ".join(base[0]) + " last"), (63, " ".join(base[1][:least - 1]))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, k int").repartition(3)
    got, links = spread(passages.repeated_passages(docs, least, gram).collect(), least)
    want = brute(rows, least)
    assert got == {p: v[:2] for p, v in want.items()}
    for (i, s, n), m in links.items():
        assert m == max(want[i, x][2] for x in range(s, s + n - least + 1)) - 1


def test_copies_are_spans_and_nothing_is_nothing(spark):
    r = random.Random(3)
    text = " ".join(str(r.random()) for _ in range(80))
    rows = [(4, text), (4, text), (2, text.replace(" ", "\n")), (None, text), (7, "x " + text), (9, "short text"), (9, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, passages.repeated_passages(docs).drop("text_hash").collect()), key=repr)
    want = [(2, 0, 80, 2, 0, 4, True), (4, 0, 80, 2, 0, 4, False), (None, 0, 80, 2, 0, 4, False), (7, 1, 80, 2, 0, 4, False)]
    assert got == sorted(want, key=repr)
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_the_query_finds_passages_in_longer_lines_and_across_short_ones(spark, tmp_path):
    r = random.Random(8)
    line = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    passage = line(60)
    parts = passage.split()
    rows = [(1, line(200) + " " + passage + " " + line(200)), (2, line(30) + "\n" + "\n".join(" ".join(parts[i : i + 12]) for i in range(0, 60, 12))), (3, line(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert repeated_paragraphs(docs).count() == 0
    found = queries.op10_paragraph_dedup(spark, str(tmp_path)).select("doc_id", "start_word", "n_words", "class_doc", "class_word", "kept").collect()
    assert sorted(map(tuple, found)) == [(1, 200, 60, 1, 200, True), (2, 30, 60, 1, 200, False)]


def test_removal_keeps_one_of_each_and_the_rest(spark):
    r = random.Random(11)
    line = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    p, q = line(70), line(55)
    rows = [(1, "  head " + p + "\n\ntail  "), (2, line(9) + "\t" + p + " " + q), (3, q + "\n" + line(20) + "\n" + p), (4, None), (5, line(80) + "  x"), (None, q)]
    docs = spark.createDataFrame([(t, i, "a", 1, True, 3) for i, t in rows], "text string, doc_id long, spans string, start_word int, kept boolean, row int")
    found = passages.repeated_passages(docs)
    cut = passages.remove_passages(docs, found)
    assert cut.columns == docs.columns
    got = {x.doc_id: x.text for x in cut.collect()}
    first = rows[1][1].split("\t")[0]
    assert got == {1: rows[0][1], 2: first + "\t" + q, 3: "\n".join(rows[2][1].split("\n")[1:2]) + "\n", 4: None, 5: rows[4][1], None: ""}
    assert {tuple(x)[1:] for x in cut.collect()} == {(i, "a", 1, True, 3) for i, _ in rows}
    assert passages.repeated_passages(cut).count() == 0
    assert passages.remove_passages(docs.limit(0), found).count() == 0


def test_removal_tells_rows_of_one_id_apart(spark):
    r = random.Random(13)
    line = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    p, q, other = line(70), line(80), line(60)
    rows = [(1, p), (2, p), (2, q), (None, p), (None, other), (3, None), (3, q + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {tuple(x) for x in passages.remove_passages(docs, passages.repeated_passages(docs)).collect()}
    assert cut == {(1, p), (2, ""), (2, q), (None, ""), (None, other), (3, None), (3, "end")}
    cut = {tuple(x) for x in paragraph_dedup.remove_paragraphs(docs, repeated_paragraphs(docs)).collect()}
    assert cut == {(1, p), (2, ""), (2, q), (None, ""), (None, other), (3, None), (3, "")}


def test_words_and_stretches_of_two_letters_in_any_base():
    """Two strings that agree modulo 2^64 in every odd base."""
    signs = [0]
    while len(signs) < 4096:
        signs += [1 - x for x in signs]
    one, two = ("".join(c[x] for x in signs) for c in ("ab", "ba"))
    h, _ = words.word_hashes(pa.array([one, two, "x" * 70_000, "x" * 70_000 + " " + one + " " + "x" * 70_001]))
    assert len(set(h.tolist())) == 4 and h[2] == h[3] and h[0] == h[4]
    values = np.array([5, 1 << 63], np.uint64)
    x, y = values[signs], values[::-1][signs]
    for base in (3, 0xD1342543DE82EF95):
        powers = words.Powers(base)
        found = powers.hashes(powers.sums(np.concatenate([x, y, x])), np.array([0, 4096, 8192]), np.array([4096, 8192, 12288]))
        assert found[0] == found[2] != found[1]


def test_products_modulo_the_prime():
    r = random.Random(14)
    edge = [0, 1, words.PRIME - 1, words.PRIME - 2, 1 << 60, (1 << 31) - 1, 1 << 31]
    a, b = zip(*[(x, y) for x in edge for y in edge], *[(r.randrange(words.PRIME), r.randrange(words.PRIME)) for _ in range(500)])
    assert words.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % words.PRIME for x, y in zip(a, b)]
    big = [0, words.PRIME, 2**64 - 1, words.PRIME + 1]
    assert words.reduced(np.array(big, np.uint64)).tolist() == [x % words.PRIME for x in big]


def test_shuffled_joins_find_the_same(spark, monkeypatch):
    """Beyond the rows that may be broadcast."""
    from chatloom.llm import minhash

    r = random.Random(12)
    line = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    base = [line(60) for _ in range(6)]
    docs = spark.createDataFrame([(i if i % 9 else None, r.choice(base) + (" x" if i % 2 else " ") + line(r.choice([0, 5, 60]))) for i in range(60)], "doc_id long, text string")
    small = [sorted(map(str, f.collect())) for f in (passages.repeated_passages(docs), minhash.near_duplicates(docs.withColumnRenamed("doc_id", "id")))]
    monkeypatch.setattr(passages, "FEW", 0)
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "WEIGHT", 200)
    assert small == [sorted(map(str, f.collect())) for f in (passages.repeated_passages(docs), minhash.near_duplicates(docs.withColumnRenamed("doc_id", "id")))]


def test_edited_passages_are_found_wherever_lines_break(spark):
    """Nine in ten at least of the passages whose word 5-grams stay similar by 0.8."""
    r = random.Random(21)
    words_ = [f"w{i}" for i in range(20_000)]
    line = lambda n: [r.choice(words_) for _ in range(n)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def put(p):
        if r.random() < 0.5:
            return " ".join(line(100) + p + line(100))
        return "\n".join(" ".join(x) for x in [line(10), *(p[i : i + 12] for i in range(0, len(p), 12)), line(10)])

    rows, similar = [], []
    for k in range(150):
        p = line(r.randint(55, 150))
        q = list(p)
        for _ in range(r.choice([1, 1, 2])):
            q[r.randrange(len(q))] = r.choice(words_)
        rows += [(2 * k, put(p)), (2 * k + 1, put(q))]
        if len(grams(p) & grams(q)) >= 0.8 * len(grams(p) | grams(q)):
            similar.append(k)
    clean = [(1000 + i, " ".join(line(200))) for i in range(50)]
    found = {x.doc_id for x in passages.repeated_passages(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert len(similar) > 100 and sum({2 * k, 2 * k + 1} <= found for k in similar) >= 0.9 * len(similar)
    assert not found & {i for i, _ in clean}
