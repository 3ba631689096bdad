"""Near-duplicate operators and components against brute force."""

import random
from collections import defaultdict

import pytest

from chatloom.llm import minhash, ngram_join, paragraph_dedup
from chatloom.llm.components import components


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    """{id: (class, links, kinds)} of (id, text) rows with distinct ids."""
    sets = {i: grams(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, kinds = defaultdict(int), defaultdict(set)
    ids = [i for i, _ in rows]
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                if a != b:
                    kinds[i].add(frozenset(b))
                    kinds[j].add(frozenset(a))
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (find(i), links[i], len(kinds[i])) for i in ids}


def corpus(r, n):
    words = [f"w{i}" for i in range(500)]
    rows, base = [], [[r.choice(words) for _ in range(r.randint(3, 120))] for _ in range(n // 4)]
    for i in range(n):
        t = list(r.choice(base[:3] if r.random() < 0.4 else base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "one"), (n + 5, "a b c d"), (n + 6, "a\tb c  d"), (n + 7, "long word " * 30_000), (n + 8, "long word " * 30_000 + "x")]


@pytest.mark.parametrize("tile", [512, 16])
def test_ngram_join_equals_brute_force(spark, tile):
    rows = corpus(random.Random(tile), 240)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "id long, text string, key int, n int")
    got = {r.id: (r.class_id, r.n_links, r.n_class_links) for r in minhash.near_duplicates(docs.select("id", "text"), tile=tile).collect()}
    assert got == brute(rows)


def test_ngram_join_on_ties_nulls_and_nothing(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (None, "z"), (2, None), (1, "p q r s t u v")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    got = sorted(map(str, ngram_join.ngram_join(docs).select("doc_id", "class_id", "n_links").collect()))
    want = [(1, 1, 2), (1, 1, 2), (None, 1, 2), (None, None, 1), (None, None, 1), (2, 2, 0), (1, 1, 0)]
    assert got == sorted(f"Row(doc_id={a}, class_id={b}, n_links={c})" for a, b, c in want)
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_paragraphs(spark):
    r = random.Random(5)
    line = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    passage, other, short = line(60), line(55), line(20)
    near = passage.replace(" ", " q ", 1)
    rows = [(i, "\n".join([line(45), short, [passage, near, other, line(70)][i % 4], line(8)])) for i in range(40)]
    rows += [(40, None), (41, ""), (42, other + "\n" + other), (None, passage)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, para string")
    found = paragraph_dedup.repeated_paragraphs(docs)
    got = {(x.doc_id, x.para): ((x.class_doc, x.class_para), x.n_links, x.kept) for x in found.collect()}
    want = {}
    for i in range(40):
        if i % 4 < 2:
            want[i, 2] = ((0, 2), 20, i == 0)
        elif i % 4 == 2:
            want[i, 2] = ((2, 2), 11, i == 2)
    want |= {(42, 0): ((2, 2), 11, False), (42, 1): ((2, 2), 11, False), (None, 0): ((0, 2), 20, False)}
    assert got == want
    cleaned = {x.doc_id: x.text for x in paragraph_dedup.remove_paragraphs(docs, found).collect()}
    assert cleaned[40] is None and cleaned[42] == "" and cleaned[0] == rows[0][1]
    assert cleaned[4] == "\n".join(x for k, x in enumerate(rows[4][1].split("\n")) if k != 2)
    assert paragraph_dedup.repeated_paragraphs(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 199), (200, 200), (5, 5), (300, 301), (301, 300), (None, 1)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {199: 199, 200: 199, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bands_reach_the_recall():
    bands, rows = minhash.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= minhash.MOST_HASHES
