"""Exact de-duplication and source mixing against brute force."""

import hashlib
import re

from collections import Counter, defaultdict

import pytest
import regex

from chatloom.llm import chunk_dedup, cube_mix

TEXTS = [
    "a b", "a  b", "a\tb\n", "a b ", None, "", " ", "\n\n", "a b", "é " * 3000, "é " * 3000, "One. Two! " * 900, "One. Two! " * 900 + "x", "nosentence" * 2000, "nosentence" * 2000,
]


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_dedup_equals_brute_force(spark, bits):
    rows = [(i if i != 8 else 0, t, 1, True) for i, t in enumerate(TEXTS)] + [(None, "only null id", 1, True), (None, "a b", 2, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id long, kept boolean").repartition(3)
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    want = []
    for i, t, *_ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r)[:5] for r in chunk_dedup.exact_dedup(docs, hash_bits=bits).collect()]
    assert Counter(got) == Counter(want)
    assert chunk_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_chunks_join_to_the_text_and_survive_an_edit(spark):
    pattern = regex.compile(chunk_dedup.chunk_pattern(256, 4096).replace(r"\z", r"\Z"))
    text = " ".join(f"Sentence number {i} says {i * i % 97}." for i in range(800))
    cut = lambda t: [m.group(0) for m in pattern.finditer(t)]
    assert "".join(cut(text)) == text
    edited = "New start. " + text
    assert len(set(cut(text)) & set(cut(edited))) > 0.8 * len(cut(text))


def brute_targets(sizes, weights, most):
    """The contract's own words: share by weight, stop, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    t, total = dict.fromkeys(order, 0.0), sum(sizes.values())
    left, open_ = float(total), set(order)
    while left > 1e-9 and open_:
        share = sum(w[s] for s in open_)
        give = {s: left * w[s] / share for s in open_}
        left = 0.0
        for s in list(open_):
            t[s] += give[s]
            if t[s] > most * sizes[s]:
                left += t[s] - most * sizes[s]
                t[s] = most * sizes[s]
                open_.discard(s)
    return t


def test_mix_meets_its_targets(spark):
    rows = []
    for i in range(9000):
        source = [None, "a", "b", "é", "z", "hot", "hot", "hot", "hot"][i % 9] if i % 50 else "tiny"
        rows.append((i, " ".join(["w"] * (i * 7919 % 400)), source, 5, 0.5))
    rows += [(9001, None, "empty", 1, 0.1), (9002, "x y", "a", 1, 0.1), (9002, "x y", "a", 1, 0.1), (None, "q", "a", 1, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, p double")
    got = cube_mix.mix(docs, block=500).collect()
    assert len(got) == len(rows)
    sizes, taken, units = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        units[r.source] += r.copies
        assert r.taken == r["size"] * r.copies and r.copies <= 3
    want = brute_targets(sizes, (1, 2, 3), 3.0)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * 400, (s, taken[s], t)
        if sizes[s]:
            n = sum(1 for r in got if r.source == s)
            assert abs(units[s] - n * t / sizes[s]) <= 2
    again = cube_mix.mix(docs.repartition(7), block=500).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert cube_mix.mix(docs.limit(0)).count() == 0


def test_only_colliding_chunks_move(spark, monkeypatch):
    from chatloom.llm.runtime import Steps

    rows = [(i, f"Text {i} of many. " + "x" * 300) for i in range(40)] + [(40 + i, f"Text {i} of many. " + "x" * 300) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, cut = {}, Steps.cut

    def counted(self, df, label):
        out = cut(self, df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(Steps, "cut", counted)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in chunk_dedup.exact_dedup(docs, low=8, high=512, hash_bits=8).collect()}
    assert got == {i: (i % 40, 2 if i % 40 < 3 else 1) for i in range(43)}
    hashes = [r.h for r in spark.createDataFrame([(t,) for _, t in rows], "c string").selectExpr("explode(regexp_extract_all(c, '%s', 0)) as c" % chunk_dedup.chunk_pattern(8, 512).replace("\\", "\\\\")).distinct().selectExpr("shiftrightunsigned(xxhash64(c), 56) as h").collect()]
    shared = {h for h, n in Counter(hashes).items() if n > 1}
    assert 0 < len(shared) == written["chunk-collisions"]
    assert written["colliding-chunks"] < written["recipes"] and written["recipes"] == len(rows)


def test_hot_recipes_and_empty_ids(spark):
    """A third of the rows are one text."""
    rows = [(i if i % 5 else None, "the same text" if i % 3 == 0 else f"text {i}") for i in range(300)]
    found = chunk_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.group_size for r in found) == {100: 100, 1: 200}
    assert {r.keep_id for r in found if r.group_size == 100} == {3}
