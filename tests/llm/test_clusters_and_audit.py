"""Drake's bounds against full scans, and the divergence audit against all pairs and all terms."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chatloom.llm import divergence, drake_kmeans


def lloyd(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in seeds]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, j) in zip(kept, nearest()):
            groups[j].append(v)
        for j, vs in groups.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    found = nearest()
    own = Counter()
    for d, j in found:
        own[j] += d
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for (i, _), (d, j) in zip(kept, found)), key=repr)


def got(found):
    return sorted((tuple(r)[:6] for r in found.collect()), key=repr)


@pytest.mark.parametrize("k, bounds, dims, scale", [(16, 4, 64, 64), (16, 1, 3, 64), (7, 6, 2, 3), (30, 3, 5, 1 << 15), (5, 9, 4, 64), (1, 4, 2, 64)])
def test_clusters_equal_full_scans(spark, k, bounds, dims, scale):
    r = random.Random(k)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [r.gauss(x, 0.3) for x in r.choice(centres)]) for i in range(400)]
    rows += [(i % 7, rows[i % 3][1]) for i in range(20)] + [(None, [0.5] * dims), (None, [0.5] * dims)]
    rows += [(900, None), (901, []), (902, [0.1] * (dims + 1)), (903, [float("nan")] * dims), (904, [float("inf")] * dims), (905, [None] * dims)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    found = drake_kmeans.cluster(table, k, 3, dims, scale, bounds)
    assert got(found) == lloyd(rows, k, 3, dims, scale)
    if k == 16 and dims == 3:
        # The bounds spare distances.
        assert sum(x.measured for x in found.collect()) < 0.8 * 4 * 16 * found.count()


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([(1, [0.25, -0.25]), (2, [0.25, -0.25]), (3, None)], "vec_id long, embedding array<float>")
    assert got(drake_kmeans.cluster(table, 16, 3, 2)) == lloyd([(1, [0.25, -0.25]), (2, [0.25, -0.25])], 16, 3, 2, 64)
    for empty in (table.limit(0), table.filter("vec_id = 3")):
        assert drake_kmeans.cluster(empty, 16, 3, 2).count() == 0
    with pytest.raises(Exception, match="beyond"):
        drake_kmeans.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 16, 3, 2).collect()


def test_distances_of_the_largest_components(spark):
    most = drake_kmeans.largest(64)
    assert 64 * (2 * most) ** 2 < 1 << 63 <= 64 * (2 * most + 2) ** 2
    rows = [(i, [s * most / 64.0] * 64) for i, s in enumerate([1, -1, 1, -1, 0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(drake_kmeans.cluster(table, 2)) == lloyd(rows, 2, 3, 64, 64)


def test_bounds_hold_and_ties_go_to_the_smaller_number():
    r = np.random.default_rng(3)
    v = r.integers(-3, 4, (500, 2))
    c = r.integers(-3, 4, (12, 2))
    b = drake_kmeans.Bounds(v, c, 3)
    b.scan(np.arange(len(v)))
    for _ in range(6):
        d = np.sqrt(((v[:, None] - c) ** 2).sum(2))
        assert (b.cluster == d.argmin(1)).all() and (b.upper >= d.min(1)).all()
        assert (np.take_along_axis(d, b.next, 1) >= b.lows).all()
        for i in range(len(v)):
            others = sorted(set(range(12)) - {int(b.cluster[i]), *b.next[i].tolist()})
            assert (d[i][others] >= b.rest[i]).all()
        new = c + r.integers(-1, 2, c.shape)
        moved = drake_kmeans._moved(c, new)
        b.c = c = new
        b.shift(moved)
        b.settle()
    large = np.array([[1 << 26, -(1 << 26)], [5, 7]])
    assert (drake_kmeans.squared(large, large) == [[0, ((1 << 26) - 5) ** 2 + ((1 << 26) + 7) ** 2]] * 1 + [[((1 << 26) - 5) ** 2 + ((1 << 26) + 7) ** 2, 0]]).all()


def audit(rows, least, top):
    """The contract, term by term and pair by pair."""
    fold = lambda t: "".join(ch.lower() if "A" <= ch <= "Z" else ch if "a" <= ch <= "z" or ord(ch) > 127 else " " for ch in t or "")
    docs = [(la or "", so or "", [w for w in fold(t).split(" ") if w]) for la, so, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(w for d in docs if d[0] == lang for w in set(d[2]))
        kept = {w for w, n in seen.items() if n >= least}
        count = {so: Counter() for la, so, _ in docs if la == lang}
        for la, so, ws in docs:
            if la == lang:
                count[so].update(w for w in ws if w in kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q, p = share(sum(count.values(), Counter())), {so: share(c) for so, c in count.items()}
        for so in count:
            pairs = [(sum(abs(p[so][w] - p[x][w]) for w in kept), x) for x in count if x != so]
            terms = [(p[so][w] - q[w], w) for w in kept if count[so][w] and p[so][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, so, part, item, value, n + 1) for n, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("side", [512, 3])
def test_audit_equals_all_terms_of_all_pairs(spark, monkeypatch, side):
    r = random.Random(side)
    words = [f"{a}{b}" for a in "aBcdé漢" for b in ("x", "Y", "ß", "zz")] + ["İ", "\u212a", "rare"]
    rows = []
    for i in range(300):
        source = "src0" if i % 3 == 0 else f"src{r.randrange(8)}"
        mine = words[: 6 + int(source[3:]) * 2]
        text = "".join(r.choice(mine) + r.choice([" ", "-", "9", "\n", "\x00", "_", "　"]) for _ in range(r.randrange(1, 60)))
        rows.append((r.choice(["en", "en", "de", None]), source, text))
    rows += [rows[0]] * 40 + [("en", None, None), ("en", "", ""), ("en", "tiny", "bY"), ("xx", "one", "too few documents"), ("xx", "two", None), ("yy", "alone", "x"), ("en", "long", "aX " * 200_000 + "q" * 300_000)]
    docs = spark.createDataFrame([(la, so, t, 1, "x") for la, so, t in rows], "lang string, source string, text string, n int, term string").repartition(5)
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "HELD", 50)
    assert sorted(map(tuple, divergence.divergence(docs, 30, 7).collect())) == audit(rows, 30, 7)


def test_terms_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 3)
    assert divergence.term_counts("Ab,cd  efghij\nÉa É\x00ab \u212a".encode()) == {b"ab": 2, b"cd": 1, b"efghij": 1, "Éa".encode(): 1, "É".encode(): 1, "\u212a".encode(): 1}


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence(docs).count() == 0
