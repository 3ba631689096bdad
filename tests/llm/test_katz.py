"""Katz backoff against a plain model in dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chatloom.llm import katz


class Plain:
    """The model's definition, word by word; contexts are tuples, the start None."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order)]
        for t in texts:
            for gram in self.grams(t, order):
                for n in range(1, order + 1):
                    self.counts[n - 1][gram[-n:]] += 1
        self.d = []
        for c in self.counts:
            of = Counter(c.values())
            self.d.append(katz.Discounts.of([of[r] for r in range(1, katz.SMALL + 2)], sum(c.values()), len(c)))
        self.totals = [defaultdict(int) for _ in range(order)]
        for n, c in enumerate(self.counts):
            for g, k in c.items():
                self.totals[n][g[:-1]] += k
        self.after = [defaultdict(list) for _ in range(order)]
        for n, c in enumerate(self.counts):
            for g in c:
                self.after[n][g[:-1]].append(g[-1])

    @staticmethod
    def grams(text, order):
        w = [None] * (order - 1) + [x.decode() for x in (text or "").encode().lower().split()] + ["</s>"]
        return [tuple(w[i : i + order]) for i in range(len(w) - order + 1)]

    def factor(self, n, k):
        return float(self.d[n - 1].factor[k - 1]) if k <= katz.SMALL else 1.0

    def p(self, gram):
        n, d = len(gram), self.d[len(gram) - 1]
        k = self.counts[n - 1][gram]
        if n == 1:
            unknown = max(d.freed, 1 / (d.total + 1))
            return self.factor(1, k) * k / d.total * (1 - unknown) / (1 - d.freed) if k else unknown
        ctx = gram[:-1]
        total = self.totals[n - 1][ctx]
        if not total:
            return self.p(gram[1:])
        pure = all(self.counts[n - 1][(*ctx, w)] > katz.SMALL for w in self.after[n - 1][ctx])
        if k:
            return k / (total + 1) if pure else self.factor(n, k) * k / total
        return self.weight(ctx) * self.p(gram[1:])

    def weight(self, ctx):
        n = len(ctx)
        seen = self.after[n][ctx]
        return (1 - sum(self.p((*ctx, w)) for w in seen)) / (1 - sum(self.p((*ctx[1:], w)) for w in seen))


def corpus():
    r = random.Random(3)
    words = [f"W{min(int(r.paretovariate(0.7)), 200)}" for _ in range(4000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["hot pair " * 400] * 3 + [None, "", " \t", "É é x A a"]
    return list(enumerate(texts))


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_the_plain_model(spark, order):
    rows = corpus()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, block int")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1
    scores, tables = katz.katz(docs, train, order, block_tokens=700, bucket_pairs=900)
    got = {r.doc_id: r for r in scores.collect()}
    assert len(got) == len(rows) and len(tables) == order
    model = Plain([t for i, t in rows if not held(i)], order)
    uni = model.counts[0]
    n = sum(uni.values())
    for i, t in rows:
        grams = model.grams(t, order)
        assert got[i].trained == (not held(i)) and got[i].n_tokens == len(grams) and got[i].train_tokens == n
        assert got[i].n_known == sum(uni[g[-1:]] > 0 for g in grams)
        assert got[i].base_score == pytest.approx(sum(math.log10((uni[g[-1:]] + 0.5) / (n + 0.5 * (len(uni) + 1))) for g in grams))
        assert got[i].score == pytest.approx(sum(math.log10(model.p(g)) for g in grams), abs=1e-6)
    # Exactly normalised, unknown words being one more word.
    vocabulary = [g[0] for g in uni] + ["never seen"]
    contexts = [c for c in list(model.totals[order - 1])[:25]] + [("never seen",) * (order - 1), (None,) * (order - 1)]
    for c in contexts:
        assert sum(model.p((*c, w)) for w in vocabulary) == pytest.approx(1)


def test_ties_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = katz.katz(docs, F.lit(True))[0].collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 3), ("1", 3), ("2", 1), ("None", 3)]
    assert len({r.score for r in got if r.n_tokens == 3}) == 1
    none = katz.katz(docs, F.lit(False))[0].collect()
    assert all(r.score == 0 and r.train_tokens == r.n_known == 0 for r in none)
    assert katz.katz(docs.limit(0), F.lit(True))[0].count() == 0
