"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation
maximisation over the counts of vote patterns estimates how often each labeller
votes what on good and on bad texts, without any true label; the posterior of
a pattern is the weak label of its texts. A linear scorer over hashed words and
word shapes learns the weak labels of a bounded sample and scores all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_batches, cut, spread, whole_text

#: Documents the scorer learns from, those with the smallest hashes: the one bounded sample here.
SAMPLE = 6_000
BITS = 18
#: A document is rejected below this score.
KEEP = 0.5

GOOD, BAD, NONE = "g", "b", "-"
_PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PLAIN = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b" \t\n\r\v\f.,;:!?'\"-()"])


def _vote(value: float, good: tuple[float, float], bad: tuple[float, float]) -> str:
    """Good inside ``good``, bad outside ``bad``, else nothing."""
    return GOOD if good[0] <= value <= good[1] else NONE if bad[0] <= value <= bad[1] else BAD


def measures(text: str) -> dict[str, float]:
    """What the labellers look at; shares of words or of bytes."""
    raw, words = text.encode(), text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    upper, lower = size - len(raw.translate(None, _UPPER)), size - len(raw.translate(None, _LOWER))
    lengths = list(map(len, words))
    return {
        "words": len(words),
        "symbols": len(raw.translate(None, _PLAIN)) / size,
        "upper": upper / max(1, upper + lower),
        "bangs": raw.count(b"!") / n,
        "repeats": sum(map(eq, words, words[1:])) / n,
        "bare": list(map(str.strip, words, repeat(_PUNCTUATION))).count("") / n,
        "short": sum(x <= 3 for x in lengths) / n,
        "length": sum(lengths) / n,
        "distinct": len(set(words)) / n,
        "stops": (raw.count(b". ") + raw.count(b".\n") + raw.count(b"? ") + raw.count(b"! ")) / n,
    }


#: Labellers: the measure, where it votes good, and outside of what it votes bad.
LABELLERS = {
    "symbols": ((0, 0.01), (0, 0.03)),
    "upper": ((0, 0.15), (0, 0.3)),
    "bangs": ((0, 0.05), (0, 0.2)),
    "repeats": ((0, 0.05), (0, 0.15)),
    "bare": ((0, 0.03), (0, 0.12)),
    "short": ((0.2, 0.75), (0.12, 0.9)),
    "length": ((3, 9), (2.2, 12)),
    "distinct": ((0.15, 1), (0.08, 1)),
    "stops": ((0.01, 0.3), (0, 0.6)),
}


def votes(text: str) -> str:
    """One letter for each labeller; a text of fewer than five words gets no vote but from its symbols and capitals."""
    m = measures(text)
    few = m["words"] < 5
    return "".join(NONE if few and name not in ("symbols", "upper") else _vote(m[name], *at) for name, at in LABELLERS.items())


class Estimate(NamedTuple):
    """P(good), and P(vote | class) as [class, labeller, vote in the order bad, none, good]."""

    prior: float
    rates: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good | votes) for rows of votes coded 0 bad, 1 none, 2 good."""
        m = np.arange(pattern.shape[1])
        log = np.log(self.rates[:, m, pattern]).sum(-1) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def code(patterns: list[str]) -> np.ndarray:
    return np.array([["b-g".index(x) for x in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))


def estimate(patterns: list[str], counts: list[int], rounds: int = 100) -> Estimate:
    """Expectation maximisation, from the start that a text with any bad vote is bad by 0.8 and one without is good."""
    x, n = code(patterns), np.array(counts, float)
    post = np.where((x == 0).any(1), 0.2, 0.95)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * n, post * n])
        rates = np.stack([[[w[x[:, j] == v].sum() for v in range(3)] for j in range(x.shape[1])] for w in weight]) + 0.5
        found = Estimate(float((weight[1].sum() + 1) / (n.sum() + 2)), rates / rates.sum(-1, keepdims=True))
        new = found.posterior(x)
        if len(new) and np.abs(new - post).max() < 1e-6:
            break
        post = new
    return found


# The scorer.

_SHAPES = bytes(0x41 if 65 <= b < 91 else 0x61 if 97 <= b < 123 or b >= 128 else 0x39 if 48 <= b < 58 else b for b in range(256))
_RUN = re.compile(rb"(a|A|9)\1+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word shapes with log counts, at length 1."""
    raw = text.encode()
    counts = Counter(raw.lower().split())
    shapes = Counter(_RUN.sub(rb"\1", raw.translate(_SHAPES)).split())
    keys = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
    marks = np.fromiter(map(xxhash.xxh64_intdigest, shapes, repeat(1)), np.uint64, len(shapes))
    at = (np.concatenate([keys, marks]) & np.uint64((1 << BITS) - 1)).astype(np.int32)
    value = np.log1p(np.fromiter([*counts.values(), *shapes.values()], np.float64, len(at)))
    # Words and shapes weigh alike, however many there are of either.
    for part in (slice(0, len(counts)), slice(len(counts), None)):
        value[part] /= max(1e-9, np.sqrt((value[part] ** 2).sum()))
    return at, value.astype(np.float32)


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float

    def __call__(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + (self.weights[at] * value).sum(), -50, 50))))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 12, rate: float = 0.5, decay: float = 1e-6) -> Scorer:
    """Logistic regression on soft labels by AdaGrad, row by row in the order given."""
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    bias, bias_seen = 0.0, 1e-2
    for _ in range(rounds):
        for (at, value), y in zip(rows, labels):
            z = bias + (w[at] * value).sum()
            g = 1 / (1 + np.exp(-max(-50.0, min(50.0, z)))) - y
            step = g * value + decay * w[at]
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
            bias_seen += g * g
            bias -= rate * g / np.sqrt(bias_seen)
    return Scorer(w.astype(np.float32), float(bias))


class Model(NamedTuple):
    estimate: Estimate
    scorer: Scorer


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Estimate labellers from the votes on all texts and train the scorer on the sample's posteriors.

    The driver sees at most 3 ** labellers patterns with their counts, and the sample.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    source = spread(docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("pick"), whole_text(text_col).alias("text")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(votes, b.column(1).to_pylist())), pa.string())], names=["pick", "votes"])

    voted = cut(source.mapInArrow(vote, "pick bigint, votes string"), "votes")
    patterns = voted.groupBy("votes").count().collect()
    found = estimate([r.votes for r in patterns], [r["count"] for r in patterns])
    last = [r.pick for r in voted.orderBy("pick").limit(sample).select("pick").collect()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            f = list(map(features, texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(votes, texts)), pa.string()), pa.array([x[0].tobytes() for x in f], pa.binary()), pa.array([x[1].tobytes() for x in f], pa.binary())],
                names=["pick", "votes", "at", "value"],
            )

    chosen = source.filter(F.col("pick") <= (max(last) if last else 0)).mapInArrow(measure, "pick bigint, votes string, at binary, value binary")
    rows = chosen.orderBy("pick", "at").limit(sample).collect()
    labels = found.posterior(code([r.votes for r in rows])) if rows else np.empty(0)
    return Model(found, learn([(np.frombuffer(r.at, np.int32), np.frombuffer(r.value, np.float32)) for r in rows], labels))


def classify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per input row: doc_id, votes, posterior, score, kept.

    posterior is P(good) by the labellers, score by the scorer, kept whether
    score >= keep. Null text is empty; an empty text has no features and gets
    the scorer's bias. Repeated rows get equal values, an empty table gives an
    empty result. Other columns are ignored.
    """
    model = model or fit(docs, id_col, text_col)
    source = spread(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            v = list(map(votes, texts))
            post = model.estimate.posterior(code(v))
            score = [model.scorer(*features(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(v, pa.string()), pa.array(post), pa.array(score, pa.float64()), pa.array([s >= keep for s in score], pa.bool_())], names=["doc_id", "votes", "posterior", "score", "kept"]
            )

    return source.mapInArrow(run, f"doc_id {kind}, votes string, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs that ``classify`` keeps, with all their columns.

    Null text is judged as empty text, a text without words by the scorer's bias;
    rows that repeat a text share its fate, whatever their ids; an empty table
    gives an empty result.
    """
    model = fit(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = [model.scorer(*features(t or "")) >= keep for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(mask, pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
