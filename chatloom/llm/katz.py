"""Katz backoff over word n-grams, counted and evaluated without moving texts.

Texts are tokenized once into blocks of bounded size, kept in a bucketed table
of the shared folder. For each order a block sends its distinct n-grams with
their training counts to the bucket of their context; the bucket adds the
counts, stores its share of the n-gram table, and answers each block with what
it needs to score: totals of its n-grams and contexts. Once an order is counted
everywhere its Good-Turing discounts are known, and blocks compute that order's
probabilities, which the next order backs off to.

Hot contexts, of which there are fewer than a fixed number, are spread over all
buckets by their whole n-gram, and their sums are added afterwards.

Words are known by 64-bit hashes; two of a billion words share one with a
probability of 3 %, and then count as one word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .runtime import arrow_batches, cut, delete, planned_parts, scratch, spread, whole_text

ORDER = 2
#: Counts up to this one are discounted.
SMALL = 5
BLOCK_TOKENS = 2_000_000
BUCKET_PAIRS = 4_000_000
#: A context is hot beyond 1 / (HOT * buckets) of all tokens, and beyond 1 / HOT_MOST: so fewer
#: than HOT_MOST contexts of an order are hot, and their sums, at 24 bytes each, can go to every task.
HOT, HOT_MOST = 4, 1_000_000
#: Tasks for each part of the input that share the blocks out: a slot holds a few blocks, however many there are.
SLOTS_PER_PART = 4
#: Words hold no white space, so no word is this text.
END = np.uint64(xxhash.xxh64_intdigest(b" end"))
#: Where a context reaches back beyond the text; no word has this number.
START = np.uint64(2**64 - 1)

_M = np.uint64(0x9E3779B97F4A7C15)
REQUEST = "bucket int, block bigint, ctx binary, runs binary, word binary, n binary, low binary, values binary"
REPLY = "kind string, slot int, block bigint, bucket int, a binary, b binary, c binary, d binary, stats array<double>"


def pack(a: np.ndarray) -> bytes:
    """The array's bytes, all first ones, then all second ones and so on, compressed."""
    a = np.ascontiguousarray(a).reshape(-1)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(dtype).reshape(-1)


def join_hash(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = ctx * _M + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def tokens_of(text: str) -> np.ndarray:
    """Hashes of the words, A-Z lowered, and of the end."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


class Discounts(NamedTuple):
    """Of one order: factors for counts 1 to SMALL, and the number of tokens and distinct n-grams."""

    factor: np.ndarray
    total: float
    distinct: float
    freed: float

    @classmethod
    def of(cls, counts_of_counts: np.ndarray, total: float, distinct: float) -> Discounts:
        """Good-Turing, scaled so that counts beyond SMALL keep their mass.

        Where counts of counts are too thin for a factor between 0 and 1, the
        factor is r / (r + 1).
        """
        n, r = np.asarray(counts_of_counts, float), np.arange(1, SMALL + 1)
        factor = r / (r + 1.0)
        if n[0] and n[SMALL]:
            cut_off = (SMALL + 1) * n[SMALL] / n[0]
            with np.errstate(all="ignore"):
                d = ((r + 1) * n[1:] / (r * n[:-1]) - cut_off) / (1 - cut_off)
            factor = np.where((d > 0) & (d < 1), d, factor)
        freed = float(((1 - factor) * r * n[:SMALL]).sum()) / total if total else 1.0
        return cls(factor, total, distinct, freed)

    def __call__(self, count: np.ndarray) -> np.ndarray:
        """The factor of each count, 1 beyond SMALL."""
        return np.append(np.append(0.0, self.factor), 1.0)[np.minimum(count, SMALL + 1)]


def unigrams(count: np.ndarray, d: Discounts) -> np.ndarray:
    """P(word): discounted counts; words unknown to training share what is left, as one class.

    Where discounting frees less than one count, the known words give that much.
    """
    unknown = max(d.freed, 1 / (d.total + 1))
    scale = (1 - unknown) / (1 - d.freed) if d.total else 1.0
    return np.where(count > 0, d(count) * count / max(1.0, d.total) * scale, unknown)


# Blocks.


def blocks(docs: DataFrame, id_col: str, text_col: str, train, size: int) -> DataFrame:
    """block, ids, train, lens, vocab, stream: documents as indices into their block's own vocabulary, frequent words first."""
    source = spread(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), whole_text(text_col).alias("text")))
    kind = source.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, train, docs, number = TaskContext.get().partitionId(), [], [], [], 0

        def block():
            flat = np.concatenate(docs)
            vocab, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
            rank = np.argsort(-counts, kind="stable")
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            stream = place[inverse].astype(np.uint32)
            low, high = (stream & 0xFFFF).astype(np.uint16), (stream >> 16).astype(np.uint16)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([train], pa.list_(pa.bool_())),
                    pa.array([[len(d) for d in docs]], pa.list_(pa.int64())), pa.array([pack(vocab[rank])], pa.binary()), pa.array([pack(low)], pa.binary()), pa.array([pack(high)], pa.binary()),
                ],
                names=["block", "ids", "train", "lens", "vocab", "low", "high"],
            )

        total = 0
        for batch in batches:
            for i, t, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                train.append(t)
                docs.append(tokens_of(text))
                total += len(docs[-1])
                if total >= size:
                    yield block()
                    ids, train, docs, number, total = [], [], [], number + 1, 0
        if docs:
            yield block()

    return source.mapInArrow(run, f"block bigint, ids array<{kind.simpleString()}>, train array<boolean>, lens array<bigint>, vocab binary, low binary, high binary")


class Block:
    """A block of documents with the replies it has so far: ``p`` is the probability of each token at the latest order."""

    def __init__(self, row: dict, buckets: int, orders: list[Discounts], hot: list[tuple], replies: list[list[dict]], limit: float):
        self.number, self.buckets, self.limit = row["block"], buckets, limit
        self.ids, self.lens, self.train = row["ids"], np.array(row["lens"]), np.array(row["train"], bool)
        self.vocab = unpack(row["vocab"], np.uint64)
        self.stream = unpack(row["low"], np.uint16).astype(np.int64) | unpack(row["high"], np.uint16).astype(np.int64) << 16
        self.token_train = np.repeat(self.train, self.lens)
        self.starts = np.cumsum(self.lens) - self.lens
        self.replies, self.orders, self.hot = replies, orders, hot
        self.p = self.count = None

    def word_requests(self) -> tuple[np.ndarray, ...]:
        counts = np.bincount(self.stream[self.token_train], minlength=len(self.vocab)).astype(np.uint32)
        bucket = (self.vocab % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        return bucket[order], order, counts

    def read_words(self) -> None:
        _, order, _ = self.word_requests()
        replies = sorted(self.replies[0], key=lambda x: x["bucket"])
        counts, numbers = np.empty(len(order), np.int64), np.empty(len(order), np.uint64)
        counts[order] = np.concatenate([unpack(x["a"], np.int64) for x in replies])
        numbers[order] = np.concatenate([unpack(x["b"], np.uint64) for x in replies])
        self.word_count, self.word = counts[self.stream], numbers[self.stream]
        self.count, self.p = self.word_count, unigrams(self.word_count, self.orders[0])

    def grams(self, n: int) -> tuple[np.ndarray, ...]:
        """Distinct n-grams in the order of requests: first position, context, bucket; and each token's place among them."""
        word = self.word
        position = np.arange(len(word)) - np.repeat(self.starts, self.lens)
        ctx = np.zeros(len(word), np.uint64)
        for k in range(n - 1, 0, -1):
            before = np.where(position >= k, np.roll(word, k), START)
            ctx = before if n == 2 else join_hash(ctx, before)
        # Contexts without a word, and those seen often, are hot.
        often = np.where(position >= 1, np.roll(self.count, 1), np.iinfo(np.int64).max) > self.limit
        _, at, inverse = np.unique(join_hash(ctx, word), return_index=True, return_inverse=True)
        ctx_u, word_u, hot_u = ctx[at], word[at], often[at]
        bucket = (join_hash(ctx_u, np.where(hot_u, word_u, START)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(ctx_u, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return at[order], ctx_u[order], word_u[order], hot_u[order], bucket[order], place[inverse]

    def gram_requests(self, n: int) -> Iterator[dict]:
        at, ctx, word, hot, bucket, place = self.grams(n)
        counts = np.bincount(place[self.token_train], minlength=len(at)).astype(np.uint32)
        for s, e in _runs(bucket):
            names, runs = _lengths(ctx[s:e])
            request = {"bucket": int(bucket[s]), "block": self.number, "ctx": pack(names), "runs": pack(runs), "word": pack(word[s:e]), "n": pack(counts[s:e])}
            if n == 2:
                # The order below follows from the word's count, which is shorter.
                yield request | {"low": pack(self.count[at[s:e]]), "values": pack(hot[s:e])}
            else:
                low = self.p[at[s:e]]
                values, low = np.unique(np.where(hot[s:e], -low, low), return_inverse=True)
                yield request | {"low": pack(low.astype(np.uint32)), "values": pack(values)}

    def read_grams(self, n: int) -> None:
        """This order's probabilities: discounted where the n-gram is known, else backed off to the order below."""
        at, ctx, _, hot, bucket, place = self.grams(n)
        d, low = self.orders[n - 1], self.p[at]
        count = np.empty(len(at), np.int64)
        total, weight = np.zeros(len(at)), np.ones(len(at))
        replies = {x["bucket"]: x for x in self.replies[n - 1]}
        for s, e in _runs(bucket):
            x = replies[int(bucket[s])]
            count[s:e] = unpack(x["a"], np.uint32)
            names, where = np.unique(ctx[s:e], return_inverse=True)
            known = unpack(x["b"], np.float64)
            total[s:e] = known[where]
            # Sums of those contexts that have to give their weight of backoff.
            need, sums = unpack(x["c"], np.int32), unpack(x["d"], np.float64).reshape(-1, SMALL + 1)
            w = np.ones(len(names))
            w[need] = backoff(known[need], sums, d)
            weight[s:e] = w[where]
        names, totals, weights = self.hot[n - 1]
        which = np.flatnonzero(hot)
        if len(which):
            total[which], weight[which] = 0.0, 1.0
            known = which[np.isin(ctx[which], names)]
            where = np.searchsorted(names, ctx[known])
            total[known], weight[known] = totals[where], weights[where]
        # A negative total marks a context whose counts are all large: it keeps one count for the unseen.
        seen = d(count) * count / np.maximum(1.0, np.where(total < 0, 1 - total, total))
        p = np.where(count > 0, seen, weight * low)
        self.p, self.count = p[place], count[place]

    def catch_up(self, n: int) -> Block:
        """Read replies up to order n."""
        self.read_words()
        for k in range(2, n + 1):
            self.read_grams(k)
        return self

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


def _runs(a: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
    return [(s, e) for s, e in zip(cuts, cuts[1:]) if e > s]


def _lengths(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a's runs and their lengths."""
    runs = _runs(a)
    return a[[s for s, _ in runs]], np.array([e - s for s, e in runs], np.uint32)


def backoff(total: np.ndarray, sums: np.ndarray, d: Discounts) -> np.ndarray:
    """Weights of contexts by total and by sums: numbers of n-grams counted 1 to SMALL times, and the lower order's mass of all seen ones.

    With it a context's probabilities sum to exactly 1: what discounting frees,
    over what the lower order gives to words unseen here. An unknown context
    (total 0) has weight 1.
    """
    r = np.arange(1, SMALL + 1)
    size = np.abs(total)
    few = sums[:, :SMALL] * r
    kept = (few * d.factor).sum(1) + (size - few.sum(1))
    with np.errstate(all="ignore"):
        freed = np.where(total < 0, 1 / (size + 1), 1 - kept / size)
    return np.where(size > 0, freed / (1 - sums[:, SMALL]), 1.0)


# Buckets.


def _histogram(count: np.ndarray) -> list[float]:
    known = count[count > 0]
    return [*np.bincount(np.minimum(known, SMALL + 2), minlength=SMALL + 3)[1 : SMALL + 2].astype(float).tolist(), float(known.sum()), float(len(known))]


def _reply(rows: list[dict]) -> pa.Table:
    kinds = {"kind": pa.string(), "slot": pa.int32(), "block": pa.int64(), "bucket": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary(), "stats": pa.list_(pa.float64())}
    return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()})


def _slot(block: int, slots: int) -> int:
    return ((block >> 32) * 7 + (block & 0xFFFFFFFF)) % slots


def count_words(slots: int, buckets: int):
    """Words get numbers that no other bucket gives, small ones where they are frequent."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        words = [unpack(r["word"], np.uint64) for r in rows]
        flat = np.concatenate(words)
        names, inverse = np.unique(flat, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([unpack(r["n"], np.uint32) for r in rows]).astype(float), minlength=len(names)).astype(np.int64)
        number = np.empty(len(names), np.uint64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(names), dtype=np.uint64) * np.uint64(buckets) + np.uint64(rows[0]["bucket"])
        mine, stop, bucket = total[inverse], np.cumsum([len(w) for w in words]), rows[0]["bucket"]
        out = [{"kind": "reply", "slot": _slot(r["block"], slots), "block": r["block"], "bucket": bucket, "a": pack(mine[e - len(w) : e]), "b": pack(number[inverse[e - len(w) : e]])} for r, w, e in zip(rows, words, stop)]
        known = total > 0
        out.append({"kind": "model", "bucket": bucket, "a": pack(names[known]), "c": pack(number[known]), "d": pack(total[known])})
        return _reply([*out, {"kind": "stats", "bucket": bucket, "stats": _histogram(total)}])

    return run


def _lower(row: dict, first: Discounts | None) -> np.ndarray:
    """The lower order's probability of each n-gram of a request, negative where its context is hot."""
    if first is None:
        return unpack(row["values"], np.float64)[unpack(row["low"], np.uint32)]
    low = unigrams(unpack(row["low"], np.int64), first)
    return np.where(unpack(row["values"], bool), -low, low)


def count_grams(slots: int, first: Discounts | None):
    """first: the discounts of order 1, to count order 2."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        bucket = rows[0]["bucket"]
        ctx = [np.repeat(unpack(r["ctx"], np.uint64), unpack(r["runs"], np.uint32)) for r in rows]
        sizes = np.array([len(c) for c in ctx])
        stop = np.cumsum(sizes)
        ctx = np.concatenate(ctx)
        word = np.concatenate([unpack(r["word"], np.uint64) for r in rows])
        low = np.concatenate([_lower(r, first) for r in rows])
        n = np.concatenate([unpack(r["n"], np.uint32) for r in rows]).astype(float)
        _, at, inverse = np.unique(join_hash(ctx, word), return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=n, minlength=len(at)).astype(np.int64)
        known = count > 0
        # Sums over each context's known n-grams.
        names, where = np.unique(ctx[at], return_inverse=True)
        sums = np.zeros((len(names), SMALL + 1))
        for r in range(1, SMALL + 1):
            sums[:, r - 1] = np.bincount(where[count == r], minlength=len(names))
        sums[:, SMALL] = np.bincount(where[known], weights=np.abs(low[at][known]), minlength=len(names))
        total = np.bincount(where, weights=count.astype(float), minlength=len(names))
        hot = np.zeros(len(names), bool)
        hot[where[np.signbit(low[at])]] = True
        pure = (total > 0) & (sums[:, :SMALL].sum(1) == 0) & ~hot
        total[pure] *= -1
        out = []
        every = where[inverse]
        for r, size, e in zip(rows, sizes, stop):
            s = e - size
            mine, place = np.unique(every[s:e], return_inverse=True)  # names are sorted, so this is the block's own order
            got = count[inverse[s:e]]
            need = np.unique(place[(got == 0)])
            need = need[~hot[mine[need]]]
            out.append({"kind": "reply", "slot": _slot(r["block"], slots), "block": r["block"], "bucket": bucket, "a": pack(got.astype(np.uint32)), "b": pack(total[mine]), "c": pack(need.astype(np.int32)), "d": pack(sums[mine[need]])})
        order = np.flatnonzero(known)
        order = order[np.lexsort((word[at[order]], ctx[at[order]]))]
        heads, runs = _lengths(ctx[at[order]])
        out.append({"kind": "model", "bucket": bucket, "a": pack(heads), "b": pack(runs), "c": pack(word[at[order]]), "d": pack(count[order])})
        out += [{"kind": "hot", "bucket": bucket, "block": int(names[i].view(np.int64)), "stats": [float(total[i]), *sums[i].tolist()]} for i in np.flatnonzero(hot)]
        return _reply([*out, {"kind": "stats", "bucket": bucket, "stats": _histogram(count)}])

    return run


class Counted(NamedTuple):
    """One order's table: folder of kind=reply|model|stats|hot, discounts, and sorted hot contexts with their totals and weights."""

    path: str
    discounts: Discounts
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]


def _finish(spark, path: str) -> Counted:
    stats = spark.read.schema(REPLY).parquet(path).select("kind", "block", "stats").filter("kind in ('stats', 'hot')")
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(SMALL + 3)]
    row = stats.filter("kind = 'stats'").agg(*sums).first()
    d = Discounts.of([row[i] or 0 for i in range(SMALL + 1)], row[SMALL + 1] or 0, row[SMALL + 2] or 0)
    # Fewer than HOT_MOST contexts, and the one or few without a word.
    few = stats.filter("kind = 'hot'").groupBy("block").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(SMALL + 2)]).toArrow()
    names = few["block"].to_numpy().view(np.uint64)
    sums_ = np.stack([few[f"s{i}"].to_numpy() for i in range(SMALL + 2)], axis=1).reshape(-1, SMALL + 2)
    total = np.where((sums_[:, 0] > 0) & (sums_[:, 1 : SMALL + 1].sum(1) == 0), -sums_[:, 0], sums_[:, 0])
    order = np.argsort(names)
    return Counted(path, d, (names[order], total[order], backoff(total, sums_[:, 1:], d)[order]))


def katz(
    docs: DataFrame,
    train,
    order: int = ORDER,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    bucket_pairs: int = BUCKET_PAIRS,
) -> tuple[DataFrame, dict[int, str]]:
    """Scores of all documents by the model of those for which ``train`` holds (null: they train).

    Returns rows (doc_id, trained, n_tokens, n_known, train_tokens, base_score,
    score) and, for each order, the folder of its table, whose rows of kind
    "model" hold, by bucket, words' hashes, numbers and counts (order 1), or
    contexts, the number of words after each, these words and their counts.

    Null and empty texts are the end alone. Without training documents every
    word is unknown and has probability 1. Repeated rows are counted and scored
    one by one; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    raw = blocks(docs, id_col, text_col, train, block_tokens)
    # As many as the input has parts, so that a slot's share doesn't grow with the corpus.
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SLOTS_PER_PART * planned_parts(docs))
    if slots > 100_000:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(slots))
    kind = raw.schema["ids"].dataType.elementType.simpleString()
    name = f"katz_blocks_{uuid.uuid4().hex}"
    path = scratch(spark, "katz-blocks")
    slot_of = F.pmod(F.shiftright("block", 32) * 7 + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(slots)).cast("int")
    raw.withColumn("slot", slot_of).write.option("path", path).bucketBy(slots, "slot").saveAsTable(name)
    store = spark.table(name)
    tokens = store.agg(F.sum(F.expr("aggregate(lens, 0L, (a, x) -> a + x)"))).first()[0] or 0
    buckets = max(1, -(-tokens // bucket_pairs))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, buckets, [], [], [], 0)
                bucket, order_, counts = b.word_requests()
                out = [
                    {"bucket": int(bucket[s]), "block": b.number, "word": pack(b.vocab[order_[s:e]]), "n": pack(counts[order_[s:e]])} for s, e in _runs(bucket)
                ]
                yield _requests(out)

    words = scratch(spark, "katz-1")
    store.select("block", "ids", "train", "lens", "vocab", "low", "high").mapInArrow(requests, REQUEST).groupBy("bucket").applyInArrow(count_words(slots, buckets), REPLY).write.parquet(words)
    done = [_finish(spark, words)]
    limit = max(1.0, done[0].discounts.total / min(HOT * buckets, HOT_MOST))

    def with_replies(make, schema: str) -> DataFrame:
        """make(block) over the blocks with the replies of all orders so far; blocks stay where they are."""
        replies = None
        for n, counted in enumerate(done):
            part = spark.read.schema(REPLY).parquet(counted.path).filter("kind = 'reply'").select("slot", "block", "bucket", "a", "b", "c", "d", F.lit(n).alias("n"))
            replies = part if replies is None else replies.unionByName(part)
        discounts, n_orders = [x.discounts for x in done], len(done)
        sent = spark.sparkContext.broadcast([x.hot for x in done])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            whose, parts = right["block"].to_numpy(), []
            for k in range(len(left)):
                row = left.slice(k, 1).to_pylist()[0]
                mine: list[list[dict]] = [[] for _ in range(n_orders)]
                for r in right.take(pa.array(np.flatnonzero(whose == row["block"]))).to_pylist():
                    mine[r["n"]].append(r)
                parts.append(make(Block(row, buckets, discounts, sent.value, mine, limit)))
            return pa.concat_tables(parts) if parts else make(None)

        return store.groupBy("slot").cogroup(replies.groupBy("slot")).applyInArrow(run, schema)

    for n in range(2, order + 1):
        ask = with_replies(lambda b, n=n: pa.Table.from_batches([_requests(list(b.catch_up(n - 1).gram_requests(n)) if b else [])]), REQUEST)
        path_n = scratch(spark, f"katz-{n}")
        ask.groupBy("bucket").applyInArrow(count_grams(slots, done[0].discounts if n == 2 else None), REPLY).write.parquet(path_n)
        done.append(_finish(spark, path_n))

    first = done[0].discounts
    id_type = to_arrow_type(raw.schema["ids"].dataType.elementType)
    names = ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def score(b: Block | None) -> pa.Table:
        if b is None:
            return pa.table([pa.array([], t) for t in types], names=names)
        b.catch_up(order)
        c = b.word_count
        base = b.per_document(np.log10((c + 0.5) / (first.total + 0.5 * (first.distinct + 1))))
        columns = [b.ids, b.train, b.lens, b.per_document((c > 0).astype(np.int64)), np.full(len(b.lens), int(first.total)), base, b.per_document(np.log10(b.p))]
        return pa.table([pa.array(x, t) for x, t in zip(columns, types)], names=names)

    result = cut(with_replies(score, f"doc_id {kind}, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"), "katz-scores")
    spark.sql(f"DROP TABLE {name}")
    delete(spark, path)
    return result, {n + 1: x.path for n, x in enumerate(done)}


def _requests(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "block": pa.int64()} | dict.fromkeys(("ctx", "runs", "word", "n", "low", "values"), pa.binary())
    return pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()})
