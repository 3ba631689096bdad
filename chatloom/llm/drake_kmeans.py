"""Centroid clustering with Drake's adaptive bounds.

Beside its cluster a vector keeps an upper bound of the distance to it, lower
bounds of the distances to its next few centroids in their order, and one lower
bound for all others. When centroids move, bounds move with them; only as many
centroids as the bounds cannot rule out are measured again, exactly. Distances
and sums are integers, so the clusters are those of a full scan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Steps, arrow_batches, spread

CLUSTERS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Next centroids that have a bound of their own.
BOUNDS = 4
#: Rounding outwards: far more than the few roundings of a round can add up to.
_OUT = 1e-13

STATE = "cluster int, upper double, next array<int>, lows array<double>, rest double, measured long"


def usable(vector: Column, dims: int) -> Column:
    """Vectors of so many components, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def largest(dims: int) -> int:
    """The largest component, scaled, with which squared distances always fit into a long."""
    return math.isqrt(((1 << 63) - 1) // dims) // 2


def scaled(vector: Column, scale: int, dims: int) -> Column:
    """floor(scale * x) of each component; one beyond the largest stops the job, as its distances may not fit into a long."""
    most = largest(dims)

    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) <= most, y).otherwise(F.raise_error(F.lit(f"a scaled component is beyond {most}")).cast("bigint")).cast("int")

    return F.transform(vector, one)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of v to those of c, in whole numbers."""
    # The floats of matrix products hold whole numbers up to 2^53.
    if v.shape[1] * max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) ** 2 < 1 << 51:
        x, y = v.astype(float), c.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1)


class Bounds:
    """What a batch of vectors knows of its distances to the centroids."""

    def __init__(self, v: np.ndarray, centroids: np.ndarray, keep: int):
        self.v, self.c, n = v, centroids, len(v)
        self.keep = min(keep, len(centroids) - 1)
        self.cluster, self.measured = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.upper, self.rest = np.zeros(n), np.full(n, np.inf)
        self.next, self.lows = np.zeros((n, self.keep), np.int64), np.zeros((n, self.keep))

    def load(self, batch: pa.RecordBatch) -> None:
        whole = lambda name, kind: batch.column(name).to_numpy(zero_copy_only=False).astype(kind)
        self.cluster, self.measured = whole("cluster", np.int64), whole("measured", np.int64)
        self.upper, self.rest = whole("upper", float), whole("rest", float)
        self.next = batch.column("next").flatten().to_numpy().astype(np.int64).reshape(len(self.v), self.keep)
        self.lows = batch.column("lows").flatten().to_numpy().reshape(len(self.v), self.keep)

    def shift(self, moved: np.ndarray) -> None:
        """The bounds after centroids moved by so much."""
        self.upper = (self.upper + moved[self.cluster]) * (1 + _OUT)
        self.lows = self.lows - moved[self.next] - _OUT * (self.lows + moved[self.next])
        far = np.isinf(self.rest)
        self.rest = np.where(far, self.rest, self.rest - moved.max() - _OUT * (np.where(far, 0, self.rest) + moved.max()))

    def scan(self, rows: np.ndarray) -> None:
        """Measure all centroids."""
        if not len(rows):
            return
        d = squared(self.v[rows], self.c)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        k = self.keep
        self.cluster[rows], self.upper[rows] = order[:, 0], root[:, 0] * (1 + _OUT)
        self.next[rows], self.lows[rows] = order[:, 1 : k + 1], root[:, 1 : k + 1] * (1 - _OUT)
        self.rest[rows] = root[:, k + 1] * (1 - _OUT) if d.shape[1] > k + 1 else np.inf
        self.measured[rows] += d.shape[1]

    def doubtful(self) -> np.ndarray:
        """How many of the next centroids may be as near as the cluster's: all behind them, and the rest, are certainly farther; keep + 1: no bound helps."""
        behind = np.minimum.accumulate(np.concatenate([self.lows, self.rest[:, None]], 1)[:, ::-1], axis=1)[:, ::-1]
        certain = self.upper[:, None] < behind
        return np.where(certain.any(1), certain.argmax(1), self.keep + 1)

    def settle(self) -> None:
        """Find the nearest centroid, ties to the smaller number, measuring no more than the bounds leave open."""
        open_ = np.flatnonzero(self.doubtful() > 0)
        # The distance to the own centroid first: often this alone decides.
        own = ((self.v[open_] - self.c[self.cluster[open_]]) ** 2).sum(1)
        self.upper[open_] = np.sqrt(own.astype(float)) * (1 + _OUT)
        self.measured[open_] += 1
        level = self.doubtful()
        for z in range(1, self.keep + 1):
            rows = np.flatnonzero(level == z)
            if not len(rows):
                continue
            tried = np.concatenate([self.cluster[rows, None], self.next[rows, :z]], 1)
            d = ((self.v[rows, None, :] - self.c[tried]) ** 2).sum(2)
            order = np.lexsort((tried, d))
            tried, root = np.take_along_axis(tried, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(float))
            self.cluster[rows], self.upper[rows] = tried[:, 0], root[:, 0] * (1 + _OUT)
            self.next[rows, :z], self.lows[rows, :z] = tried[:, 1:], root[:, 1:] * (1 - _OUT)
            self.measured[rows] += z
        self.scan(np.flatnonzero(level > self.keep))

    def columns(self) -> list[pa.Array]:
        at = pa.array(np.arange(0, len(self.v) * self.keep + 1, self.keep, dtype=np.int32)) if self.keep else pa.array(np.zeros(len(self.v) + 1, np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x.reshape(-1))) for x in (self.next.astype(np.int32), self.lows)]
        return [pa.array(self.cluster.astype(np.int32)), pa.array(self.upper), *lists, pa.array(self.rest), pa.array(self.measured)]


def _assigned(centroids: np.ndarray, moved: np.ndarray | None, keep: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dims)
            b = Bounds(v, centroids, keep)
            if moved is None:
                b.scan(np.arange(len(v)))
            else:
                b.load(batch)
                b.shift(moved)
                b.settle()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *b.columns()], names=["id", "v", "cluster", "upper", "next", "lows", "rest", "measured"])

    return run


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.sqrt(((new - old) ** 2).sum(1).astype(float)) * (1 + _OUT)


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, bounds: int = BOUNDS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured: one row per usable vector.

    Components become floor(scale * x). The first centroids are the k vectors of
    the least sha256 of "1:<vec_id>". Each round assigns all vectors (squared
    Euclidean distance, ties to the smaller number) and moves each centroid that
    has some to the floor of their mean; empty ones stay. Then vectors are
    assigned once more. measured counts the distances to centroids that were
    computed for a vector, k for each of rounds + 1 passes without bounds.

    Vectors that are null, of another length, or with null or non-finite
    components are left out; a scaled component beyond half the root of 2^63 /
    dims (189,812,531 for 64) is an error, as its distances need not fit into a
    long. Repeated rows are separate vectors;
    among equal hashes the smaller vector comes first. A null id hashes as "1:".
    Fewer than k vectors make as many centroids; an empty table gives an empty
    result. Other columns are ignored. The driver holds k centroids and nothing
    of the vectors.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    steps = Steps(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col)
    state = steps.cut(spread(vectors.filter(usable(v, dims)).select(F.col(id_col).alias("id"), scaled(v, scale, dims).alias("v"))), "vectors")
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    seeds = [r.v for r in state.select("v", name.alias("name")).orderBy("name", "v").limit(k).collect()]
    if not seeds:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, measured bigint")
    centroids, moved = np.array(seeds, np.int64), None
    for _ in range(rounds):
        state = steps.next(state.mapInArrow(_assigned(centroids, moved, bounds, dims), f"id {id_type}, v array<int>, {STATE}"), "bounds")
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dims)]).alias("sums")).collect()
        new = centroids.copy()
        for r in sums:
            new[r.cluster] = [s // r.n for s in r.sums]
        centroids, moved = new, _moved(centroids, new)
    state = state.mapInArrow(_assigned(centroids, moved, bounds, dims), f"id {id_type}, v array<int>, {STATE}")
    final = spark.createDataFrame([(i, row.tolist(), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for i, row in enumerate(centroids)], "cluster int, c array<bigint>, centroid_sha256 string")
    # A row for each of k centroids.
    own = state.select("id", "v", "cluster", "measured").join(F.broadcast(final), "cluster")
    distance = F.aggregate(F.zip_with("v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    own = steps.next(own.select("id", "cluster", distance.alias("distance"), "centroid_sha256", "measured"), "clusters")
    inertia = own.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in inertia)
    shares = spark.createDataFrame([(r.cluster, r.cluster_inertia, total) for r in inertia], "cluster int, cluster_inertia bigint, inertia bigint")
    out = own.join(F.broadcast(shares), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")
    return steps.end(out, "clustered")
