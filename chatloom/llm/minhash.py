"""MinHash banding over word shingles: candidates by band hash, links by exact sets.

Units (documents or paragraphs) with one set of shingles are a class and meet
the bands once. A band's bucket is named by the smallest class in it, and the
buckets of one name form a group, so copies that collide in every band still
meet in one group only. Large groups are dealt out in square tiles; a tile
compares its pairs that share a band, each pair in the first band they share
and in that bucket's group alone, on the full sets. No pairs leave a tile: it
reports, for each class, its number of links and one edge of a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import Steps, arrow_batches, spread
from .words import mix, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 160
#: Members on a side of a tile, members packed into one task's small groups, and
#: representatives that may be broadcast (40 bytes each).
TILE, PACK, FEW = 512, 500, 200_000
#: Shingles that a side of a tile and a pack hold on average at most, whatever the number of members.
WEIGHT = 2_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
#: Rows of the grid of shingles and hash functions that is computed at a time.
_GRID = 2048


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest rows whose bands find a pair at the threshold with the recall, within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most and bands <= 62:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes are too few for recall {recall} at {threshold}")
    return best


def shingles(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of n words.

    Words are what white space (space, 9-13) parts. A text of fewer words is one
    shingle, a text without words none.
    """
    h, ends = word_hashes(texts)
    runs = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        runs = runs * _M + h[k : len(runs) + k]
    runs = mix(runs)
    out = []
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if e - s >= n:
            out.append(np.unique(runs[s : e - n + 1]))
        elif e > s:
            one = h[s : s + 1]
            for k in range(s + 1, e):
                one = one * _M + h[k]
            out.append(mix(one))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Bander:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.Generator(np.random.PCG64(seed))
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, k, np.uint64)
        self.salt = r.integers(0, 1 << 63, bands, np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """For each set one 64-bit hash for each band, salted so that no two bands share a bucket by plan; an empty set has the same as any other."""
        full = [i for i, s in enumerate(sets) if len(s)]
        low = np.full((len(sets), self.bands * self.rows), np.iinfo(np.uint64).max, np.uint64)
        if full:
            flat = np.concatenate([sets[i] for i in full])
            starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
            least = np.full((len(full), low.shape[1]), np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(flat), _GRID):
                grid = flat[at : at + _GRID, None] * self.a + self.b
                first, last = np.searchsorted(starts, (at, at + len(grid) - 1), "right") - 1
                part = np.minimum.reduceat(grid, np.maximum(starts[first : last + 1] - at, 0), axis=0)
                np.minimum(least[first : last + 1], part, out=least[first : last + 1])
            low[full] = least
        low = low.reshape(len(sets), self.bands, self.rows)
        h = np.broadcast_to(self.salt, low.shape[:2])
        for k in range(self.rows):
            h = mix(h * _M + low[:, :, k])
        return h


def signatures(units: DataFrame, bander: Bander, n: int) -> DataFrame:
    """id, text_hash, key (16 bytes of the set's digest), n_shingles, bands for (id, text_hash, text) rows."""
    id_type = units.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles(batch.column(2), n)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bander.bands + 1, bander.bands, dtype=np.int32)), pa.array(np.ascontiguousarray(bander(sets)).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), bands], names=["id", "text_hash", "key", "n_shingles", "bands"]
            )

    return units.mapInArrow(run, f"id {id_type}, text_hash bigint, key binary, n_shingles int, bands array<bigint>")


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _compare(sets, bands, masks, left, right, counts, threshold):
    """Links among members: (links by copies, links by class, root) of each."""
    m = len(sets)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if m else np.empty(0, int)
    sizes = np.array([len(s) for s in sets])
    stops = np.cumsum(sizes)
    own = [ids[e - k : e] for e, k in zip(stops, sizes)]
    flag = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    links, kinds, parent = np.zeros(m, np.int64), np.zeros(m, np.int64), list(range(m))
    same = left is right
    for x, i in enumerate(left):
        js = right[x + 1 :] if same else right
        small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        js = js[small >= threshold * large - 1e-9]
        if not len(js):
            continue
        equal = bands[js] == bands[i]
        first = equal.argmax(axis=1)
        js = js[equal.any(axis=1) & ((masks[i] >> first) & 1 == 1)]
        if not len(js):
            continue
        flag[own[i]] = True
        shared = np.array([np.count_nonzero(flag[own[j]]) for j in js])
        flag[own[i]] = False
        for j in js[shared >= threshold * (sizes[js] + sizes[i] - shared) - 1e-9]:
            links[i] += counts[j]
            links[j] += counts[i]
            kinds[i] += 1
            kinds[j] += 1
            a, b = _find(parent, i), _find(parent, int(j))
            parent[max(a, b)] = min(a, b)
    return links, kinds, [_find(parent, i) for i in range(m)]


def _tiles(n: int, threshold: float, bander: Bander):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("leader", "ascending"), ("key", "ascending")])
        leader = rows["leader"].to_numpy()
        key = rows["key"].to_pylist()
        slot, a, b = (rows[c].to_numpy() for c in ("slot", "a", "b"))
        masks, counts = rows["mask"].to_numpy(), rows["n"].to_numpy()
        texts = rows["text"]
        cuts = [0, *(np.flatnonzero(np.diff(leader)) + 1).tolist(), len(key)]
        out: list[tuple] = []
        for s, e in zip(cuts, cuts[1:]):
            sets = shingles(texts[s:e].combine_chunks(), n)
            # Computed again from the text: moving them cost more than this.
            bands = bander(sets)
            if a[s] == b[s]:
                left = right = np.arange(e - s)
            else:
                left, right = np.flatnonzero(slot[s:e] == a[s]), np.flatnonzero(slot[s:e] == b[s])
            links, kinds, root = _compare(sets, bands, masks[s:e], left, right, counts[s:e], threshold)
            out += [(key[s + i], key[s + root[i]], int(links[i]), int(kinds[i])) for i in range(e - s) if kinds[i]]
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["key", "root", "links", "kinds"])

    return run


def near_duplicates(units: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL, tile: int = TILE, most_hashes: int = MOST_HASHES) -> DataFrame:
    """For (id, text) rows: id, class_id, n_links, n_class_links, n_shingles.

    Two units are linked when the Jaccard similarity of their shingle sets is at
    least the threshold. class_id is the smallest id of the unit's connected
    component (nulls last), n_links the number of other units it is linked with,
    copies included, n_class_links the number of other distinct sets. Units
    without words are linked with nothing. Null text is empty. Repeated rows are
    units each, linked with each other; an empty table gives an empty result.
    """
    spark = units.sparkSession
    arrow_batches(spark)
    steps = Steps(spark)
    bander = Bander(*bands_for(threshold, recall, most_hashes))
    text = F.coalesce("text", F.lit(""))
    source = units.select("id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = steps.cut(signatures(spread(source), bander, n), "signatures")

    worded = signed.filter("n_shingles > 0").withColumn("k1", F.xxhash64("key"))
    classes = steps.cut(
        worded.groupBy("key", "k1").agg(F.count("*").alias("n"), F.first("n_shingles").alias("weight"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("rep")),
        "classes",
    )
    # Only the 64-bit name of a class travels for each band, and a bucket that holds one class goes no further.
    banded = worded.select("k1", F.posexplode("bands").alias("band", "bucket"))
    # Here and below, what a hot key's rows are joined with is written first: so the join may be split over tasks.
    named = steps.cut(banded.groupBy("bucket").agg(F.min("k1").alias("leader"), F.max("k1").alias("last")).filter("leader != last").drop("last"), "buckets")
    hits = steps.cut(
        banded.join(named, "bucket").groupBy("leader", "k1").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask")),
        "hits",
    )
    candidates = steps.cut(classes.join(hits.select("k1").distinct(), "k1", "left_semi"), "candidates")
    members = steps.cut(hits.join(candidates.select("k1", "key", "weight"), "k1").select("leader", "key", "mask", "weight"), "members")
    groups = steps.cut(members.groupBy("leader").agg(F.count("*").alias("m"), F.sum("weight").alias("total_weight")), "groups")
    total, weight = members.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    few = candidates.count()
    packs = max(1, total // PACK, weight // WEIGHT)

    reps = candidates.select("key", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    reps = F.broadcast(reps) if few <= FEW else reps
    texts = source.join(reps, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))).select("key", "text")
    # Rows that repeat an id and a text give one text.
    texts = steps.cut(texts.dropDuplicates(["key"]), "candidate-texts")

    width = F.greatest(F.ceil(F.col("m") / tile), F.least(F.col("m"), F.ceil(F.col("total_weight") / WEIGHT))).cast("int")
    placed = (
        members.join(groups, "leader")
        .withColumn("slot", F.pmod(F.xxhash64("key"), width).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), width - 1)))
        .withColumn("a", F.least("slot", "other"))
        .withColumn("b", F.greatest("slot", "other"))
        .withColumn("pack", F.when(width == 1, F.pmod(F.xxhash64("leader"), F.lit(packs))).otherwise(F.xxhash64("leader")))
    )
    full = placed.join(candidates.select("key", "n"), "key").join(texts, "key")
    found = steps.cut(
        full.select("pack", "leader", "a", "b", "key", "slot", "mask", "n", "text")
        .groupBy("pack", "a", "b")
        .applyInArrow(_tiles(n, threshold, bander), "key binary, root binary, links bigint, kinds bigint"),
        "links",
    )
    degree = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("kinds").alias("kinds"))
    parts = components(found.filter("key != root").select(F.col("key").alias("u"), F.col("root").alias("v")))
    labelled = (
        classes.select("key", "n", F.col("rep.id").alias("rep_id"), F.col("rep.no_id").alias("no_id"))
        .join(degree, "key", "left")
        .join(parts.withColumnsRenamed({"node": "key", "label": "part"}), "key", "left")
        .withColumn("part", F.coalesce("part", "key"))
    )
    firsts = steps.cut(labelled.groupBy("part").agg(F.min(F.struct("no_id", "rep_id")).alias("first")), "firsts")
    per_class = labelled.join(firsts, "part").select(
        "key",
        F.col("first.rep_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("kinds", F.lit(0)).alias("n_class_links"),
    )
    with_words = signed.filter("n_shingles > 0").select("id", "n_shingles", "key").join(per_class, "key").select("id", "class_id", "n_links", "n_class_links", "n_shingles")
    without = signed.filter("n_shingles = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(0).cast("bigint").alias("n_class_links"), "n_shingles")
    return steps.end(with_words.unionByName(without), "near-duplicates")
