"""Mixing sources to target weights by the cube method.

Each source has a rate: its target over its size. Every document is taken
floor(rate) times, and the fraction left is an inclusion probability. The
flight phase moves these probabilities in the null space of two constraints,
words taken and documents taken, until each is 0 or 1 but for at most two per
block; what is left flies again with the leftovers of other blocks. The last
two of a source land by their probabilities.

Blocks are bounded and keyed by a hash, so a source with a third of all rows
is as many blocks as it needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import WORDS, arrow_batches, cut, spread, whole_text

#: Times its size that a source may be taken.
MOST = 3.0
WEIGHTS = (1, 2, 3)
BLOCK = 2_000
EDGE = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target for a table of source sizes.

    Sources are numbered in order of code points, null last, and weighed in turn.
    A target stops at ``most`` times its source's size and the excess is shared
    again by weight: the fixed point is min(most * size, weight * level) with one
    level for all, found by filling sources in order of the level that caps them.

    The windows run over one row per source, the smallest table of the operator.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    capped = sizes.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("fills", F.col("cap") / F.col("weight"))
    ahead = Window.orderBy("fills", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    )
    # The level at which the first source that isn't filled takes what is left; from there on it only falls.
    found = capped.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(every))
    return found.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def fly(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move p along the null space of (size, 1) until at most two are fractional."""
    p = p.copy()
    active: list[int] = []
    fresh, n, turn = 0, len(p), 0
    while True:
        while len(active) < 3 and fresh < n:
            if EDGE < p[fresh] < 1 - EDGE:
                active.append(fresh)
            fresh += 1
        if len(active) < 2:
            return p
        if len(active) == 3:
            a, b, c = active
            u = [float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b])]
            if u[0] == u[1] == u[2] == 0:
                u = [1.0, -1.0, 0.0]
        elif size[active[0]] == size[active[1]]:
            u = [1.0, -1.0]
        else:
            return p
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u) if x)
        step = up if draw[turn % n] < down / (up + down) else -down
        turn += 1
        for i, x in zip(active, u):
            p[i] += step * x
            if p[i] <= EDGE or p[i] >= 1 - EDGE:
                p[i] = round(p[i])
        active = [i for i in active if EDGE < p[i] < 1 - EDGE]


def land(p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The landing: the constraints are dropped and what is left is drawn by its probability."""
    left = (p > EDGE) & (p < 1 - EDGE)
    return np.where(left, (draw < p).astype(float), p)


def _flight(last: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("draw", "ascending"), ("size", "ascending"), ("doc_id", "ascending")])
        size, p, draw = (rows[c].to_numpy() for c in ("size", "p", "draw"))
        q = fly(size, p, (draw * 7919.0) % 1.0)
        if last:
            q = land(q, (draw * 104729.0) % 1.0)
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(q))

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: float = MOST,
    block: int = BLOCK,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, source.

    Size is the text's number of words (null: 0). taken = size * copies. A null
    source is a source. Documents without words take part with size 0, and a
    source without words has target 0 and is not taken. Repeated rows are
    separate units. Reruns agree: the draws are hashes of id, size and seed.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    # Rows of a few numbers: larger batches. All that uses them is written before the setting goes back.
    arrow_batches(spark, rows=20_000)
    try:
        return _mix(docs, id_col, text_col, source_col, weights, most, block, seed)
    finally:
        arrow_batches(spark)


def _mix(docs, id_col, text_col, source_col, weights, most, block, seed) -> DataFrame:
    units = cut(
        spread(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), whole_text(text_col).alias("text"))).select(
            "doc_id", "source", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("size")
        ),
        "mix-units",
    )
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    goals = targets(sizes.drop("units"), weights, most).withColumnsRenamed({"source": "goal_source", "source_size": "goal_size"})
    plan = cut(sizes.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).select("source", "source_size", "target", "units"), "mix-targets")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    named = plan.withColumnsRenamed({"source": "plan_source"})
    started = (
        units.join(named, F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn("rate", rate)
        .withColumn("whole", F.floor(F.col("rate") + EDGE))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
        .withColumn("p", F.when(F.col("p") < EDGE, 0.0).otherwise(F.col("p")))
        .withColumn("draw", F.pmod(hashed, F.lit(1 << 40)) / float(1 << 40))
        .withColumn("blocks", F.ceil(F.col("units") / block))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "p", "draw", "blocks")
    )
    schema = T.StructType([*started.schema.fields, T.StructField("block", T.LongType())])
    fraction = (F.col("p") > EDGE) & (F.col("p") < 1 - EDGE)
    done = []
    frame = started
    most_blocks = (plan.agg(F.max(F.ceil(F.col("units") / block))).first()[0]) or 1
    while True:
        last = most_blocks <= 1
        key = F.pmod(F.xxhash64("draw", "doc_id", F.lit(most_blocks)), F.col("blocks"))
        flown = frame.withColumn("block", key).groupBy("source", "block").applyInArrow(_flight(last), schema)
        flown = cut(flown.drop("block"), "mix-flight")
        if last:
            done.append(flown)
            break
        done.append(flown.filter(~fraction))
        # At most two of a block are left, so few blocks take them.
        most_blocks = -(-most_blocks * 2 // block)
        frame = flown.filter(fraction).withColumn("blocks", F.ceil(F.col("blocks") * 2 / block))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source")
