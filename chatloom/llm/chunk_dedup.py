"""Exact de-duplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so: after a sentence end that stands at
least ``low`` characters behind the last cut, at ``high`` characters at the
latest. An edit therefore moves the cuts near it and no others. Each distinct
chunk travels once, when identifiers are verified; after that only lists of
identifiers move, and two texts are equal when their ordered lists are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import SPACES, Steps, spread, whole_text

#: Colliding hashes that may be broadcast, at 8 bytes each.
FEW = 200_000

#: Sentence ends at which a chunk may close.
CUT_AFTER = r"(?<=[.!?;] |[。！？])"


def chunk_pattern(low: int, high: int) -> str:
    return rf"(?s).{{{low},{high}}}?(?:{CUT_AFTER}|\z)|.{{1,{high}}}"


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    low: int = 256,
    high: int = 4096,
    hash_bits: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are identical once every run of white space is one
    space. Of equal texts the smallest doc_id stays; a null id stays only where a
    group has no other. Null text is empty, and all empty texts are one group.
    Rows that repeat both id and text are the same document: each carries the
    same values. An empty table gives an empty result. Other columns are ignored.

    ``hash_bits`` shortens the chunk hash, so that tests meet collisions.
    """
    steps = Steps(docs.sparkSession)
    short = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(c)
    normal = spread(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.regexp_replace(whole_text(text_col), SPACES, " ").alias("norm"),
        )
    )
    chunks = F.regexp_extract_all("norm", F.lit(chunk_pattern(low, high)), F.lit(0))

    # Verification: an identifier is a hash, numbered where several chunks share the hash.
    distinct = normal.select(F.explode(chunks).alias("chunk")).select(short("chunk").alias("h"), "chunk").distinct()
    shared = steps.cut(distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "chunk-collisions")

    recipes = normal.select("doc_id", _digest(), F.transform(chunks, lambda c: short(c)).alias("recipe"))
    collisions = shared.count()
    if collisions:
        recipes = recipes.join(_collision_numbers(normal, chunks, short, shared, collisions, steps), "text_sha256", "left")
    else:
        recipes = recipes.withColumn("numbers", F.lit(None).cast("array<struct<pos:int,number:int>>"))
    recipes = steps.cut(recipes.withColumn("numbers", F.coalesce("numbers", F.array().cast("array<struct<pos:int,number:int>>"))), "recipes")

    keys = ["recipe", "numbers"]
    # Written, so that the join with the many copies of one recipe may be split over tasks.
    groups = steps.cut(recipes.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    found = recipes.join(groups, keys).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
    return steps.end(found, "exact-copies")


def _digest():
    return F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256")


def _collision_numbers(normal, chunks, short, shared, collisions, steps) -> DataFrame:
    """text_sha256, numbers: the (place, number) of the chunks that share a hash with another chunk, numbered in byte order.

    Only those chunks move, and only rows that hold one.
    """
    shared = F.broadcast(shared) if collisions <= FEW else shared
    parts = normal.select(_digest(), F.posexplode(chunks).alias("pos", "chunk")).withColumn("h", short("chunk")).join(shared, "h", "left_semi")
    parts = steps.cut(parts.distinct(), "colliding-chunks")
    ranks = parts.select("h", "chunk").distinct().withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    numbers = parts.join(ranks, ["h", "chunk"]).groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("numbers"))
    # Written, so that the join with the many copies of one text may be split over tasks.
    return steps.cut(numbers, "collision-numbers")
