"""What a sequence of rows has come to at each of them, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the order that one window holds at most.
BLOCK = 100_000


def in_order(
    df: DataFrame, key: str, order: str, counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, block: int = BLOCK,
    firsts: dict[str, Column] | None = None, beside: DataFrame | None = None, parts: int | None = None,
) -> DataFrame:
    """df with running columns over the rows of each key, in the order of a whole number that no two of them share.

    counts: how many earlier rows of the key meet the condition. lasts: the last
    value that isn't null, up to the row itself. firsts: the value of the key's
    first row. Rows without a key have no history: 0 and their own values.
    beside: rows of the same key, whose other columns each row gets, null where there is none.

    A key's rows are parted into blocks of the order; blocks are summed up before
    they meet, and a window holds one block, so a key may have any share of all
    rows. Where each row of files became many, ``parts`` says over how many
    tasks windows are dealt; without, Spark goes by the bytes of their compressed shuffle.
    """
    counts, lasts, firsts = counts or {}, lasts or {}, firsts or {}
    flags = {f"_is_{n}": F.coalesce(c, F.lit(False)).cast("long") for n, c in counts.items()} | {f"_at_{n}": c for n, c in (lasts | firsts).items()}
    rows = df.withColumn("_block", F.expr(f"`{order}` div {block}")).withColumns(flags)
    sums = [F.sum(f"_is_{n}").alias(f"_sum_{n}") for n in counts]
    sums += [F.max_by(f"_at_{n}", F.when(F.col(f"_at_{n}").isNotNull(), F.col(order))).alias(f"_sum_{n}") for n in lasts]
    sums += [F.min_by(f"_at_{n}", order).alias(f"_sum_{n}") for n in firsts]
    through = Window.partitionBy("_key").orderBy("_from")
    earlier = through.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), F.col("_block").alias("_from")).agg(*sums)
    before = [F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in counts] + [F.last(f"_sum_{n}", True).over(earlier).alias(f"_before_{n}") for n in lasts]
    before += [F.first(f"_sum_{n}").over(through.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_before_{n}") for n in firsts]
    blocks, more = blocks.select("_key", "_from", *before), []
    if beside is not None:
        # What belongs to a key meets its blocks, which are fewer than its rows and lie by key already.
        more = [c for c in beside.columns if c != key]
        beside = beside.withColumnRenamed(key, "_beside")
        blocks = blocks.join(beside if parts is None else beside.hint("merge"), F.col("_key") == F.col("_beside"), "left").drop("_beside")
    # Sides of large batches aren't broadcast, however small the files that they were made of.
    rows, blocks = (rows, blocks) if parts is None else (rows.repartition(parts, key, "_block"), blocks.hint("merge"))
    within = Window.partitionBy(key, "_block").orderBy(order)
    until = within.rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(key).isNotNull()
    out = {n: F.when(known, F.coalesce(F.sum(f"_is_{n}").over(until), F.lit(0)) + F.coalesce(f"_before_{n}", F.lit(0))).otherwise(0) for n in counts}
    out |= {n: F.when(known, F.coalesce(F.last(f"_at_{n}", True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)), f"_before_{n}")).otherwise(F.col(f"_at_{n}")) for n in lasts}
    out |= {n: F.when(known, F.col(f"_before_{n}")).otherwise(F.col(f"_at_{n}")) for n in firsts}
    joined = rows.join(blocks, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_from")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in out.items()], *more)
