"""Relational operators of the chat service: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a lookup table may have to be broadcast.
FEW = 100_000


def unique_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a unique key; the filter reaches the scan."""
    return df.filter(F.col(key) == value)


def first_by(df: DataFrame, condition: Column, *order: str) -> DataFrame:
    """One row that meets the condition: the first in a total order."""
    return df.filter(condition).orderBy(*order).limit(1)


def owned(df: DataFrame, key: str, value, owner: str, owner_id) -> DataFrame:
    """The row if it is the owner's, else none."""
    return df.filter((F.col(key) == value) & (F.col(owner) == owner_id))


def newest_page(df: DataFrame, by: str, tie: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page, newest first, rows without a date before all others; planned as one top-k."""
    return df.orderBy(F.col(by).desc_nulls_first(), F.col(tie).desc()).offset(offset).limit(limit)


def latest_child(children: DataFrame, parent: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each parent's last child. max_by aggregates before the shuffle, so a parent with many children costs no more."""
    at = F.struct(*order)
    found = children.groupBy(parent).agg(F.max_by(F.struct(*columns), at).alias("latest"))
    return found.select(parent, *[F.col(f"latest.{c}").alias(c) for c in columns])


def page_with_latest(parents: DataFrame, children: DataFrame, key: str, by: str, order: str, column: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of parents, newest first, each with ``column`` of its last child, null where it has none.

    Parents are expected to be the owner's. The page comes first and has at most
    ``limit`` rows, so it may be broadcast, and only its children are aggregated.
    """
    page = newest_page(parents, by, key, limit, offset)
    last = latest_child(children.select(key, order, column).join(F.broadcast(page.select(key)), key, "left_semi"), key, [order], [column])
    return newest_page(page.join(last, key, "left"), by, key, limit)


def first_child(children: DataFrame, condition: Column, parent: str, order: list[str], column: str, name: str) -> DataFrame:
    return children.filter(condition).groupBy(parent).agg(F.min_by(column, F.struct(*order)).alias(name))


def ordered_children(children: DataFrame, parent: str, order: list[str], columns: list[str], name: str = "items") -> DataFrame:
    """Each parent's children as one ordered list."""
    listed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return children.groupBy(parent).agg(listed.alias(name))


def lookup(df: DataFrame, dimension: DataFrame, on: str, defaults: dict) -> DataFrame:
    """Left lookup with a default for each looked-up column. AQE broadcasts the side that turns out small."""
    joined = df.join(dimension, on, "left")
    for name, value in defaults.items():
        joined = joined.withColumn(name, F.coalesce(name, F.lit(value)))
    return joined


def one_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    columns = [c for c in df.columns if c != key]
    return latest_child_first(df, key, order, columns)


def latest_child_first(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    found = df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("first"))
    return found.select(key, *[F.col(f"first.{c}").alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: str, keep_unless_given: list[str], only_new: dict[str, Column] | None = None) -> DataFrame:
    """The table's next version: known keys take given non-empty values, unknown keys are added whole."""
    n = new.select([F.col(c).alias(f"new_{c}") for c in new.columns]).withColumn("is_given", F.lit(True))
    o = old.withColumn("is_old", F.lit(True))
    joined = o.join(n, F.col(key) == F.col(f"new_{key}"), "full")
    out = []
    for c in old.columns:
        given = F.col(f"new_{c}") if c in new.columns else (only_new or {}).get(c, F.lit(None))
        if c == key:
            value = F.coalesce(key, f"new_{key}")
        elif c in keep_unless_given:
            value = F.coalesce(F.nullif(given, F.lit("")), c)
        else:
            value = F.when(F.col("is_old"), F.col(c)).otherwise(given)
        out.append(value.cast(old.schema[c].dataType).alias(c))
    return joined.select(*out, F.col("is_old").isNull().alias("is_new"))


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti").select(old.columns))


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given parents."""
    left = parents.join(gone.select(parent_key), parent_key, "left_anti")
    return left, children.join(gone.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def backfill(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.coalesce(column, F.lit(value)))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that break uniqueness, with how often they occur."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def last_per_parent_window(children: DataFrame, parent: str, order: str) -> DataFrame:
    """The same as latest_child with whole rows: Spark limits each group to one before and after the shuffle."""
    w = Window.partitionBy(parent).orderBy(F.col(order).desc())
    return children.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
