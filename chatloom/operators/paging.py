"""Pages at any depth: where a page begins is counted, and only what lies there is sorted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that may be sorted to find where a page begins, and ranges that one pass counts.
MOST, RANGES = 100_000, 1024


@dataclass(frozen=True)
class Place:
    """A row's place in the order by (by descending, nulls first; tie descending)."""

    by: object
    tie: object


def newest_first(by: str, tie: str) -> tuple[Column, Column]:
    return F.col(by).desc_nulls_first(), F.col(tie).desc()


def page_after(df: DataFrame, by: str, tie: str, limit: int, last: Place | None = None, inclusive: bool = False) -> DataFrame:
    """The next rows behind a place, the first ones without any. The place is a filter, so what lies before it isn't sorted."""
    if last is not None:
        t = F.col(tie)
        behind = t <= F.lit(last.tie) if inclusive else t < F.lit(last.tie)
        if last.by is None:
            df = df.filter((F.col(by).isNull() & behind) | F.col(by).isNotNull())
        else:
            at = F.lit(last.by).cast(df.schema[by].dataType)
            df = df.filter((F.col(by) < at) | ((F.col(by) == at) & behind))
    return df.orderBy(*newest_first(by, tie)).limit(limit)


def _number(column: str, df: DataFrame) -> Column:
    """A whole number in the column's order."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "date":
        return F.unix_date(F.col(column)).cast("bigint")
    if kind in ("byte", "short", "integer", "long"):
        return F.col(column).cast("bigint")
    raise TypeError(f"{column} is a {kind}; pages are counted by whole numbers, dates and times")


def _descend(df: DataFrame, key: str, offset: int, most: int, ranges: int) -> tuple[int, int, int]:
    """(low, high, offset inside): the range [low, high] of key that holds the row at offset from the top, with at most ``most`` rows, or one value.

    Each pass counts equal ranges of the one that the last pass found; a count
    leaves a task as one row for each range, and the driver sees no more either.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    while n > most and low < high:
        width = -(-(high - low + 1) // ranges)
        inside = df.filter(F.col(key).between(low, high))
        found = inside.groupBy(F.expr(f"(`{key}` - {low}L) div {width}L").alias("range")).count().orderBy(F.desc("range")).collect()
        for r in found:
            if offset < r["count"]:
                break
            offset -= r["count"]
        low, high, n = low + r["range"] * width, min(high, low + (r["range"] + 1) * width - 1), r["count"]
    return low, high, offset


def place_at(df: DataFrame, by: str, tie: str, offset: int, most: int = MOST, ranges: int = RANGES) -> Place | None:
    """Place of the row that ``offset`` rows go before; None if there are no so many rows.

    by is a whole number, a date or a time and may be null; tie is a whole
    number that no two rows of one by share, and not null. The first passes count
    ranges of by, further ones ranges of tie within one value of by; of what is
    left, at most ``most`` rows, the place is found by sorting.
    """
    keys = df.select(F.col(by), F.col(tie), _number(by, df).alias("_by"), _number(tie, df).alias("_tie"))
    nulls, total = keys.agg(F.count(F.when(F.col(by).isNull(), 1)), F.count("*")).first()
    if offset >= total:
        return None
    if offset < nulls:
        found = keys.filter(F.col(by).isNull())
    else:
        low, high, offset = _descend(keys.filter(F.col(by).isNotNull()), "_by", offset - nulls, most, ranges)
        found = keys.filter(F.col("_by").between(low, high))
        if low < high:
            return _nth(found, by, tie, offset)
    low, high, offset = _descend(found, "_tie", offset, most, ranges)
    return _nth(found.filter(F.col("_tie").between(low, high)), by, tie, offset)


def _nth(found: DataFrame, by: str, tie: str, offset: int) -> Place:
    row = found.select(by, tie).orderBy(*newest_first(by, tie)).offset(offset).limit(1).first()
    return Place(row[0], row[1])


def page_at(df: DataFrame, by: str, tie: str, limit: int, offset: int, most: int = MOST, ranges: int = RANGES) -> DataFrame:
    """The rows that a sort of everything would give for this LIMIT and OFFSET; no task keeps more than the page or ``most`` rows."""
    if offset < most:
        return df.orderBy(*newest_first(by, tie)).offset(offset).limit(limit)
    first = place_at(df, by, tie, offset, most, ranges)
    return page_after(df, by, tie, limit, first, inclusive=True) if first else df.limit(0)
