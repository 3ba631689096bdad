"""Usage counters that are kept up to date: days, months and lifetime, from new events only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merged import EVERY, MergedTable

#: (user, level, since) is the key; since is the first day of the span, null for all time.
USAGE = "user_id bigint, level string, since date, used bigint, last_used timestamp_ntz"
LEVELS = ("day", "month", "lifetime")


def usage_parts(events: DataFrame, levels: tuple[str, ...] = LEVELS, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """What events add to the counters of each level, in one pass: days first, then months and lifetimes of days.

    Events without a user or a time count for none.
    """
    days = events.select(F.col(user).cast("bigint").alias("user_id"), F.col(ts).cast("timestamp_ntz").alias("ts")).filter("user_id is not null and ts is not null")
    days = days.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("used"), F.max("ts").alias("last_used"))
    days = days.withColumn("month", F.trunc("day", "month"))
    keys = {"day": ["user_id", "day"], "month": ["user_id", "month"], "lifetime": ["user_id"]}
    level = F.when(F.grouping("day") == 0, "day").when(F.grouping("month") == 0, "month").otherwise("lifetime")
    rolled = days.groupingSets([keys[x] for x in levels], "user_id", "day", "month").agg(level.alias("level"), F.sum("used").alias("used"), F.max("last_used").alias("last_used"))
    return rolled.withColumn("since", F.coalesce("day", "month")).select("user_id", "level", "since", "used", "last_used")


def merged_usage(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id", "level", "since").agg(F.sum("used").alias("used"), F.max("last_used").alias("last_used"))


class UsageTable(MergedTable):
    def __init__(self, spark: SparkSession, folder: str, levels: tuple[str, ...] = LEVELS, every: int = EVERY):
        super().__init__(spark, folder, USAGE, merged_usage, every)
        self.levels = levels

    def append(self, events: DataFrame, number: int) -> None:
        """One more day, or any other set, of events; old ones are not read again."""
        self.add(usage_parts(events, self.levels), number)

    def drain(self, events: DataFrame) -> None:
        super().drain(events, lambda batch: usage_parts(batch, self.levels))


def usage_stream(spark: SparkSession, folder: str, levels: tuple[str, ...] = LEVELS, every: int = EVERY) -> UsageTable:
    """Counters of each user that equal the batch count of all events seen so far, whatever their order and their batches."""
    return UsageTable(spark, folder, levels, every)
