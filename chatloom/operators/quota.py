"""Usage counting and entitlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import remaining

#: What a user without plan is told is left.
DEFAULT_DAILY, DEFAULT_MONTHLY, DEFAULT_PLAN = 5, 50, "free"


def usage(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Lifetime use of each user: the service's own counters, which nothing resets."""
    return events.groupBy(user).agg(F.count("*").alias("used"), F.max(ts).alias("last_used"))


def daily_usage(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Use of each user on each day, which the limit's name suggests."""
    return events.groupBy(user, F.col(ts).cast("date").alias("day")).agg(F.count("*").alias("used"), F.max(ts).alias("last_used"))


def entitled(usage_by_user: DataFrame, limit: Column) -> DataFrame:
    """Adds what is left and whether the next request is refused; without a limit nothing is refused."""
    left = F.when(limit.isNull(), F.lit(DEFAULT_DAILY).cast("bigint")).otherwise(remaining(limit, F.col("used")))
    return usage_by_user.withColumn("remaining", left).withColumn("blocked", F.coalesce(F.col("used") >= limit, F.lit(False)))
