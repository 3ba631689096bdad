"""Whoever sends a request becomes a user: the one that it names, inserted if unknown, or else the guest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions.init_data import resolve_id
from . import insert_missing
from .requests import fallback_name, new_subscriptions

#: The guest, whom requests without any name have in common, and the plan that is made where there is no free one.
GUEST = {"username": "guest", "display_name": "Гость", "language_code": "ru"}
FREE_PLAN = {"type": "free", "daily": 20, "monthly": 500}


def _of(user: str, uid: Column) -> list[Column]:
    first, last = F.col(f"{user}.first_name"), F.col(f"{user}.last_name")
    name = fn.first_nonempty(F.col(f"{user}.username"), F.concat(F.lit("user_"), uid.cast("string")))
    return [name.alias("username"), fn.display_name(first, last, uid).alias("display_name"), fn.first_nonempty(F.col(f"{user}.language_code"), F.lit("ru")).alias("language_code")]


def named_by(requests: DataFrame) -> DataFrame:
    """requests (request_id, signed, header, parsed), users as init_data.user gives them, with uid and the user that would be made of each.

    The signed user goes before the header, this before the unsigned one; a
    header that is no number names nobody.
    """
    by_header = fn.int_or_null(F.col("header"))
    uid = resolve_id(F.col("signed.id"), F.col("header"), F.col("parsed.id"))
    bare = [F.concat(F.lit("user_"), by_header.cast("string")).alias("username"), fallback_name(by_header).alias("display_name"), F.lit("ru").alias("language_code")]
    guest = [F.lit(v).alias(k) for k, v in GUEST.items()]
    made = (
        F.when(F.col("signed.id").isNotNull(), F.struct(*_of("signed", F.col("signed.id"))))
        .when(by_header.isNotNull(), F.struct(*bare))
        .when(F.col("parsed.id").isNotNull(), F.struct(*_of("parsed", F.col("parsed.id"))))
        .otherwise(F.struct(*guest))
    )
    return requests.select("*", uid.alias("uid"), made.alias("made"))


def arrivals(requests: DataFrame, users: DataFrame, plans: DataFrame) -> dict[str, DataFrame]:
    """``answers`` (request_id, uid, is_new), and behind the batch ``users`` (tg_uid, username, display_name, language_code), new ``subscriptions`` and ``plans``.

    A user that isn't known is made of its first request, by request_id, which
    alone is answered as new; known ones stay as they are, whatever they are
    called now. Each new user, the guest too, gets one subscription of the free
    plan, which is made if there is none.
    """
    named = named_by(requests)
    # One row for each user leaves a task, so all the guest's requests are a row of each.
    first = named.groupBy(F.col("uid").alias("tg_uid")).agg(F.min(F.struct("request_id", "made")).alias("first"))
    new = first.join(users.select("tg_uid"), "tg_uid", "left_anti").select("tg_uid", "first.made.*", F.col("first.request_id").alias("_first"))
    after = insert_missing(users, new.select(*users.columns), "tg_uid")
    had = plans_with_free(plans)
    makers = new.select(F.col("_first").alias("request_id"), F.lit(True).alias("is_new"))
    answers = named.select("request_id", "uid").join(makers, "request_id", "left").select("request_id", "uid", F.coalesce("is_new", F.lit(False)).alias("is_new"))
    return {"answers": answers, "users": after, "subscriptions": new_subscriptions(new.withColumn("is_new", F.lit(True)), had), "plans": had}


def plans_with_free(plans: DataFrame) -> DataFrame:
    """plans (plan_id, type, daily, monthly, and others), and a free one behind them if there is none."""
    behind = plans.agg(F.coalesce(F.max("plan_id"), F.lit(0)).alias("top"), F.count_if(F.col("type") == "free").alias("free")).filter("free = 0")
    made = {"plan_id": F.col("top") + 1} | {k: F.lit(v) for k, v in FREE_PLAN.items()}
    return plans.unionByName(behind.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in plans.schema]))
