"""Batches of requests: what each one gets, and the next version of each table that they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..sources import valid_text
from ..storage import cut
from .in_order import BLOCK, in_order

OK, CREATED, DELETED, BAD, UNKNOWN, MISSING, MALFORMED, REFUSED, DOWN = 200, 201, 204, 400, 401, 404, 422, 429, 503


def message_outcomes(requests: DataFrame, conversations: DataFrame, entitlements: DataFrame, unlimited: Column, concurrent: bool = False, block: int = BLOCK) -> DataFrame:
    """requests (request_id, conv_id, uid, header, kind, text) with status, title and last_turn.

    A typed text of a wrong length is malformed; else a conversation must be the
    user's; then the plan's limit must not be reached, unless the user or the
    header is in the ``unlimited`` list; then recognised text must not be blank.
    Users without a row or a limit in entitlements (user_id, used, daily) are
    not limited.

    A user's requests come one after the other by request_id, and each that is
    served counts for the next, also where the list lets it through. So the limit
    is never passed but by those. ``concurrent`` requests all arrive before any
    is counted: each sees only the use before the batch.
    """
    own = conversations.select(F.col("conv_id").alias("own_id"), F.col("user_id").alias("owner"), "title", "last_turn")
    plan = entitlements.select(F.col("user_id").alias("plan_user"), "used", "daily")
    joined = requests.join(own, (F.col("conv_id") == F.col("own_id")) & (F.col("uid") == F.col("owner")), "left").join(plan, F.col("uid") == F.col("plan_user"), "left")
    listed = fn.id_set(unlimited)
    free = F.coalesce(F.array_contains(listed, F.col("uid")), F.lit(False)) | F.coalesce(F.array_contains(listed, fn.int_or_null(F.col("header"))), F.lit(False))
    typed = F.col("kind") == "text"
    malformed = typed & ~valid_text(F.col("text"))
    blank = ~typed & (fn.strip(F.coalesce("text", F.lit(""))) == "")
    # Up to the first refusal these are all served, so until then their number is the use; from there on it stays above the limit.
    countable = ~malformed & F.col("own_id").isNotNull() & ~blank
    if concurrent:
        joined = joined.withColumn("_earlier", F.lit(0))
    else:
        joined = in_order(joined, "uid", "request_id", {"_earlier": countable}, block=block)
    status = (
        F.when(malformed, MALFORMED)
        .when(F.col("own_id").isNull(), MISSING)
        .when(~free & F.coalesce(F.col("used") + F.col("_earlier") >= F.col("daily"), F.lit(False)), REFUSED)
        .when(blank, BAD)
        .otherwise(OK)
    )
    return joined.select(*requests.columns, status.alias("status"), "title", "last_turn")


def appended_messages(outcomes: DataFrame, replies: DataFrame) -> DataFrame:
    """The two messages of each served request: conv_id, turn, role, content, input_type, tokens_used.

    replies are (request_id, run, reply, tokens). A run that didn't complete
    leaves its state as the reply, without tokens. Several requests to one
    conversation follow each other by request_id.
    """
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("request_id"))
    served = outcomes.filter(F.col("status") == OK).withColumn("n", order).join(replies, "request_id")
    done = F.col("run") == "completed"
    answer = F.when(done, F.col("reply")).otherwise(F.concat(F.lit("[error: run "), "run", F.lit("]")))
    pair = F.explode(
        F.array(
            F.struct(F.lit(1).alias("k"), F.lit("user").alias("role"), F.col("text").alias("content"), F.col("kind").alias("input_type"), F.lit(0).cast("long").alias("tokens_used")),
            F.struct(F.lit(0).alias("k"), F.lit("assistant").alias("role"), answer.alias("content"), F.lit("text").alias("input_type"), reply_tokens(F.col("run"), F.col("tokens")).alias("tokens_used")),
        )
    )
    return served.select("conv_id", "last_turn", "n", pair.alias("m")).select("conv_id", (F.col("last_turn") + 2 * F.col("n") - F.col("m.k")).alias("turn"), "m.role", "m.content", "m.input_type", "m.tokens_used")


def reply_tokens(run: Column, tokens: Column) -> Column:
    """What a reply cost: nothing where the run failed or reported nothing."""
    return F.when(run == "completed", F.coalesce(tokens, F.lit(0))).otherwise(0).cast("long")


def touched_conversations(conversations: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """The conversations behind a batch: an empty title becomes the first served text's head, and served ones are renewed."""
    first = outcomes.filter(F.col("status") == OK).groupBy("conv_id").agg(F.min_by("text", "request_id").alias("first_text"))
    joined = conversations.join(first, "conv_id", "left")
    served = F.col("first_text").isNotNull()
    title = F.when(served, fn.first_nonempty(F.col("title"), fn.prefix(F.col("first_text"), 80))).otherwise(F.col("title"))
    return joined.select(*[title.alias(c) if c == "title" else F.when(served, as_of).otherwise(F.col(c)).alias(c) if c == "updated_at" else c for c in conversations.columns])


def bumped_usage(entitlements: DataFrame, outcomes: DataFrame) -> DataFrame:
    """entitlements with one more use for each served request of the user."""
    more = outcomes.filter(F.col("status") == OK).groupBy(F.col("uid").alias("user_id")).agg(F.count("*").alias("more"))
    joined = entitlements.join(more, "user_id", "left")
    return joined.select(*[(F.col("used") + F.coalesce("more", F.lit(0))).alias("used") if c == "used" else c for c in entitlements.columns])


def next_versions(requests: DataFrame, conversations: DataFrame, entitlements: DataFrame, replies: DataFrame, unlimited: Column, as_of: Column) -> dict[str, DataFrame]:
    """outcomes, messages (the new ones), conversations and entitlements behind a batch, all from one table of outcomes, worked out once."""
    outcomes = cut(message_outcomes(requests, conversations, entitlements, unlimited), "outcomes")
    touched = touched_conversations(conversations.drop("last_turn"), outcomes, as_of)
    return {"outcomes": outcomes, "messages": appended_messages(outcomes, replies), "conversations": touched, "entitlements": bumped_usage(entitlements, outcomes)}


def deletions(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """requests (conv_id, uid) with status: deleted where the conversation is the user's, else missing."""
    own = conversations.select(F.col("conv_id").alias("own_id"), F.col("user_id").alias("owner"))
    joined = requests.join(own, (F.col("conv_id") == F.col("own_id")) & (F.col("uid") == F.col("owner")), "left")
    return joined.select(*requests.columns, F.when(F.col("own_id").isNull(), MISSING).otherwise(DELETED).alias("status"))


def creations(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """requests (request_id, uid, thread_id, title) with status and conv_id.

    Without a thread the assistant is down. New ids lie behind the largest old
    one, at the distance of the request's own number: so no task has to count
    all of them. The largest id is one row that the same job finds.
    """
    made = F.col("thread_id").isNotNull()
    top = conversations.agg(F.coalesce(F.max("conv_id"), F.lit(0))).scalar()
    return requests.select("*", F.when(made, CREATED).otherwise(DOWN).alias("status"), F.when(made, top + 1 + F.col("request_id")).alias("conv_id"))


#: What a sequence of sign-ins of one user comes to; parts of it, in any order, are merged by the same minimum and maxima.
SIGN_INS = ["first", "named", "shown"]


def sign_in_parts(given: DataFrame) -> DataFrame:
    """(tg_uid, first, named, shown): of each user's requests in given the first, the last with a username, and the last with a display name.

    given are (request_id, tg_uid, username, display_name, language_code).
    Requests without a user have no part in it.
    """
    at = F.col("request_id")
    name, shown = (F.nullif(c, F.lit("")) for c in ("username", "display_name"))
    rows = given.filter(F.col("tg_uid").isNotNull()).select(
        "tg_uid", F.struct(at, "username", "language_code").alias("first"), F.when(name.isNotNull(), F.struct(at, name.alias("value"))).alias("named"), F.when(shown.isNotNull(), F.struct(at, shown.alias("value"))).alias("shown")
    )
    return merged_sign_ins(rows)


def merged_sign_ins(parts: DataFrame) -> DataFrame:
    return parts.groupBy("tg_uid").agg(F.min("first").alias("first"), F.max("named").alias("named"), F.max("shown").alias("shown"))


def users_after(users: DataFrame, parts: DataFrame, as_of: Column) -> DataFrame:
    """Users (tg_uid, username, display_name, language_code, accepted_terms_at) after the sign-ins of parts, with is_new.

    Known users take each name that was given last and wasn't empty, and keep the
    rest. New ones have the language of their first request, its username until
    one is given, and have accepted the terms now.
    """
    given = parts.select(F.col("tg_uid").alias("_uid"), *SIGN_INS)
    joined = users.withColumn("_old", F.lit(True)).join(given, F.col("tg_uid") == F.col("_uid"), "full")
    old, uid = F.col("_old").isNotNull(), F.coalesce("tg_uid", "_uid")
    return joined.select(
        uid.alias("tg_uid"),
        F.coalesce("named.value", F.when(old, F.col("username")).otherwise(F.col("first.username"))).alias("username"),
        F.coalesce("shown.value", F.when(old, F.col("display_name")).otherwise(fallback_name(uid))).alias("display_name"),
        F.when(old, F.col("language_code")).otherwise(F.col("first.language_code")).alias("language_code"),
        F.when(old, F.col("accepted_terms_at")).otherwise(as_of).alias("accepted_terms_at"),
        (~old).alias("is_new"),
    )


def fallback_name(uid: Column) -> Column:
    return F.concat(F.lit("User "), uid.cast("string"))


def registered(users: DataFrame, given: DataFrame, as_of: Column) -> DataFrame:
    """Users after a batch of sign-ins, with is_new (see users_after)."""
    return users_after(users, sign_in_parts(given), as_of)


def sign_ins(users: DataFrame, given: DataFrame, as_of: Column, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """One answer per request: request_id, tg_uid, and the user's columns and is_new as they are right behind it.

    A user's requests come one after the other by request_id; is_new is true on
    the first of an unknown user only. Requests without a user have nulls.
    ``parts`` is how many tasks the requests are ordered in (see in_order).
    """
    before = users.select("tg_uid", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in ("username", "display_name", "language_code", "accepted_terms_at")])
    lasts = {f"_last_{c}": F.nullif(c, F.lit("")) for c in ("username", "display_name")}
    first = {"first": F.struct("username", "language_code")}
    joined = in_order(given.select("request_id", "tg_uid", "username", "display_name", "language_code"), "tg_uid", "request_id", {"_earlier": F.lit(True)}, lasts, block, first, before, parts)
    old, found = F.col("_known").isNotNull(), F.col("tg_uid").isNotNull()
    return joined.select(
        "request_id",
        "tg_uid",
        F.when(found, F.coalesce("_last_username", F.when(old, F.col("_username")).otherwise(F.col("first.username")))).alias("username"),
        F.when(found, F.coalesce("_last_display_name", F.when(old, F.col("_display_name")).otherwise(fallback_name(F.col("tg_uid"))))).alias("display_name"),
        F.when(found, F.when(old, F.col("_language_code")).otherwise(F.col("first.language_code"))).alias("language_code"),
        F.when(found, F.when(old, F.col("_accepted_terms_at")).otherwise(as_of)).alias("accepted_terms_at"),
        F.when(found, ~old & (F.col("_earlier") == 0)).alias("is_new"),
    )


def new_subscriptions(users: DataFrame, plans: DataFrame) -> DataFrame:
    """(user_id, plan_id): the free plan for each new user of users_after; none where there is no free plan."""
    free = plans.filter("type = 'free'").groupBy("type").agg(F.min("plan_id").alias("plan_id"))
    return users.filter("is_new").select(F.col("tg_uid").alias("user_id"), F.lit("free").alias("type")).join(F.broadcast(free), "type").drop("type")
