"""Whole requests as one plan each, and usage as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from .. import streaming
from ..functions import answers, init_data
from ..operators import arrivals as ar
from ..operators import quota
from ..operators import requests as rq
from ..sources import SHARE, dealt, dealt_parts, table
from ..storage import cut, scratch
from .lookups import PLAN_SQL, UNLIMITED, plans

QUERIES: dict = {}
SQL: dict[str, str] = {}

SQL["api_send_message"] = f"""
WITH last AS (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id),
u AS (SELECT user_id, arg_max(used, day) AS used FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY ALL) GROUP BY user_id)
SELECT conv_id, CASE WHEN c_custkey IS NULL THEN 404 WHEN trim(text) = '' THEN 400 WHEN coalesce(coalesce(used, 0) >= daily, false) THEN 429 ELSE 200 END AS status,
       substring(text, 1, 80) AS title
FROM last LEFT JOIN customer ON c_custkey = conv_id + 1 AND c_acctbal >= 0 LEFT JOIN u ON user_id = c_custkey LEFT JOIN {PLAN_SQL} ON segment = c_mktsegment
WHERE role = 'user'
"""


def last_day(spark, d):
    """user_id, used: requests on the last day that the user made any."""
    return op.latest_child(quota.daily_usage(table(spark, d, "events")), "user_id", ["day"], ["used"])


def api_send_message(spark, d):
    """What each waiting question gets: no owner in good standing, blank, over quota on the user's last day, or served."""
    last = op.latest_child(table(spark, d, "conversations"), "conv_id", ["turn"], ["turn", "role", "text"]).filter("role = 'user'")
    users = table(spark, d, "customer").filter("c_acctbal >= 0").select((F.col("c_custkey") - 1).alias("conv_id"), "c_custkey", F.col("c_mktsegment").alias("segment"))
    used = last_day(spark, d).withColumnRenamed("user_id", "c_custkey")
    joined = last.join(users, "conv_id", "left").join(used, "c_custkey", "left").join(plans(spark).select("segment", "daily"), "segment", "left")
    over = F.coalesce(F.coalesce("used", F.lit(0)) >= F.col("daily"), F.lit(False))
    status = F.when(F.col("c_custkey").isNull(), 404).when(fn.strip(F.col("text")) == "", 400).when(over, 429).otherwise(200)
    return joined.select("conv_id", status.alias("status"), fn.prefix(F.col("text"), 80).alias("title"))


SQL["api_me"] = f"""
SELECT c_custkey AS user_id, c_name AS display_name, coalesce(type, 'free') AS plan_type,
       CASE WHEN type IS NULL THEN 5 ELSE greatest(0, daily - coalesce(used, 0)) END AS daily_left,
       CASE WHEN type IS NULL THEN 50 ELSE greatest(0, monthly - coalesce(used, 0)) END AS monthly_left
FROM customer LEFT JOIN (SELECT user_id, count(*) AS used FROM events GROUP BY user_id) ON user_id = c_custkey LEFT JOIN {PLAN_SQL} ON segment = c_mktsegment
"""


def api_me(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("segment"))
    used = quota.usage(table(spark, d, "events")).select("user_id", "used")
    joined = users.join(used, "user_id", "left").join(plans(spark).select("segment", "type", "daily", "monthly"), "segment", "left")
    left = lambda limit, default: F.when(F.col("type").isNull(), F.lit(default).cast("bigint")).otherwise(fn.remaining(F.col(limit), F.col("used")))
    return joined.select("user_id", "display_name", F.coalesce("type", F.lit("free")).alias("plan_type"), left("daily", quota.DEFAULT_DAILY).alias("daily_left"), left("monthly", quota.DEFAULT_MONTHLY).alias("monthly_left"))


SQL["api_health"] = """
SELECT t.name AS table_name, CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, 'chatloom' AS service FROM (
    SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events) t
"""


def api_health(spark, d):
    """Whether the tables that requests need are there and hold rows; only their footers are read."""
    found = [table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("customer", "conversations", "events")]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.select("table_name", F.when(F.col("n") > 0, "ok").otherwise("empty").alias("status"), F.lit("chatloom").alias("service"))


SQL["api_thread_cleaned"] = r"""
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN regexp_replace(concat('{', text, '}'), '(\$\$[\s\S]*?\$\$|\$\$[\s\S]*|\$[^$]+\$|\$[^$]*)|[{}]', '\1', 'g') ELSE text END AS content
FROM conversations
"""


def api_thread_cleaned(spark, d):
    """Every thread in its order: threads are kept whole and sorted where they lie, not against each other."""
    turns = table(spark, d, "conversations")
    content = F.when(F.col("role") == "assistant", answers.clean_outside_math(F.concat(F.lit("{"), F.col("text"), F.lit("}")))).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", "role", content.alias("content")).repartition("conv_id").sortWithinPartitions("conv_id", "turn")


SQL["x_stream_daily_usage"] = "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY ALL"


def x_stream_daily_usage(spark, d):
    """Beyond the service: its usage counter as a stream, equal to the batch count once drained, in whatever order events come."""
    usage = streaming.usage_stream(spark, scratch(spark, "usage"), levels=("day",))
    usage.drain(streaming.file_stream(spark, d, "events.parquet"))
    return usage.read().select("user_id", F.col("since").alias("day"), "used")


# A batch of requests over whole tables: four for each conversation with a question, some from strangers, some blank, some spoken or seen.
BATCH_SQL = f"""
WITH conv AS (
    SELECT conv_id, conv_id + 1 AS user_id, CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 2 THEN 'Chat ' || conv_id END AS title,
           CASE WHEN conv_id % 5 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS updated_at, max(turn) AS last_turn
    FROM conversations GROUP BY conv_id),
asked AS (SELECT conv_id, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text FROM conversations WHERE role = 'user' GROUP BY conv_id),
req AS (
    SELECT conv_id * 4 + k AS request_id, conv_id, conv_id + CASE WHEN conv_id % 7 = 3 THEN 2 ELSE 1 END AS uid,
           CASE WHEN conv_id % 11 = 0 THEN ' 12' WHEN conv_id % 11 = 1 THEN 'x' END AS header,
           CASE (conv_id + k) % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'audio' ELSE 'image' END AS kind,
           CASE WHEN conv_id % 10 = 9 THEN '  ' WHEN conv_id % 10 = 8 THEN '' WHEN k = 0 THEN first_text ELSE last_text END AS text
    FROM asked, (VALUES (0), (1), (2), (3)) AS v(k)),
today AS (SELECT user_id, arg_max(used, day) AS used FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY ALL) GROUP BY user_id),
ent AS (SELECT c_custkey AS user_id, coalesce(used, 0) AS used, daily FROM customer LEFT JOIN today ON user_id = c_custkey JOIN {PLAN_SQL} ON segment = c_mktsegment),
checked AS (
    SELECT r.*, title, last_turn, used, daily, c.conv_id IS NULL AS missing, kind = 'text' AND NOT length(text) BETWEEN 1 AND 4000 AS malformed, kind <> 'text' AND trim(text) = '' AS blank
    FROM req r LEFT JOIN conv c ON c.conv_id = r.conv_id AND c.user_id = r.uid LEFT JOIN ent ON ent.user_id = uid),
counted AS (
    SELECT *, count(*) FILTER (NOT malformed AND NOT missing AND NOT blank) OVER (PARTITION BY uid ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM checked),
done AS (
    SELECT *, CASE WHEN malformed THEN 422 WHEN missing THEN 404
        WHEN uid NOT IN (7, 12, 400) AND coalesce(header, '') <> ' 12' AND coalesce(used + earlier >= daily, false) THEN 429 WHEN blank THEN 400 ELSE 200 END AS status
    FROM counted)
"""


def batch(spark, d):
    """(conversations, requests, entitlements, outcomes) of BATCH_SQL."""
    turns, k = table(spark, d, "conversations"), F.col("conv_id")
    conversations = turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn")).select(
        "conv_id",
        (k + 1).alias("user_id"),
        F.when(k % 3 == 0, "").when(k % 3 == 2, F.concat(F.lit("Chat "), k.cast("string"))).alias("title"),
        F.when(k % 5 > 0, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).alias("updated_at"),
        "last_turn",
    )
    asked = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"), F.max_by("text", "turn").alias("last_text"))
    n = F.col("n")
    requests = asked.withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(4)]))).select(
        (k * 4 + n).alias("request_id"),
        "conv_id",
        (k + F.when(k % 7 == 3, 2).otherwise(1)).alias("uid"),
        F.when(k % 11 == 0, " 12").when(k % 11 == 1, "x").alias("header"),
        F.when((k + n) % 3 == 0, "text").when((k + n) % 3 == 1, "audio").otherwise("image").alias("kind"),
        F.when(k % 10 == 9, "  ").when(k % 10 == 8, "").when(n == 0, F.col("first_text")).otherwise(F.col("last_text")).alias("text"),
    )
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    entitlements = users.join(last_day(spark, d), "user_id", "left").join(plans(spark).select("segment", "daily"), "segment").select("user_id", F.coalesce("used", F.lit(0)).alias("used"), "daily")
    return conversations, requests, entitlements, rq.message_outcomes(requests, conversations, entitlements, F.lit(UNLIMITED))


SQL["api_post_message_outcomes"] = BATCH_SQL + "SELECT request_id, conv_id, uid, kind, status FROM done"


def api_post_message_outcomes(spark, d):
    return batch(spark, d)[3].select("request_id", "conv_id", "uid", "kind", "status")


SQL["api_post_message_rows"] = BATCH_SQL + """,
served AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY request_id) AS n FROM done WHERE status = 200)
SELECT conv_id, turn, role, text AS content, 'text' AS input_type, CAST(0 AS BIGINT) AS tokens_used FROM conversations
UNION ALL SELECT conv_id, last_turn + 2 * n - 1, 'user', text, kind, 0 FROM served
UNION ALL SELECT conv_id, last_turn + 2 * n, 'assistant', CASE WHEN request_id % 13 = 5 THEN '[error: run expired]' ELSE 'Re ' || request_id END, 'text',
                 CASE WHEN request_id % 13 = 5 OR request_id % 4 = 0 THEN 0 ELSE request_id % 100 END FROM served
"""


def api_post_message_rows(spark, d):
    """The messages behind the batch; the assistant's raw replies are given, cleaned here."""
    _, requests, _, outcomes = batch(spark, d)
    k = F.col("request_id")
    failed = k % 13 == 5
    replies = requests.select(
        "request_id",
        F.when(failed, "expired").otherwise("completed").alias("run"),
        answers.clean_answer(F.concat(F.lit("【1】Re  {"), k.cast("string"), F.lit("}"))).alias("reply"),
        F.when(k % 4 != 0, k % 100).alias("tokens"),
    )
    old = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), F.lit("text").alias("input_type"), F.lit(0).cast("long").alias("tokens_used"))
    return old.unionByName(rq.appended_messages(outcomes, replies))


SQL["api_post_message_conversations"] = BATCH_SQL + """,
f AS (SELECT conv_id, arg_min(text, request_id) AS text FROM done WHERE status = 200 GROUP BY conv_id)
SELECT conv_id, user_id, CASE WHEN text IS NULL THEN title ELSE coalesce(nullif(title, ''), substring(text, 1, 80)) END AS title,
       CASE WHEN text IS NULL THEN updated_at ELSE TIMESTAMP '2024-06-01 12:00:00' END AS updated_at
FROM conv LEFT JOIN f USING (conv_id)
"""
NOW = "2024-06-01 12:00:00"


def api_post_message_conversations(spark, d):
    conversations, _, _, outcomes = batch(spark, d)
    return rq.touched_conversations(conversations.drop("last_turn"), outcomes, F.to_timestamp_ntz(F.lit(NOW)))


SQL["api_post_message_usage"] = BATCH_SQL + """
SELECT user_id, used + coalesce(more, 0) AS used, daily FROM ent LEFT JOIN (SELECT uid, count(*) AS more FROM done WHERE status = 200 GROUP BY uid) ON uid = user_id
"""


def api_post_message_usage(spark, d):
    _, _, entitlements, outcomes = batch(spark, d)
    return rq.bumped_usage(entitlements, outcomes)


SQL["a2_reply_tokens"] = """
SELECT conv_id, turn, CASE WHEN turn % 5 = 1 OR turn % 4 = 3 THEN 0 ELSE length(text) END AS tokens_used FROM conversations WHERE role = 'assistant'
"""


def a2_reply_tokens(spark, d):
    t = F.col("turn")
    replies = table(spark, d, "conversations").filter("role = 'assistant'")
    return replies.select("conv_id", "turn", rq.reply_tokens(F.when(t % 5 == 1, "failed").otherwise("completed"), F.when(t % 4 != 3, F.length("text"))).alias("tokens_used"))


SQL["api_list_conversations"] = BATCH_SQL + """,
page AS (SELECT conv_id, title, updated_at FROM conv WHERE conv_id % 7 = 3 ORDER BY updated_at DESC NULLS FIRST, conv_id DESC LIMIT 5 OFFSET 1),
m AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id)
SELECT conv_id, title, updated_at, substring(text, 1, 120) AS last_message FROM page LEFT JOIN m USING (conv_id) ORDER BY updated_at DESC NULLS FIRST, conv_id DESC
"""


def api_list_conversations(spark, d):
    """One owner's page with last messages; only system turns count, so some have none."""
    mine = batch(spark, d)[0].filter(F.col("conv_id") % 7 == 3).select("conv_id", "title", "updated_at")
    children = table(spark, d, "conversations").filter("role = 'system'")
    page = op.page_with_latest(mine, children, "conv_id", "updated_at", "turn", "text", 5, 1)
    return page.select("conv_id", "title", "updated_at", fn.prefix(F.col("text"), 120).alias("last_message"))


SQL["api_delete_outcomes"] = BATCH_SQL + """
SELECT r.conv_id, r.uid, CASE WHEN c.conv_id IS NULL THEN 404 ELSE 204 END AS status
FROM (SELECT DISTINCT conv_id, uid FROM req) r LEFT JOIN conv c ON c.conv_id = r.conv_id AND c.user_id = r.uid
"""


def delete_batch(spark, d):
    conversations, requests, _, _ = batch(spark, d)
    return conversations, rq.deletions(requests.select("conv_id", "uid").distinct(), conversations)


def api_delete_outcomes(spark, d):
    return delete_batch(spark, d)[1]


SQL["api_delete_messages_left"] = BATCH_SQL + """
SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT r.conv_id FROM req r JOIN conv c ON c.conv_id = r.conv_id AND c.user_id = r.uid)
"""


def api_delete_messages_left(spark, d):
    conversations, outcomes = delete_batch(spark, d)
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return op.cascade_delete(conversations, turns, outcomes.filter(F.col("status") == rq.DELETED), "conv_id", "conv_id")[1]


SQL["api_create_conversations"] = """
SELECT c_custkey AS uid, CASE WHEN c_custkey % 9 = 4 THEN 503 ELSE 201 END AS status,
       CASE WHEN c_custkey % 9 <> 4 THEN (SELECT coalesce(max(conv_id), 0) FROM conversations) + 1 + c_custkey END AS conv_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title
FROM customer
"""


def api_create_conversations(spark, d):
    """A new conversation for every user; for some the assistant gave no thread."""
    k = F.col("c_custkey")
    requests = table(spark, d, "customer").select(
        k.alias("request_id"), k.alias("uid"), F.when(k % 9 != 4, F.concat(F.lit("thread_"), k.cast("string"))).alias("thread_id"), F.when(k % 2 == 0, F.col("c_name")).alias("title")
    )
    return rq.creations(requests, table(spark, d, "conversations")).select("uid", "status", "conv_id", "title")


# Every customer signs in; some are new, some sign wrongly, come late, or say no name.
SQL["api_auth"] = f"""
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS uid FROM customer),
p AS (SELECT * FROM {PLAN_SQL})
SELECT r.k, CASE WHEN r.k % 6 = 5 THEN 401 ELSE 200 END AS status, r.k % 6 <> 5 AND r.k % 4 <> 3 AND r.k % 7 <> 2 AS validated,
       CASE WHEN r.k % 6 <> 5 THEN uid END AS uid,
       CASE WHEN r.k % 6 <> 5 THEN r.k % 10 = 0 END AS is_new_user,
       CASE WHEN r.k % 6 <> 5 THEN CASE WHEN r.k % 3 = 0 THEN 'nick' || uid WHEN r.k % 10 <> 0 THEN c_name END END AS username,
       CASE WHEN r.k % 6 <> 5 THEN CASE WHEN r.k % 10 = 0 THEN 'User ' || uid WHEN r.k % 5 = 0 THEN c_mktsegment ELSE 'N' || uid || ' Ü+1' END END AS display_name,
       CASE WHEN r.k % 6 <> 5 AND r.k % 10 = 0 THEN TIMESTAMP '2024-06-01 12:00:00' END AS accepted_terms_at,
       CASE WHEN r.k % 6 <> 5 THEN CASE WHEN r.k % 10 = 0 THEN 'free' ELSE coalesce(type, 'free') END END AS plan_type,
       CASE WHEN r.k % 6 <> 5 THEN CASE WHEN r.k % 10 = 0 OR daily IS NULL THEN 5 ELSE greatest(0, daily - coalesce(used, 0)) END END AS daily_left
FROM r JOIN customer c ON c.c_custkey = r.k LEFT JOIN p ON segment = c_mktsegment
LEFT JOIN (SELECT user_id, arg_max(used, day) AS used FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY ALL) GROUP BY user_id) ON user_id = r.k
"""
TOKEN = "12:token"
CLOCK = 1_700_000_000


def init_strings(spark, d):
    """k, raw: one signed string for each customer, with markup that needs decoding twice."""
    k = F.col("c_custkey")
    uid = F.when(k % 10 == 0, k + 1_000_000_000).otherwise(k).cast("string")
    name = F.when(k % 6 == 5, F.lit("")).otherwise(F.concat(F.lit(',"first_name":"'), F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("N"), uid)), F.lit('"')))
    last = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(',"last_name":"Ü+1"'))
    nick = F.when(k % 3 == 0, F.concat(F.lit(',"username":"nick'), uid, F.lit('"'))).otherwise(F.lit(""))
    user = F.url_encode(F.concat(F.lit('{"id":'), uid, name, last, nick, F.lit("}")))
    date = F.lit(CLOCK) - F.when(k % 7 == 2, 86_401).otherwise(86_400)
    unsigned = F.concat(F.lit("user="), F.url_encode(user), F.lit("&query_id=Q%2F1&auth_date="), date.cast("string"), F.lit("&start_param="))
    rows = dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("k"), unsigned.alias("raw"))
    signed = init_data.signature(TOKEN)(init_data.base_string(init_data.pairs(F.col("raw"))))
    return rows.select("k", F.concat("raw", F.lit("&hash="), F.when(F.col("k") % 4 == 3, F.lit("0" * 64)).otherwise(signed)).alias("raw"))


def known_users(customers):
    return customers.select(F.col("c_custkey").alias("tg_uid"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("display_name"), F.lit("en").alias("language_code"), F.lit(None).cast("timestamp_ntz").alias("accepted_terms_at"))


def api_auth(spark, d):
    """Sign-in as one plan: parse, check signature and age, create or update the user, tell the plan. Unsigned strings are parsed as well, as the service does."""
    read = init_strings(spark, d).select("k", init_data.pairs(F.col("raw")).alias("v")).withColumn("u", init_data.user(F.col("v")))
    read = read.withColumn("signed", init_data.signature(TOKEN)(init_data.base_string(F.col("v"))))
    fresh = ~fn.is_expired(fn.int_or_null(F.col("v")["auth_date"]), F.lit(CLOCK))
    # Written, as the answers and the next users are both made of it: so strings are parsed and signed once.
    read = cut(read.select("k", "u", F.coalesce((F.col("signed") == F.col("v")["hash"]) & fresh & F.col("u").isNotNull(), F.lit(False)).alias("validated")), "sign-ins")
    full = fn.strip(F.concat("u.first_name", F.lit(" "), F.coalesce("u.last_name", F.lit(""))))
    given = read.select(
        F.col("k").alias("request_id"), F.col("u.id").alias("tg_uid"), F.col("u.username").alias("username"), full.alias("display_name"), fn.first_nonempty(F.col("u.language_code"), F.lit("ru")).alias("language_code")
    )
    customers = table(spark, d, "customer")
    now = F.to_timestamp_ntz(F.lit(NOW))
    known = known_users(customers)
    answers_ = rq.sign_ins(known, given, now).withColumnsRenamed({"request_id": "k", "is_new": "is_new_user"})
    # The next version of subscriptions: new users get the free plan, whose use begins at nothing.
    old = customers.select(F.col("c_custkey").alias("sub_uid"), F.col("c_mktsegment").alias("segment")).join(plans(spark).select("segment", "type", "daily"), "segment")
    old = old.join(last_day(spark, d).withColumnRenamed("user_id", "sub_uid"), "sub_uid", "left").select("sub_uid", "type", "daily", "used")
    new = rq.new_subscriptions(rq.registered(known, given, now), plans(spark)).join(plans(spark), "plan_id").select(F.col("user_id").alias("sub_uid"), "type", "daily", F.lit(0).cast("long").alias("used"))
    out = answers_.withColumnRenamed("tg_uid", "uid").join(old.unionByName(new), F.col("uid") == F.col("sub_uid"), "left").join(read.select("k", "validated"), "k")
    found = F.col("uid").isNotNull()
    return out.select(
        "k",
        F.when(found, rq.OK).otherwise(rq.UNKNOWN).alias("status"),
        "validated",
        "uid",
        "is_new_user",
        "username",
        "display_name",
        "accepted_terms_at",
        F.when(found, F.coalesce("type", F.lit(quota.DEFAULT_PLAN))).alias("plan_type"),
        F.when(found, F.when(F.col("daily").isNull(), F.lit(quota.DEFAULT_DAILY).cast("long")).otherwise(fn.remaining(F.col("daily"), F.col("used")))).alias("daily_left"),
    )


SQL["api_register"] = """
SELECT tg_uid, CASE WHEN tg_uid % 4 = 0 THEN 'nick' || tg_uid WHEN is_new THEN NULL ELSE c_name END AS username,
       CASE WHEN tg_uid % 3 = 0 THEN 'Ann' ELSE 'User ' || tg_uid END AS display_name, is_new FROM (
    SELECT c_custkey AS tg_uid, c_name, false AS is_new FROM customer UNION ALL SELECT c_custkey + 1000000000, c_name, true FROM customer)
"""


def api_register(spark, d):
    """The bot registers every customer and as many new users, each of them twice; the second time counts."""
    k = F.col("tg_uid")
    customers = table(spark, d, "customer")
    known = known_users(customers)
    ids = dealt(known.select(k), "tg_uid").select(F.explode(F.array(k, k + 1_000_000_000)).alias("tg_uid"))
    twice = ids.withColumn("request_id", F.explode(F.array(F.lit(0), F.lit(1))))
    first = F.when(F.col("request_id") == 0, "Old").when(k % 3 == 0, " Ann").otherwise("")
    given = twice.select("request_id", "tg_uid", F.when(k % 4 == 0, F.concat(F.lit("nick"), k.cast("string"))).alias("username"), fn.display_name(first, F.lit(None).cast("string"), k).alias("display_name"), F.lit("ru").alias("language_code"))
    return rq.registered(known, given, F.to_timestamp_ntz(F.lit(NOW))).select("tg_uid", "username", "display_name", "is_new")


# Four sign-ins of every customer and of as many new users, each naming something else, or nothing.
SIGN_IN_SQL = """
WITH ids AS (SELECT c_custkey AS k, c_custkey + CASE WHEN v.j = 0 THEN 0 ELSE 1000000000 END AS uid, v.j, c_name, c_mktsegment FROM customer, (VALUES (0), (1)) AS v(j)),
r AS (
    SELECT (k * 2 + j) * 4 + 3 - n AS request_id, uid, j, c_name, c_mktsegment, CASE WHEN (k + n) % 3 = 0 THEN 'nick' || n WHEN (k + n) % 3 = 1 THEN '' END AS username,
           CASE WHEN (k + 2 * n) % 5 < 2 THEN 'Name ' || n ELSE '' END AS display_name, CASE WHEN n % 2 = 0 THEN 'ru' ELSE 'de' END AS lang
    FROM ids, (VALUES (0), (1), (2), (3)) AS w(n)),
a AS (
    SELECT *, last_value(nullif(username, '') IGNORE NULLS) OVER up AS named, last_value(nullif(display_name, '') IGNORE NULLS) OVER up AS shown,
           first_value(username) OVER up AS first_name, first_value(lang) OVER up AS first_lang, row_number() OVER (PARTITION BY uid ORDER BY request_id) AS n
    FROM r WINDOW up AS (PARTITION BY uid ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (
    SELECT request_id, uid AS tg_uid, coalesce(named, CASE WHEN j = 0 THEN c_name ELSE first_name END) AS username, coalesce(shown, CASE WHEN j = 0 THEN c_mktsegment ELSE 'User ' || uid END) AS display_name,
           CASE WHEN j = 0 THEN 'en' ELSE first_lang END AS language_code, CASE WHEN j = 1 THEN TIMESTAMP '2024-06-01 12:00:00' END AS accepted_terms_at, j = 1 AND n = 1 AS is_new, n, j FROM a)
"""
SQL["api_sign_in_answers"] = SIGN_IN_SQL + "SELECT * EXCLUDE (n, j) FROM o"
SQL["api_sign_in_users"] = SIGN_IN_SQL + "SELECT tg_uid, username, display_name, language_code, accepted_terms_at, j = 1 AS is_new FROM o WHERE n = 4"
SQL["x_stream_users"] = SQL["api_sign_in_users"]
SQL["x_stream_subscriptions"] = SIGN_IN_SQL + "SELECT tg_uid AS user_id, 1 AS plan_id FROM o WHERE n = 4 AND j = 1"


#: Bytes of customer's files to a task: each row becomes eight requests, and files of rows that are much alike are small.
SIGN_IN_SHARE = SHARE // 16


def sign_in_requests(spark, d):
    k, j, n = F.col("c_custkey"), F.col("j"), F.col("n")
    numbers = lambda most: F.explode(F.array(*[F.lit(i) for i in range(most)]))
    rows = dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey", share=SIGN_IN_SHARE).withColumn("j", numbers(2)).withColumn("n", numbers(4))
    return rows.select(
        ((k * 2 + j) * 4 + 3 - n).alias("request_id"),
        (k + F.when(j == 0, 0).otherwise(1_000_000_000)).alias("tg_uid"),
        F.when((k + n) % 3 == 0, F.concat(F.lit("nick"), n.cast("string"))).when((k + n) % 3 == 1, "").alias("username"),
        F.when((k + 2 * n) % 5 < 2, F.concat(F.lit("Name "), n.cast("string"))).otherwise("").alias("display_name"),
        F.when(n % 2 == 0, "ru").otherwise("de").alias("language_code"),
    )


def api_sign_in_answers(spark, d):
    """What each sign-in of a sequence is told: the user as it is right behind it, new only once."""
    customers = table(spark, d, "customer")
    return rq.sign_ins(known_users(customers), sign_in_requests(spark, d), F.to_timestamp_ntz(F.lit(NOW)), parts=dealt_parts(customers, SIGN_IN_SHARE))


def api_sign_in_users(spark, d):
    """The users behind the sequence."""
    return rq.registered(known_users(table(spark, d, "customer")), sign_in_requests(spark, d), F.to_timestamp_ntz(F.lit(NOW)))


def x_stream_users(spark, d):
    """The same users from a stream of the same requests."""
    return streamed_users(spark, d)[0]


def x_stream_subscriptions(spark, d):
    """The free subscriptions that the stream's new users get, one each."""
    return streamed_users(spark, d)[1]


def streamed_users(spark, d):
    folder = scratch(spark, "user-stream")
    # Dealt out by name, not by number: so batches hold each user's requests in any order.
    sign_in_requests(spark, d).repartition(6, "username", "display_name").write.parquet(f"{folder}/in")
    users = streaming.UserStream(spark, f"{folder}/users")
    users.drain(streaming.file_stream(spark, f"{folder}/in", files_per_trigger=2))
    return users.read(known_users(table(spark, d, "customer")), plans(spark), F.to_timestamp_ntz(F.lit(NOW)))


# Two requests of every customer: signed, by header, unsigned, or by nobody; some are known, some name others the second time.
ARRIVE_SQL = """
WITH r AS (
    SELECT c_custkey * 2 + n AS request_id, c_custkey AS k, n, c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 1000000000 ELSE 0 END AS other FROM customer, (VALUES (0), (1)) AS v(n)),
m AS (
    SELECT request_id, CASE WHEN k % 5 = 4 THEN 0 ELSE other END AS uid,
           CASE k % 5 WHEN 0 THEN CASE WHEN n = 0 THEN 'nick' || k ELSE 'user_' || other END WHEN 1 THEN 'user_' || other WHEN 2 THEN 'nick' || k WHEN 3 THEN 'user_' || other ELSE 'guest' END AS username,
           CASE k % 5 WHEN 0 THEN 'Ann ' || n WHEN 1 THEN 'User ' || other WHEN 2 THEN 'Bob' WHEN 3 THEN 'User ' || other ELSE 'Гость' END AS display_name,
           CASE WHEN k % 5 = 0 THEN 'de' ELSE 'ru' END AS language_code FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY request_id) AS n, uid NOT IN (SELECT c_custkey FROM customer) AS unknown FROM m)
"""
SQL["i1_arrivals"] = ARRIVE_SQL + "SELECT request_id, uid, unknown AND n = 1 AS is_new FROM f"
SQL["i1_arrived_users"] = ARRIVE_SQL + """
SELECT c_custkey AS tg_uid, c_name AS username, c_mktsegment AS display_name, 'en' AS language_code FROM customer UNION ALL SELECT uid, username, display_name, language_code FROM f WHERE unknown AND n = 1
"""
SQL["i1_arrived_subscriptions"] = ARRIVE_SQL + "SELECT uid AS user_id, 1 AS plan_id FROM f WHERE unknown AND n = 1"


def arrived(spark, d):
    k, n = F.col("c_custkey"), F.col("n")
    other = k + F.when(k % 2 == 0, 1_000_000_000).otherwise(0)
    user = lambda lang, first, nick: F.struct(other.alias("id"), first.alias("first_name"), F.lit(None).cast("string").alias("last_name"), nick.alias("username"), F.lit(lang).alias("language_code"))
    nick = F.concat(F.lit("nick"), k.cast("string"))
    rows = dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    requests = rows.select(
        (k * 2 + n).alias("request_id"),
        F.when(k % 5 == 0, user("de", F.concat(F.lit("Ann "), n.cast("string")), F.when(n == 0, nick).otherwise(""))).alias("signed"),
        F.when(k % 5 == 1, F.concat(F.lit(" "), other.cast("string"))).when(k % 5 == 3, other.cast("string")).when(k % 5 == 2, "x").alias("header"),
        F.when(k % 5 == 2, user(None, F.lit("Bob"), nick)).when(k % 5 == 3, user("es", F.lit("Never"), nick)).alias("parsed"),
    )
    return ar.arrivals(requests, known_users(table(spark, d, "customer")).drop("accepted_terms_at"), plans(spark))


def i1_arrivals(spark, d):
    """Who sends each request, and whether it makes the user."""
    return arrived(spark, d)["answers"]


def i1_arrived_users(spark, d):
    """The users behind the batch, the guest among them."""
    return arrived(spark, d)["users"]


def i1_arrived_subscriptions(spark, d):
    return arrived(spark, d)["subscriptions"]


for _f in (
    api_send_message, api_me, api_health, api_thread_cleaned, x_stream_daily_usage, api_post_message_outcomes, api_post_message_rows, api_post_message_conversations, api_post_message_usage,
    a2_reply_tokens, api_list_conversations, api_delete_outcomes, api_delete_messages_left, api_create_conversations, api_auth, api_register, api_sign_in_answers, api_sign_in_users, x_stream_users, x_stream_subscriptions,
    i1_arrivals, i1_arrived_users, i1_arrived_subscriptions,
):
    QUERIES[_f.__name__] = _f
