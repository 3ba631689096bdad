"""Lookups, paging, joins, latest children and change operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..operators import quota
from ..operators.in_order import in_order
from ..sources import literal, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Plans by market segment; two segments have none, and one key occurs twice with different ids.
PLANS = [(1, "free", "AUTOMOBILE", 5, 50), (2, "pro", "BUILDING", 7, 100), (3, "team", "MACHINERY", 9, 300), (4, "free", "HOUSEHOLD", 5, 50)]
PLAN_SCHEMA = "plan_id int, type string, segment string, daily int, monthly int"
PLAN_VALUES = ", ".join(map(str, PLANS))
PLAN_SQL = f"(VALUES {PLAN_VALUES}) AS p(plan_id, type, segment, daily, monthly)"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def plans(spark):
    return literal(spark, PLANS, PLAN_SCHEMA)


@query("q1_free_plan", f"SELECT plan_id, c_mktsegment AS segment, users, daily FROM (SELECT c_mktsegment, count(*) AS users FROM customer GROUP BY ALL) JOIN {PLAN_SQL} ON segment = c_mktsegment WHERE type = 'free' ORDER BY plan_id LIMIT 1")
def q1(spark, d):
    """The free plan that stands first, of those that any user is on."""
    users = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("users"))
    return op.first_by(plans(spark).join(users, "segment"), F.col("type") == "free", "plan_id").select("plan_id", "segment", "users", "daily")


@query("q2_user_by_key", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77")
def q2(spark, d):
    return op.unique_lookup(table(spark, d, "customer"), "c_custkey", 77).select("c_custkey", "c_name", "c_mktsegment")


@query("q3_guest_user", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 0 UNION ALL SELECT 0, 'guest' WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 0)")
def q3(spark, d):
    known = op.unique_lookup(table(spark, d, "customer"), "c_custkey", 0).select("c_custkey", "c_name")
    return op.insert_missing(known, literal(spark, [(0, "guest")], "c_custkey long, c_name string"), "c_custkey")


@query("q4_active_subscription", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def q4(spark, d):
    active = table(spark, d, "orders").filter(F.col("o_orderstatus") == "O").select("o_custkey", "o_orderkey")
    return op.one_per_key(active, "o_custkey", ["o_orderkey"])


@query("q5_plan_of_subscription", f"SELECT c_custkey, coalesce(type, 'free') AS type, CAST(coalesce(daily, 5) AS INT) AS daily FROM customer LEFT JOIN {PLAN_SQL} ON c_mktsegment = segment")
def q5(spark, d):
    users = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return op.lookup(users, plans(spark).select("segment", "type", "daily"), "segment", {"type": quota.DEFAULT_PLAN, "daily": quota.DEFAULT_DAILY}).drop("segment")


LIST_SQL = """
WITH last AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, last_turn, substring(text, 1, 120) AS last_message FROM last ORDER BY last_turn DESC NULLS FIRST, conv_id DESC LIMIT 20
"""


def page_of_parents(spark, d):
    """The newest conversations by their last turn; no texts are read for it."""
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return op.newest_page(last, "last_turn", "conv_id")


@query("q6_conversation_list", LIST_SQL)
def q6(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("last_turn"), "text")
    # A page has 20 rows, so it may be broadcast, and of all texts only theirs go on.
    last = op.latest_child(turns.join(F.broadcast(page_of_parents(spark, d)), ["conv_id", "last_turn"], "left_semi"), "conv_id", ["last_turn"], ["last_turn", "text"])
    return op.newest_page(last.select("conv_id", "last_turn", fn.prefix(F.col("text"), 120).alias("last_message")), "last_turn", "conv_id")


@query("q6_owner_page", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC LIMIT 5 OFFSET 3")
def q6_page(spark, d):
    mine = table(spark, d, "orders").filter(F.col("o_custkey") == 7).select("o_orderkey", "o_orderdate", "o_totalprice")
    return op.newest_page(mine, "o_orderdate", "o_orderkey", 5, 3)


@query("q6_page_null_dates", "SELECT o_orderkey, nullif(o_orderdate, TIMESTAMP '1995-01-01') AS seen FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN TIMESTAMP '1995-01-01' ELSE o_orderdate END AS o_orderdate FROM orders) ORDER BY seen DESC NULLS FIRST, o_orderkey DESC LIMIT 20 OFFSET 10")
def q6_nulls(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("seen"))
    rows = rows.withColumn("seen", F.nullif("seen", F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00"))))
    return op.newest_page(rows, "seen", "o_orderkey", 20, 10)


@query("q7_owned_row", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 100 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 100)")
def q7(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    owners = orders.filter(F.col("o_orderkey") == 100).select(F.col("o_custkey").alias("owner"))
    return orders.filter(F.col("o_orderkey") == 100).join(owners, F.col("o_custkey") == F.col("owner"), "left_semi")


@query("q7_foreign_row", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 100 AND o_custkey = -1")
def q7_foreign(spark, d):
    return op.owned(table(spark, d, "orders"), "o_orderkey", 100, "o_custkey", -1).select("o_orderkey", "o_custkey")


@query("j2_user_entitlement", f"""
WITH s AS (SELECT o_custkey, min(o_orderkey) AS sub FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT c_custkey, sub, CASE WHEN sub IS NULL THEN 'free' ELSE coalesce(type, 'free') END AS plan_type,
       CASE WHEN sub IS NULL OR daily IS NULL THEN 5 ELSE greatest(0, daily - sub % 11) END AS remaining
FROM customer LEFT JOIN s ON c_custkey = o_custkey LEFT JOIN {PLAN_SQL} ON c_mktsegment = segment
""")
def j2(spark, d):
    users = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    subs = q4(spark, d).withColumnsRenamed({"o_custkey": "c_custkey", "o_orderkey": "sub"})
    joined = users.join(subs, "c_custkey", "left").join(plans(spark).select("segment", "type", "daily"), "segment", "left")
    has = F.col("sub").isNotNull()
    left = F.when(has & F.col("daily").isNotNull(), fn.remaining(F.col("daily"), F.col("sub") % 11)).otherwise(F.lit(quota.DEFAULT_DAILY))
    return joined.select("c_custkey", "sub", F.when(has, F.coalesce("type", F.lit("free"))).otherwise("free").alias("plan_type"), left.cast("bigint").alias("remaining"))


@query("j3_list_keeps_empty", """
WITH m AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id)
SELECT c.conv_id, substring(m.text, 1, 120) AS last_message FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m USING (conv_id)
""")
def j3(spark, d):
    turns = table(spark, d, "conversations")
    last = op.latest_child(turns.filter(F.col("role") == "system"), "conv_id", ["turn"], ["text"])
    return turns.select("conv_id").distinct().join(last, "conv_id", "left").select("conv_id", fn.prefix(F.col("text"), 120).alias("last_message"))


@query("j4_thread", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) ORDER BY turn")
def j4(spark, d):
    turns = table(spark, d, "conversations")
    first = turns.agg(F.min("conv_id").alias("conv_id"))
    return turns.join(F.broadcast(first), "conv_id", "left_semi").select("conv_id", "turn", "role", "text").orderBy("turn")


UNLIMITED = " 7, x,,12, 7 ,1_000, 400"


@query("j5_bypass", "SELECT c_custkey, c_custkey IN (7, 12, 400) AS bypass FROM customer")
def j5(spark, d):
    ids = F.sort_array(fn.id_set(F.lit(UNLIMITED)))
    return table(spark, d, "customer").select("c_custkey", F.array_contains(ids, F.col("c_custkey")).alias("bypass"))


@query("j5_limited_users", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (7, 12, 400)")
def j5_anti(spark, d):
    ids = spark.range(1).select(F.explode(fn.id_set(F.lit(UNLIMITED))).alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(ids, "c_custkey", "left_anti")


@query("a1_usage_lifetime", "SELECT user_id, count(*) AS used, max(ts) AS last_used, greatest(0, 20 - count(*)) AS remaining, count(*) >= 20 AS blocked FROM events GROUP BY user_id")
def a1(spark, d):
    return quota.entitled(quota.usage(table(spark, d, "events")), F.lit(20).cast("bigint")).select("user_id", "used", "last_used", "remaining", "blocked")


@query("a1_usage_per_day", f"""
WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY ALL)
SELECT user_id, day, used, CASE WHEN daily IS NULL THEN 5 ELSE greatest(0, daily - used) END AS remaining, coalesce(used >= daily, false) AS blocked
FROM u JOIN customer ON user_id = c_custkey LEFT JOIN {PLAN_SQL} ON c_mktsegment = segment
""")
def a1_daily(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    used = quota.daily_usage(table(spark, d, "events")).join(users, "user_id").join(plans(spark).select("segment", "daily"), "segment", "left")
    return quota.entitled(used, F.col("daily")).select("user_id", "day", "used", "remaining", "blocked")


@query("a1_usage_monthly", "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS used, greatest(0, 50 - count(*)) AS remaining FROM events GROUP BY ALL")
def a1_monthly(spark, d):
    used = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))
    return used.withColumn("remaining", fn.remaining(F.lit(50).cast("bigint"), F.col("used")))


@query("w1_latest_message", "SELECT conv_id, turn, role, substring(text, 1, 120) AS last_message FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def w1(spark, d):
    rows = op.last_per_parent_window(table(spark, d, "conversations"), "conv_id", "turn")
    return rows.select("conv_id", "turn", "role", fn.prefix(F.col("text"), 120).alias("last_message"))


@query("w2_titles", """
WITH t AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN NULL ELSE 'Chat ' || conv_id END AS title FROM (SELECT DISTINCT conv_id FROM conversations)),
f AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id)
SELECT conv_id, coalesce(nullif(title, ''), substring(text, 1, 80)) AS title FROM t LEFT JOIN f USING (conv_id)
""")
def w2(spark, d):
    turns = table(spark, d, "conversations")
    k = F.col("conv_id") % 3
    titled = turns.select("conv_id").distinct().withColumn("title", F.when(k == 0, "").when(k == 2, F.concat(F.lit("Chat "), F.col("conv_id").cast("string"))))
    first = op.first_child(turns, (F.col("role") == "user") & (F.col("text") != ""), "conv_id", ["turn"], "text", "text")
    return titled.join(first, "conv_id", "left").select("conv_id", fn.first_nonempty(F.col("title"), fn.prefix(F.col("text"), 80)).alias("title"))


@query("l2_ordered_children", "SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def l2(spark, d):
    listed = op.ordered_children(table(spark, d, "conversations"), "conv_id", ["turn"], ["role"])
    return listed.select("conv_id", F.array_join(F.transform("items", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), ",").alias("turns"))


@query("l2_numbered_children", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, substring(text, 1, 40) AS head FROM conversations")
def l2_numbered(spark, d):
    """Every child with its place among its parent's, as rows: a parent may have any number of them."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", fn.prefix(F.col("text"), 40).alias("head"))
    return in_order(turns, "conv_id", "turn", {"position": F.lit(True)}).select("conv_id", "turn", "role", "position", "head")


@query("l7_client_head", "SELECT * FROM (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id DESC LIMIT 20) ORDER BY last_turn DESC, conv_id DESC LIMIT 5")
def l7(spark, d):
    return page_of_parents(spark, d).limit(5)


@query("d1_insert_user", "SELECT c_custkey, c_name, 'free' AS plan FROM customer UNION ALL SELECT 900000001, 'user_900000001', 'free'")
def d1(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name")
    new = literal(spark, [(900000001, None)], "c_custkey long, c_name string")
    named = new.withColumn("c_name", F.coalesce("c_name", F.concat(F.lit("user_"), F.col("c_custkey").cast("string"))))
    return op.insert_missing(old, named, "c_custkey").withColumn("plan", F.lit("free"))


NEW_USERS = [(1, "new_one", ""), (2, "", "SEGMENT"), (3, None, None), (900000002, "added", "NEW")]


@query("d2_upsert_users", """
WITH n AS (SELECT * FROM (VALUES (1, 'new_one', ''), (2, '', 'SEGMENT'), (3, NULL, NULL), (900000002, 'added', 'NEW')) AS n(k, name, segment))
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN nullif(name, '') ELSE coalesce(nullif(name, ''), c_name) END AS c_name,
       CASE WHEN c_custkey IS NULL THEN nullif(segment, '') ELSE coalesce(nullif(segment, ''), c_mktsegment) END AS c_mktsegment,
       c_nationkey, c_custkey IS NULL AS is_new
FROM customer FULL JOIN n ON c_custkey = k
""")
def d2(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    new = literal(spark, NEW_USERS, "c_custkey long, c_name string, c_mktsegment string")
    return op.upsert(old, new, "c_custkey", ["c_name", "c_mktsegment"])


@query("d3_insert_only", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT 900000002, 'added'")
def d3(spark, d):
    new = literal(spark, NEW_USERS, "c_custkey long, c_name string, x string").drop("x")
    return op.insert_missing(table(spark, d, "customer").select("c_custkey", "c_name"), new, "c_custkey")


@query("d4_bump_usage", "SELECT user_id, count(*) + 1 AS used_today, count(*) + 1 AS used_month, TIMESTAMP '2024-06-01 12:00:00' AS last_query_date FROM events GROUP BY user_id")
def d4(spark, d):
    used = quota.usage(table(spark, d, "events"))
    return used.select("user_id", (F.col("used") + 1).alias("used_today"), (F.col("used") + 1).alias("used_month"), F.to_timestamp_ntz(F.lit("2024-06-01 12:00:00")).alias("last_query_date"))


@query("d5_touch_parents", "SELECT c_custkey, max(o_orderdate) AS updated_at FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def d5(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("updated_at"))
    return table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")


@query("d6_dangling_turns", "SELECT conv_id, turn FROM (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id) WHERE role = 'user'")
def d6(spark, d):
    return op.latest_child(table(spark, d, "conversations"), "conv_id", ["turn"], ["turn", "role"]).filter("role = 'user'").select("conv_id", "turn")


@query("d6_append_pair", "SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user' FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, max(turn) + 2, 'assistant' FROM conversations GROUP BY conv_id")
def d6_append(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    pair = F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit("user").alias("role")), F.struct(F.lit(2).alias("k"), F.lit("assistant").alias("role"))))
    return turns.unionByName(last.select("conv_id", "last", pair.alias("p")).select("conv_id", (F.col("last") + F.col("p.k")).alias("turn"), "p.role"))


@query("d7_cascade_children", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_custkey = 7)")
def d7(spark, d):
    orders = table(spark, d, "orders")
    children = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return op.cascade_delete(orders, children, orders.filter("o_custkey = 7"), "o_orderkey", "l_orderkey")[1].select("l_orderkey", "l_linenumber", "l_partkey")


@query("d7_cascade_parents", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <> 7")
def d7_parents(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return op.cascade_delete(orders, table(spark, d, "lineitem"), orders.filter("o_custkey = 7"), "o_orderkey", "l_orderkey")[0]


@query("d8_backfill", "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#1'), 'unknown') AS problem_type FROM part")
def d8(spark, d):
    return op.backfill(table(spark, d, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#1")).alias("problem_type")), "problem_type", "unknown")


@query("d9_add_drop_columns", "SELECT p_partkey, p_name, false AS has_parts, CAST(NULL AS VARCHAR) AS problem_text_clean FROM part")
def d9(spark, d):
    return table(spark, d, "part").withColumn("has_parts", F.lit(False)).withColumn("problem_text_clean", F.lit(None).cast("string")).drop("p_brand", "p_type", "p_size", "p_retailprice")


@query("d10_rename_columns", "SELECT page_id, html AS content, url FROM pages")
def d10(spark, d):
    return table(spark, d, "pages").withColumnRenamed("html", "content")


@query("d11_broken_unique_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d11(spark, d):
    return op.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("d13_idempotent_seed", """
SELECT c_custkey, c_name, c_mktsegment FROM customer UNION ALL
SELECT k, name, segment FROM (VALUES (0, 'guest', 'free'), (1, 'again', 'free'), (900000003, 'seeded', 'free')) AS s(k, name, segment) WHERE k NOT IN (SELECT c_custkey FROM customer)
""")
def d13(spark, d):
    """Seeding twice is seeding once, and rows that are there stay as they are."""
    users = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    seed = literal(spark, [(0, "guest", "free"), (1, "again", "free"), (900000003, "seeded", "free")], "c_custkey long, c_name string, c_mktsegment string")
    return op.insert_missing(op.insert_missing(users, seed, "c_custkey"), seed, "c_custkey")


@query("c2_delete_by_id", "SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE conv_id <> 3 GROUP BY conv_id")
def c2(spark, d):
    return table(spark, d, "conversations").filter("conv_id <> 3").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))


@query("c1_prepend", "SELECT conv_id, last_turn FROM (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id UNION ALL SELECT 900001, NULL) ORDER BY last_turn DESC NULLS FIRST, conv_id DESC LIMIT 20")
def c1(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return op.newest_page(rows.unionByName(literal(spark, [(900001, None)], "conv_id long, last_turn long")), "last_turn", "conv_id")
