"""Constraints, schema versions and counters that are kept up to date, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..operators.constraints import Rules, violations
from ..operators.versions import Add, Backfill, Drop, History, Rename, Split
from ..sources import table
from ..storage import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


FAULTY_SQL = """
WITH o AS (
    SELECT CASE WHEN o_orderkey % 1001 = 5 THEN o_orderkey - 1 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 997 = 3 THEN NULL WHEN o_orderkey % 97 = 2 THEN o_custkey + 1000000000 ELSE o_custkey END AS user_id,
           CASE WHEN o_orderkey % 501 = 7 THEN 'X' WHEN o_orderkey % 502 <> 7 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 333 = 1 THEN repeat('t', 9) ELSE 'title' END AS title FROM orders),
l AS (SELECT l_orderkey + CASE WHEN l_partkey % 211 = 9 THEN 1000000000 ELSE 0 END AS id, l_linenumber AS line FROM lineitem)
"""


@query("d11_constraints", FAULTY_SQL + """
SELECT 'orders' AS table_name, coalesce(CAST(id AS VARCHAR), 'null') AS key, 'required user_id' AS rule, CAST(1 AS BIGINT) AS n FROM o WHERE user_id IS NULL
UNION ALL SELECT 'orders', CAST(id AS VARCHAR), 'length title', 1 FROM o WHERE length(title) > 8
UNION ALL SELECT 'orders', CAST(id AS VARCHAR), 'allowed status', 1 FROM o WHERE status NOT IN ('O', 'F', 'P')
UNION ALL SELECT 'orders', CAST(id AS VARCHAR), 'unique id', count(*) FROM o GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'orders', CAST(user_id AS VARCHAR), 'reference user_id to users', count(*) FROM o WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id
UNION ALL SELECT 'lines', id || '|' || line, 'unique id, line', count(*) FROM l GROUP BY id, line HAVING count(*) > 1
UNION ALL SELECT 'lines', CAST(id AS VARCHAR), 'reference id to orders', count(*) FROM l WHERE id NOT IN (SELECT id FROM o) GROUP BY id
""")
def d11_constraints(spark, d):
    """Every row and value that breaks a constraint, in tables with faults of each kind."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(
        F.when(k % 1001 == 5, k - 1).otherwise(k).alias("id"),
        F.when(k % 997 == 3, None).when(k % 97 == 2, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey")).alias("user_id"),
        F.when(k % 501 == 7, "X").when(k % 502 != 7, F.col("o_orderstatus")).alias("status"),
        F.when(k % 333 == 1, "t" * 9).otherwise("title").alias("title"),
    )
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.when(F.col("l_partkey") % 211 == 9, 1_000_000_000).otherwise(0)).alias("id"), F.col("l_linenumber").alias("line"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    rules = {
        "orders": Rules(("id",), ("id", "user_id"), {"title": 8}, {"status": ("O", "F", "P")}, (("id",),), ((("user_id",), "users", ("id",)),)),
        "lines": Rules(("id", "line"), ("id", "line"), unique=(("id", "line"),), references=((("id",), "orders", ("id",)),)),
    }
    return violations({"orders": orders, "lines": lines, "users": users}, rules)


#: Four versions of parts: a column added and filled, two renamed, one dropped, and some moved to a table of their own.
PARTS = History(
    (Add("kind", "string"), Backfill("kind", "unknown")),
    (Rename("p_name", "title"), Rename("p_size", "size")),
    (Drop("p_retailprice", "double"), Split("part_brands", "p_partkey", ("p_brand", "p_type"))),
)


def part_versions(spark, d):
    """Rows of part as four releases wrote them: a third or so each of the first three versions, and the rest of the newest."""
    parts, k = table(spark, d, "part"), F.col("p_partkey") % 4
    return {n: PARTS.read(parts, 0, n).filter(k == n) for n in range(4)}


@query("d8_versions_side_by_side", "SELECT p_partkey, p_name AS title, p_size AS size, 'unknown' AS kind FROM part")
def d8_versions(spark, d):
    """Rows of four schema versions read as one."""
    return PARTS.read_all(part_versions(spark, d)).select("p_partkey", "title", "size", "kind")


@query("d9_split_part", "SELECT p_partkey, p_brand, p_type FROM part")
def d9_split(spark, d):
    """What the rows of all versions have in the table that the last step makes: before it, in their own columns; behind it, in its rows."""
    versions = part_versions(spark, d)
    made = PARTS.part(table(spark, d, "part").filter("p_partkey % 4 = 3"), 0, "part_brands")
    return made.unionByName(PARTS.part(versions[0], 0, "part_brands")).unionByName(PARTS.part(versions[1], 1, "part_brands")).unionByName(PARTS.part(versions[2], 2, "part_brands"))


@query("d10_up_and_down", "SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(NULL AS DOUBLE) AS p_retailprice FROM part")
def d10_versions(spark, d):
    """The newest rows read as the first version; what was dropped for good is empty."""
    parts = table(spark, d, "part")
    brands = PARTS.part(parts, 0, "part_brands")
    return PARTS.read(PARTS.read(parts, 0), 3, 0, {"part_brands": brands}).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("a1_usage_rollup", """
SELECT user_id, CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(month) = 0 THEN 'month' ELSE 'lifetime' END AS level, coalesce(day, month) AS since, count(*) AS used, max(ts) AS last_used
FROM (SELECT user_id, ts, CAST(ts AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month FROM events) GROUP BY GROUPING SETS ((user_id, day), (user_id, month), (user_id))
""")
def a1_rollup(spark, d):
    """Use by day, month and for all time, kept up to date over three loads of events of which none is read again."""
    kept = streaming.usage_stream(spark, scratch(spark, "usage-rollup"), every=2)
    events = table(spark, d, "events")
    for n in range(3):
        kept.append(events.filter(F.col("event_id") % 3 == n), n)
    return kept.read()
