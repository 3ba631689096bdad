"""Search, deep pages and keyed layouts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import operators as op
from ..operators import layout, paging
from ..operators.token_index import TokenIndex
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


SEARCHES = {"any": ("est", "und"), "all": ("the", "And", "that"), "phrase": ("of", "the"), "none": ("the", "qqqq")}


@query("d12_token_index", r"""
WITH t AS (
    SELECT doc_id, list_filter(string_split_regex(lower(coalesce(CASE WHEN doc_id % 7 = 0 THEN source || ' and the that of THE' END, text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents)
SELECT 'any' AS search, doc_id FROM t WHERE list_has_any(words, ['est', 'und'])
UNION ALL SELECT 'all', doc_id FROM t WHERE list_has_all(words, ['the', 'and', 'that'])
UNION ALL SELECT 'phrase', doc_id FROM t WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' of the ')
""")
def d12(spark, d):
    """Documents by their terms, from an index that got its second half without a look at the first."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("source", F.lit(" and the that of THE"))).alias("clean"), "text")
    index = TokenIndex(spark, scratch(spark, "token-index"))
    for half in range(2):
        index.add(docs.filter(F.col("doc_id") % 2 == half), half, "doc_id", "clean", "text")
    kinds = {"any": index.any_of, "all": index.all_of, "phrase": index.phrase, "none": index.all_of}
    found = [kinds[k](*words).select(F.lit(k).alias("search"), F.col("id").alias("doc_id")) for k, words in SEARCHES.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("d12_term_counts", r"""
WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM t GROUP BY term
""")
def d12_counts(spark, d):
    """How many documents each term stands in, and how often, from the postings."""
    index = TokenIndex(spark, scratch(spark, "token-index"))
    index.add(table(spark, d, "documents"), 0, "doc_id", "text")
    n = F.aggregate("places", F.lit(0).cast("bigint"), lambda a, p: a + F.size(p))
    return index.postings().groupBy("term").agg(F.sum("n").alias("docs"), F.sum(n).alias("n"))


@query("l1_deep_page", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM (
    SELECT *, row_number() OVER (ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS n, count(*) OVER () AS total
    FROM (SELECT o_orderkey, nullif(o_orderdate, (SELECT min(o_orderdate) FROM orders)) AS o_orderdate, o_totalprice FROM orders))
WHERE n > total // 2 AND n <= total // 2 + 50
""")
def l1_deep(spark, d):
    """The fifty orders behind the first half of all: the place is counted, and only the page is sorted."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    first = orders.agg(F.min("o_orderdate")).scalar()
    orders = orders.withColumn("o_orderdate", F.nullif("o_orderdate", first))
    # A small range to sort, as it would be of a large table.
    return paging.page_at(orders, "o_orderdate", "o_orderkey", 50, orders.count() // 2, most=200)


@query("l1_seek_pages", """
SELECT o_orderkey, page FROM (
    SELECT o_orderkey, 1 + (row_number() OVER (ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) - 1) // 20 AS page FROM orders WHERE o_custkey < 200) WHERE page <= 3
""")
def l1_seek(spark, d):
    """Three pages, each asked for by the last row of the one before."""
    orders = table(spark, d, "orders").filter("o_custkey < 200").select("o_orderkey", "o_orderdate")
    last, out = None, None
    for n in range(1, 4):
        page = paging.page_after(orders, "o_orderdate", "o_orderkey", 20, last)
        end = page.orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey").first()
        last = paging.Place(end.o_orderdate, end.o_orderkey) if end else last
        page = page.select("o_orderkey", F.lit(n).cast("bigint").alias("page"))
        out = page if out is None else out.unionByName(page)
    return out


@query("q6_keyed_owner", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_custkey IN (7, 100) OR o_orderkey = 33")
def q6_keyed(spark, d):
    """An owner's rows and a row by its key, from a layout in which few files can hold them."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    kept = layout.keyed(orders, scratch(spark, "orders-by-owner"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    mine = kept.filter(F.col("o_custkey").isin(7, 100))
    return mine.unionByName(kept.filter((F.col("o_orderkey") == 33) & ~F.col("o_custkey").isin(7, 100)))


@query("j3_bucketed_children", """
SELECT o_orderkey, o_custkey, count(l_orderkey) AS items, max(l_linenumber) AS last_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
""")
def j3_bucketed(spark, d):
    """Each parent with what its children come to, parents and children in the same buckets."""
    parents, children = bucketed(spark, d)
    last = children.groupBy("o_orderkey").agg(F.count("*").alias("items"), F.max("l_linenumber").alias("last_line"))
    return parents.join(last, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.coalesce("items", F.lit(0)).alias("items"), "last_line")


@query("d7_bucketed_cascade", "SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0)")
def d7_bucketed(spark, d):
    """The children that a cascade leaves, without moving a child."""
    parents, children = bucketed(spark, d)
    return op.cascade_delete(parents, children, parents.filter("o_custkey % 5 = 0"), "o_orderkey", "o_orderkey")[1].select("o_orderkey", "l_linenumber")


def bucketed(spark, d):
    keep = layout.Bucketed(spark, 16)
    parents = keep.put(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return parents, keep.put(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey", "l_linenumber")
