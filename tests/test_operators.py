"""Relational operators on small tables with nulls, ties and orphans, and the plans they get."""

import pytest
from pyspark.sql import functions as F

from chatloom import operators as op
from chatloom.operators import quota
from chatloom.sources import SCHEMAS, json_body, literal, table, valid_text

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def turns(spark):
    return literal(spark, [(1, 0, "a"), (1, 2, None), (1, 1, "b"), (2, 0, "c")], "conv int, turn int, text string")


def test_latest_child_keeps_a_null_text(turns):
    assert rows(op.latest_child(turns, "conv", ["turn"], ["turn", "text"])) == [(1, 2, None), (2, 0, "c")]


def test_latest_child_and_window_agree(turns):
    wide = op.last_per_parent_window(turns, "conv", "turn").select("conv", "turn", "text")
    assert rows(wide) == rows(op.latest_child(turns, "conv", ["turn"], ["turn", "text"]))


def test_first_child(turns):
    assert rows(op.first_child(turns, F.col("turn") > 0, "conv", ["turn"], "text", "t")) == [(1, "b")]


def test_ordered_children(turns):
    got = {r.conv: [(x.turn, x.text) for x in r["items"]] for r in op.ordered_children(turns, "conv", ["turn"], ["text"]).collect()}
    assert got == {1: [(0, "a"), (1, "b"), (2, None)], 2: [(0, "c")]}


def test_page_puts_missing_dates_first_and_breaks_ties(spark):
    df = literal(spark, [(1, 5), (2, None), (3, 5), (4, 9)], "id int, at int")
    assert [r.id for r in op.newest_page(df, "at", "id", 3).collect()] == [2, 4, 3]
    assert [r.id for r in op.newest_page(df, "at", "id", 3, 3).collect()] == [1]
    assert op.newest_page(df, "at", "id", 3, 9).collect() == []


def test_ownership(spark):
    df = literal(spark, [(1, 7), (2, 8)], "id int, owner int")
    assert rows(op.owned(df, "id", 1, "owner", 7)) == [(1, 7)]
    assert rows(op.owned(df, "id", 1, "owner", 8)) == []


def test_lookup_defaults(spark):
    subs = literal(spark, [(1, 10), (2, 99), (3, None)], "id int, plan_id int")
    plans = literal(spark, [(10, "pro", None)], "plan_id int, type string, daily int")
    got = op.lookup(subs, plans, "plan_id", {"type": "free", "daily": 5}).select("id", "type", "daily")
    assert rows(got) == [(1, "pro", 5), (2, "free", 5), (3, "free", 5)]


def test_upsert(spark):
    old = literal(spark, [(1, "a", "x"), (2, "b", "y")], "id int, name string, kept string")
    new = literal(spark, [(2, ""), (3, "c"), (1, "z")], "id int, name string")
    got = op.upsert(old, new, "id", ["name"], {"kept": F.lit("new")})
    assert rows(got) == [(1, "z", "x", False), (2, "b", "y", False), (3, "c", "new", True)]


def test_insert_missing_leaves_known_rows(spark):
    old = literal(spark, [(1, "a")], "id int, name string")
    assert rows(op.insert_missing(old, literal(spark, [(1, "z"), (2, "b")], "id int, name string"), "id")) == [(1, "a"), (2, "b")]


def test_cascade(spark):
    parents = literal(spark, [(1,), (2,)], "id int")
    children = literal(spark, [(1, "a"), (2, "b"), (None, "c")], "parent int, t string")
    left, kept = op.cascade_delete(parents, children, literal(spark, [(1,), (1,)], "id int"), "id", "parent")
    assert rows(left) == [(2,)]
    assert rows(kept) == [(2, "b"), (None, "c")]


def test_backfill_and_duplicate_keys(spark):
    df = literal(spark, [(1, None), (1, "x"), (2, "y")], "id int, kind string")
    assert rows(op.backfill(df, "kind", "unknown")) == [(1, "unknown"), (1, "x"), (2, "y")]
    assert rows(op.duplicate_keys(df, "id")) == [(1, 2)]


def test_entitlement(spark):
    used = literal(spark, [(1, 7, 5), (2, 5, 5), (3, 1, 5), (4, 50, None)], "u int, used long, daily long")
    got = quota.entitled(used, F.col("daily")).select("u", "remaining", "blocked")
    assert rows(got) == [(1, 0, True), (2, 0, True), (3, 4, False), (4, 5, False)]


def test_bodies(spark):
    df = literal(spark, [('{"text": "a"}',), ("nonsense",), (None,)], "body string")
    assert [r[0] for r in df.select(json_body("body", "text STRING")["text"]).collect()] == ["a", None, None]
    texts = literal(spark, [("",), ("a",), ("a" * 4000,), ("a" * 4001,), (None,)], "t string")
    assert [r[0] for r in texts.select(valid_text(F.col("t"))).collect()] == [False, True, True, False, False]


def test_empty_tables(spark):
    for name, schema in SCHEMAS.items():
        empty = literal(spark, [], schema)
        assert op.duplicate_keys(empty, "id").count() == 0, name
    messages = literal(spark, [], SCHEMAS["messages"])
    assert op.latest_child(messages, "conversation_id", ["created_at", "id"], ["content"]).count() == 0


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_lookup_reaches_the_scan(spark):
    text = plan(op.unique_lookup(table(spark, DATA, "customer"), "c_custkey", 7).select("c_name"))
    assert "EqualTo(c_custkey,7)" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in text


def test_page_is_one_top_k(spark):
    text = plan(op.newest_page(table(spark, DATA, "orders"), "o_orderdate", "o_orderkey", 5, 3))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_latest_child_aggregates_before_the_shuffle(spark):
    text = plan(op.latest_child(table(spark, DATA, "conversations"), "conv_id", ["turn"], ["role"]))
    assert "partial_max_by" in text and text.count("Exchange") <= 2 and "Window" not in text


def test_cascade_needs_no_cartesian_product(spark):
    orders, lines = table(spark, DATA, "orders"), table(spark, DATA, "lineitem")
    _, kept = op.cascade_delete(orders, lines, orders.filter("o_orderstatus = 'F'"), "o_orderkey", "l_orderkey")
    assert "CartesianProduct" not in plan(kept) and "NestedLoop" not in plan(kept)


def test_planned_sizes_know_files_and_rows_and_run_nothing(spark, tmp_path):
    from chatloom.sources import planned_bytes, planned_parts, spread

    rows = spark.range(1000)
    rows.write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    ran = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = ran()
    assert planned_bytes(files) == size and planned_bytes(files.groupBy("id").count().join(files, "id")) == 2 * size
    given = spark.createDataFrame([(1, "a")], "a int, b string")
    assert planned_bytes(given) < 1 << 60 and planned_parts(given.repartition(50)) < 100
    assert spread(files.groupBy("id").count()) is not None and ran() == before
