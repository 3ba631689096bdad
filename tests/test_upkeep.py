"""Constraints with faults of each kind, and schema versions up and down."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatloom.operators.constraints import SERVICE, Rules, flagged, violations
from chatloom.operators.versions import Add, Backfill, Drop, History, Rename, Split
from chatloom.sources import SCHEMAS


def test_faults_equal_a_loop(spark):
    r = random.Random(2)
    parents = [(r.choice([1, 2, 3, 4, None]), r.choice(["a", "b"])) for _ in range(12)]
    rows = [(i if r.random() < 0.9 else r.choice([0, None]), r.choice([1, 2, 9, None]), r.choice(["a", "b", None]), r.choice(["ok", "", None, "ö" * 5, "x" * 6]), r.choice(["u", "v", "w", None])) for i in range(200)]
    rules = {
        "t": Rules(("id",), ("id", "name"), {"name": 5}, {"kind": ("u", "v")}, (("id",), ("p", "q")), ((("p",), "parent", ("k",)), (("p", "q"), "parent", ("k", "l")))),
        "parent": Rules(("k", "l"), unique=(("k", "l"),)),
    }
    tables = {"t": spark.createDataFrame(rows, "id long, p long, q string, name string, kind string").repartition(3), "parent": spark.createDataFrame(parents, "k long, l string")}
    want = Counter()
    text = lambda *v: "|".join("null" if x is None else str(x) for x in v)
    for i, p, q, name, kind in rows:
        for rule, broken in (("required id", i is None), ("required name", name is None), ("length name", name is not None and len(name) > 5), ("allowed kind", kind is not None and kind not in "uv")):
            if broken:
                want["t", text(i), rule, 1] += 1
    for table, rule, values in (("t", "unique id", [(x[0],) for x in rows]), ("t", "unique p, q", [x[1:3] for x in rows]), ("parent", "unique k, l", parents)):
        for v, n in Counter(x for x in values if None not in x).items():
            if n > 1:
                want[table, text(*v), rule, n] += 1
    for v, n in Counter((x[1],) for x in rows if x[1] is not None).items():
        if v[0] not in {k for k, _ in parents}:
            want["t", text(*v), "reference p to parent", n] += 1
    for v, n in Counter(x[1:3] for x in rows if None not in x[1:3]).items():
        if v not in parents:
            want["t", text(*v), "reference p, q to parent", n] += 1
    assert Counter(tuple(x) for x in violations(tables, rules).collect()) == want
    # What rows break alone is found without a shuffle.
    assert "Exchange" not in flagged(spark.range(5).selectExpr("id", "1L p", "'q' q", "'n' name", "'u' kind"), rules["t"])._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        violations({"t": tables["t"]}, {"t": Rules(("id",), lengths={f"c{i}": 1 for i in range(64)})})


def test_keys_are_counted_in_as_many_tasks_as_rows_ask_for(spark, tmp_path):
    """One row group is read by one task; what counts its keys has a share of them, and a frequent value is dealt out with its rows."""
    spark.range(1000).select("id", F.lit(7).cast("long").alias("p")).coalesce(1).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    found = violations({"t": t, "u": t}, {"t": Rules(("id",), unique=(("id",),), references=((("p",), "u", ("id",)),))})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [id") == 2 and found.count() == 0
    assert violations({"t": t, "u": t.filter("id > 7")}, {"t": Rules(("id",), references=((("p",), "u", ("id",)),))}).collect()[0].n == 1000


def test_the_services_rules_fit_its_schemas(spark):
    empty = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    assert violations(empty, SERVICE).count() == 0
    for n, df in empty.items():
        # What the schema says can't be null is required.
        assert {f.name for f in df.schema if not f.nullable} == set(SERVICE[n].required)
    full = {n: spark.createDataFrame([], s.replace(" NOT NULL", "")) for n, s in SCHEMAS.items()}
    full["messages"] = full["messages"].unionByName(spark.range(1).select(F.lit(5).alias("id"), F.lit(7).alias("conversation_id"), F.lit("robot").alias("role")), allowMissingColumns=True)
    found = {(x.table_name, x.key, x.rule) for x in violations(full, SERVICE).collect()}
    assert found == {("messages", "5", "required content"), ("messages", "5", "allowed role"), ("messages", "7", "reference conversation_id to conversations")}


STEPS = History(
    (Add("kind", "string"), Backfill("kind", "unknown")),
    (Rename("name", "title"), Add("has_parts", "boolean", False)),
    (Rename("title", "name"), Rename("name", "heading")),
    (Split("texts", "id", ("body", "kind")),),
    (Drop("heading", "string"), Add("heading", "int", 3)),
)


def test_versions_side_by_side_up_and_down(spark):
    first = spark.createDataFrame([(1, "a", "t1"), (2, None, None)], "id long, name string, body string")
    up = {n: STEPS.read(first, 0, n) for n in range(6)}
    assert [sorted(df.columns) for df in up.values()] == [["body", "id", "name"], ["body", "id", "kind", "name"], ["body", "has_parts", "id", "kind", "title"], ["body", "has_parts", "heading", "id", "kind"], ["has_parts", "heading", "id"], ["has_parts", "heading", "id"]]
    assert {tuple(sorted(x.asDict().items())) for x in up[3].collect()} == {(("body", "t1"), ("has_parts", False), ("heading", "a"), ("id", 1), ("kind", "unknown")), (("body", None), ("has_parts", False), ("heading", None), ("id", 2), ("kind", "unknown"))}
    every = STEPS.read_all({n: df for n, df in up.items()})
    assert sorted((x.id, x.has_parts, x.heading) for x in every.collect()) == sorted([(1, False, 3), (2, False, 3)] * 6)
    # Up and down again is the identity, where nothing was dropped or filled.
    texts = STEPS.part(first, 0, "texts")
    assert texts.columns == ["id", "body", "kind"]
    for n in range(1, 5):
        back = STEPS.read(up[n], n, 0, {"texts": texts})
        assert sorted(map(tuple, back.select("id", "name", "body").collect())) == sorted(map(tuple, first.collect()))
    assert [x.name for x in STEPS.read(up[5], 5, 0, {"texts": texts}).collect()] == [None, None]
    for bad in (lambda: STEPS.read(up[4], 4, 0), lambda: STEPS.part(up[5], 5, "texts")):
        with pytest.raises(LookupError):
            bad()


def test_a_dropped_column_is_not_read(spark, tmp_path):
    spark.range(3).selectExpr("id", "'x' heavy", "'n' name").write.parquet(f"{tmp_path}/t")
    log = History((Drop("heavy", "string"),), (Rename("name", "title"),), (Add("n", "int", 1),))
    plan = log.read(spark.read.parquet(f"{tmp_path}/t"), 0)._jdf.queryExecution().executedPlan().toString()
    assert "heavy" not in plan.split("ReadSchema")[1] and plan.count("Project") == 1
