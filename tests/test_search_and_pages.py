"""The token index against scans, pages against full sorts, and layouts by what is read and moved."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from chatloom import operators as op
from chatloom.operators import layout, paging
from chatloom.operators.token_index import TokenIndex, bucket_of


def spelled(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def holds(words, phrase):
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words)))


def corpus(seed, n):
    r = random.Random(seed)
    some = ["the", "The", "of", "or", "Ärger", "x1", "漢字", "rare"]
    rows = []
    for i in r.sample(range(-2000, 20_000), n):
        t = r.choice([" ", "-"]).join(r.choices(some, [9, 3, 5, 3, 2, 2, 1, 0.1], k=r.randrange(40)))
        rows.append((i, r.choice([None, None, t]), r.choice([None, "", t + " the end", "…—"])))
    return rows


@pytest.mark.parametrize("chunk, buckets", [(4096, 64), (7, 3)])
def test_searches_equal_scans_over_segments(spark, tmp_path, chunk, buckets):
    rows = corpus(chunk, 300)
    index = TokenIndex(spark, f"file://{tmp_path}/index", buckets, chunk)
    docs = lambda part: spark.createDataFrame(part, "id long, clean string, raw string").repartition(3)
    index.add(docs([*rows[:150], (None, "the of", None)]), 0, "id", "clean", "raw")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    index.add(docs(rows[150:280]), 1, "id", "clean", "raw")
    # A segment that comes again takes the place of what it wrote before, and the others' files stay as they are.
    index.add(docs(rows[150:]), 1, "id", "clean", "raw")
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    texts = {i: spelled(c if c is not None else t) for i, c, t in rows}
    ids = lambda df: sorted(x.id for x in df.collect())
    for words in (["the"], ["THE", "of"], ["ärger", "or", "the"], ["rare", "漢字"], ["never"], ["the", "never"], ["the", "the"]):
        low = [w.lower() for w in words]
        assert ids(index.any_of(*words)) == sorted(i for i, t in texts.items() if set(low) & set(t))
        assert ids(index.all_of(*words)) == sorted(i for i, t in texts.items() if set(low) <= set(t))
        assert ids(index.phrase(*words)) == sorted(i for i, t in texts.items() if holds(t, low))
    rows_of = index.postings().collect()
    assert all(x.n <= chunk and x.n == len(x.offsets) == len(x.places) for x in rows_of)
    assert len({(x.term, x.chunk, x.segment) for x in rows_of}) == len(rows_of)
    assert sum(len(p) for x in rows_of for p in x.places) == sum(map(len, texts.values()))
    with pytest.raises(ValueError):
        index.any_of()


def test_postings_are_made_where_their_texts_lie(spark, tmp_path):
    """Texts move once, by ranges of ids, and no term moves before its postings are whole."""
    from chatloom.operators import token_index

    spark.createDataFrame([(i, f"w{i % 9} the") for i in range(500)], "id long, text string").write.parquet(f"{tmp_path}/docs")
    index = TokenIndex(spark, f"file://{tmp_path}/index", 4, 16)
    made = index.made(spark.read.parquet(f"{tmp_path}/docs"), "id", "text")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning(chunk" in plan
    assert sum(x.n for x in made.collect()) == 1000
    # Ranges of ids share a file of a bucket.
    index.add(spark.read.parquet(f"{tmp_path}/docs"), 0, "id", "text")
    assert len(list((tmp_path / "index").rglob("*.parquet"))) <= 4 * (-(-500 // 16 // token_index.RANGES) + 1)


def test_a_segment_of_every_other_document_moves_its_texts_once(spark, tmp_path):
    """A document of an id that comes twice in a segment, far apart, has the places of both; ids may be negative or missing."""
    rows = [(i, None if i % 3 else f"w{i} the", "raw the") for i in range(-40, 40)] + [(None, "the", None), (-40, "the w", None)]
    spark.createDataFrame(rows, "id long, clean string, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").filter("id % 2 = 0")
    index = TokenIndex(spark, f"file://{tmp_path}/index", 4, 16)
    made = index.made(docs, "id", "clean", "text")
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    index.add(docs, 0, "id", "clean", "text")
    found = sorted((x.id, x.n) for x in index.found("the").selectExpr("id", "size(places) n").collect())
    assert found == [(i, 2 if i == -40 else 1) for i in range(-40, 40, 2)]


def test_places_move_in_one_list_and_lie_in_a_list_for_each_document(spark, tmp_path):
    """What is dealt over buckets holds no list of lists; ids may be far apart, negative, or come twice, and documents long."""
    from pyspark.sql.types import ArrayType

    rows = [(-9, "b a a"), (-8, "a"), (-8, "b b a"), (7, "x " * 70_000 + "a x"), (2**40, "a")]
    index = TokenIndex(spark, f"file://{tmp_path}/index", 4, 8)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    lists = [f.dataType for f in index.made(docs, "id", "text").schema if isinstance(f.dataType, ArrayType)]
    assert lists and not any(isinstance(t.elementType, ArrayType) for t in lists)
    index.add(docs, 0, "id", "text")
    got = {(x.term, x.id): x.places for x in index.found().collect()}
    assert got.pop(("x", 7)) == [*range(70_000), 70_001]
    assert got == {("a", -9): [1, 2], ("b", -9): [0], ("a", -8): [0, 2], ("b", -8): [0, 1], ("a", 7): [70_000], ("a", 2**40): [0]}


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = TokenIndex(spark, f"file://{tmp_path}/index", 16)
    assert index.any_of("the").count() == 0
    index.add(spark.createDataFrame([(i, f"w{i} the") for i in range(200)], "id long, text string"), 0, "id", "text")
    found = index.postings("the", "w3")
    want = {f"bucket={x[0]}" for x in spark.createDataFrame([("the",), ("w3",)], "t string").select(bucket_of(F.col("t"), 16)).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "bucket" in scan[scan.index("PartitionFilters") : scan.index("PushedFilters")] and "the,w3])" in scan[scan.index("PushedFilters") :]
    assert {x.f for x in found.select(F.regexp_extract(F.input_file_name(), "bucket=[0-9]+", 0).alias("f")).collect()} <= want
    # A write that was cut off isn't read.
    (tmp_path / "index/segment=0/_SUCCESS").unlink()
    assert index.postings().count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pages_of_any_depth_equal_a_full_sort(spark, seed):
    r = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    when = lambda: r.choice([None, day, day, day + datetime.timedelta(microseconds=r.randrange(10**12)), day - datetime.timedelta(days=r.randrange(9000))])
    rows = [(when(), i) for i in r.sample(range(-10**6, 10**12), 400)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, id long").repartition(4)
    order = sorted(rows, key=lambda x: (x[0] is not None, -(x[0] - day).total_seconds() if x[0] else 0, -x[1]))
    for offset in (0, 3, 60, 150, 250, 399, 400, 1000):
        got = [tuple(x) for x in paging.page_at(df, "at", "id", 25, offset, most=10, ranges=r.choice([2, 5, 1024])).collect()]
        assert got == order[offset : offset + 25]
    last, seen = None, []
    while page := [tuple(x) for x in paging.page_after(df, "at", "id", 90, last).collect()]:
        seen += page
        last = paging.Place(*page[-1])
    assert seen == order
    dates = df.select(F.col("at").cast("date").alias("at"), "id")
    assert [x.id for x in paging.page_at(dates, "at", "id", 10, 200, most=20).collect()] == [i for _, i in sorted(((a.date() if a else None, i) for a, i in rows), key=lambda x: (x[0] is not None, -(x[0] - day.date()).days if x[0] else 0, -x[1]))[200:210]]
    with pytest.raises(TypeError):
        paging.page_at(df.select(F.col("id").cast("string").alias("at"), "id"), "at", "id", 1, 200, most=10)


def test_a_deep_page_sorts_no_more_than_the_page(spark):
    orders = spark.range(50_000).select((F.col("id") % 1000).alias("at"), "id")
    page = paging.page_at(orders, "at", "id", 20, 25_000, most=1000)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20," in plan and "offset" not in plan.lower()
    assert "TakeOrderedAndProject(limit=25020, offset=25000" in op.newest_page(orders, "at", "id", 20, 25_000)._jdf.queryExecution().executedPlan().toString()


def test_a_keyed_layout_is_read_in_few_files(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") * 7919 % 500).alias("owner"), (F.col("id") * 104_729 % 20_011).alias("key"), F.col("id").alias("at"))
    kept = layout.keyed(df, f"file://{tmp_path}/t", "owner", ["at"], ["key"], files=16)
    assert sorted(kept.filter("owner = 77").collect()) == sorted(df.filter("owner = 77").collect())
    import pyarrow.parquet as pq

    ranges = [pq.ParquetFile(p).metadata.row_group(0).column(0).statistics for p in (tmp_path / "t").glob("*.parquet")]
    assert len(ranges) == 16 and sum(s.min <= 77 <= s.max for s in ranges) <= 2
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in (tmp_path / "t").glob("*.parquet"):
        file = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(p)), conf))
        columns = file.getFooter().getBlocks().get(0).getColumns()
        assert [columns.get(i).getBloomFilterOffset() >= 0 for i in range(3)] == [False, True, False]
        file.close()


def test_bucketed_tables_join_where_they_lie(spark):
    keep = layout.Bucketed(spark, 4)
    parents = keep.put(spark.range(1000).withColumn("owner", F.col("id") % 9), "id")
    children = keep.put(spark.range(3000).select((F.col("id") % 1200).alias("id"), F.col("id").alias("turn")), "id", "turn")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listed = parents.join(op.latest_child(children, "id", ["turn"], ["turn"]), "id", "left")
        left = op.cascade_delete(parents, children, parents.filter("owner = 3"), "id", "id")[1]
        for df in (listed, left):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert listed.count() == 1000 and left.count() == sum(1 for i in range(3000) if not (i % 1200 < 1000 and i % 1200 % 9 == 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        names = keep.names
        keep.forget()
    assert not any(spark.catalog.tableExists(n) for n in names)
