"""Outcomes of requests and what they change, on small tables with every case."""

import datetime
import hashlib
import hmac

from pyspark.sql import functions as F

from chatloom import catalog, sources
from chatloom.operators import requests as rq
from chatloom.plans import service

CONVERSATIONS = [(1, 10, None, 3), (2, 20, "", 0), (3, 30, "kept", 8), (4, 40, None, 1)]
ENTITLED = [(10, 4, 5), (20, 5, 5), (30, 9, 5), (40, 100, None)]
REQUESTS = [
    (1, 1, 10, None, "text", "first " + "w" * 100), (2, 1, 10, None, "image", "second"), (3, 2, 20, None, "text", "over"), (4, 2, 20, " 7 ", "text", "free by header"),
    (5, 3, 30, "x", "audio", "  \n"), (6, 3, 10, None, "text", "stranger"), (7, 9, 10, None, "text", "none such"), (8, 1, 10, None, "text", ""), (9, 1, 10, None, "text", "y" * 4001),
    (10, 1, 10, None, "audio", "\u3000"), (11, 4, 40, None, "text", "no limit"), (12, 1, None, None, "text", "nobody"), (13, 1, 10, None, "text", None), (14, 3, 30, None, "audio", "over too"),
]


def tables(spark):
    conv = spark.createDataFrame(CONVERSATIONS, "conv_id long, user_id long, title string, last_turn long")
    ent = spark.createDataFrame(ENTITLED, "user_id long, used long, daily int")
    req = spark.createDataFrame(REQUESTS, "request_id long, conv_id long, uid long, header string, kind string, text string")
    return conv, ent, req


def test_message_outcomes_and_changes(spark):
    conv, ent, req = tables(spark)
    out = rq.message_outcomes(req, conv, ent, F.lit("7, x"))
    status = {r.request_id: r.status for r in out.collect()}
    # The first request takes what was left; from then on even blanks are refused.
    assert status == {1: 200, 2: 429, 3: 429, 4: 200, 5: 429, 6: 404, 7: 404, 8: 422, 9: 422, 10: 429, 11: 200, 12: 404, 13: 422, 14: 429}
    at_once = {r.request_id: r.status for r in rq.message_outcomes(req, conv, ent, F.lit("7, x"), concurrent=True).collect()}
    assert at_once == status | {2: 200, 10: 400}
    out = rq.message_outcomes(req, conv, ent, F.lit("7, x"), concurrent=True)
    replies = spark.createDataFrame([(i, "failed" if i == 2 else "completed", f"r{i}", None if i == 4 else 7) for i in range(1, 15)], "request_id long, run string, reply string, tokens long")
    rows = sorted(map(tuple, rq.appended_messages(out, replies).collect()))
    assert rows == sorted([
        (1, 4, "user", REQUESTS[0][5], "text", 0), (1, 5, "assistant", "r1", "text", 7), (1, 6, "user", "second", "image", 0), (1, 7, "assistant", "[error: run failed]", "text", 0),
        (2, 1, "user", "free by header", "text", 0), (2, 2, "assistant", "r4", "text", 0), (4, 2, "user", "no limit", "text", 0), (4, 3, "assistant", "r11", "text", 7),
    ])
    at = datetime.datetime(2024, 1, 1)
    touched = rq.touched_conversations(conv.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), out, F.lit(at).cast("timestamp_ntz"))
    assert {(r.conv_id, r.title, r.updated_at) for r in touched.collect()} == {(1, REQUESTS[0][5][:80], at), (2, "free by header", at), (3, "kept", None), (4, "no limit", at)}
    assert {r.user_id: r.used for r in rq.bumped_usage(ent, out).collect()} == {10: 6, 20: 6, 30: 9, 40: 101}


def test_deletions_and_creations(spark):
    conv, _, _ = tables(spark)
    req = spark.createDataFrame([(1, 10), (2, 10), (9, 10), (3, None)], "conv_id long, uid long")
    assert {(r.conv_id, r.status) for r in rq.deletions(req, conv).collect()} == {(1, 204), (2, 404), (9, 404), (3, 404)}
    new = spark.createDataFrame([(0, 10, "t", None), (5, 20, None, "a")], "request_id long, uid long, thread_id string, title string")
    assert {(r.uid, r.status, r.conv_id) for r in rq.creations(new, conv).collect()} == {(10, 201, 5), (20, 503, None)}
    assert {r.conv_id for r in rq.creations(new, conv.limit(0)).collect()} == {1, None}


def test_registered_users(spark):
    at = datetime.datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, "a", "A", "en", None), (2, "b", None, "en", None)], "tg_uid long, username string, display_name string, language_code string, accepted_terms_at timestamp_ntz")
    given = spark.createDataFrame([(1, 1, "new", "", "ru"), (0, 1, "stale", "S", "ru"), (2, 3, None, "", "ru"), (3, None, "x", "y", "ru"), (4, 4, "d", "D", "de")], "request_id long, tg_uid long, username string, display_name string, language_code string")
    got = {tuple(r) for r in rq.registered(old, given, F.lit(at).cast("timestamp_ntz")).collect()}
    # The name that only the earlier request gave stays.
    assert got == {(1, "new", "S", "en", None, False), (2, "b", None, "en", None, False), (3, None, "User 3", "ru", at, True), (4, "d", "D", "de", at, True)}


def test_signatures_equal_the_standard_library(spark):
    data = "/root/testdata/sf0.001"
    valid = {r.k: r.validated for r in catalog.QUERIES["api_auth"](spark, data).collect()}
    from urllib.parse import parse_qs

    for r in service.init_strings(spark, data).collect():
        values = {k: v[0] for k, v in parse_qs(r.raw, keep_blank_values=True).items()}
        given = values.pop("hash")
        key = hmac.new(b"WebAppData", service.TOKEN.encode(), hashlib.sha256).digest()
        right = hmac.new(key, "\n".join(f"{k}={v}" for k, v in sorted(values.items())).encode(), hashlib.sha256).hexdigest() == given
        assert right == (r.k % 4 != 3)
        assert valid[r.k] == (right and service.CLOCK - int(values["auth_date"]) <= 86_400 and r.k % 6 != 5)


def test_each_part_of_a_signed_string_is_decoded_once(spark):
    """The parsed map names each part's decoding once, at whatever number of parts, and the first value of a key wins."""
    from chatloom.functions import init_data

    rows = spark.createDataFrame([("a=1&b=%41+x&a=2&&bare&c=x=y&d=50%",), (None,), ("",)], "raw string").select(init_data.pairs(F.col("raw")).alias("v"))
    assert [r.v for r in rows.collect()] == [{"a": "1", "b": "A x", "bare": "", "c": "x=y", "d": "50%"}, None, {}]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("UrlCodec.decode") == 2
    user = spark.createDataFrame([("user=%7B%22id%22%3A5%2C%22first_name%22%3A%22A%22%7D",), ("user=x",)], "raw string").select(init_data.user(init_data.pairs(F.col("raw"))).alias("u"))
    assert [r.u and (r.u.id, r.u.first_name) for r in user.collect()] == [(5, "A"), None]
    assert user._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_rows_of_one_file_are_dealt_out(spark):
    """Queries that make much of each customer do so in several tasks, though the table is one row group."""
    data = "/root/testdata/sf0.001"
    assert service.init_strings(spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    one = spark.read.parquet(f"{data}/customer.parquet").select("c_custkey")
    assert one.rdd.getNumPartitions() == 1
    assert sources.dealt(one, "c_custkey", share=500).rdd.getNumPartitions() == -(-sources.planned_bytes(one) // 500) > 4
    assert sorted(sources.dealt(one, "c_custkey").collect()) == sorted(one.collect())


def test_binary_files_and_json_responses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.bin", b"\x00\xff1"), ("b.bin", b"22")):
        (tmp_path / "in" / name).write_bytes(content)
    files = sources.media_files(spark, str(tmp_path / "in"))
    assert sorted((r.path.rsplit("/", 1)[1], r.length, bytes(r.content)) for r in files.collect()) == [("a.bin", 3, b"\x00\xff1"), ("b.bin", 2, b"22")]
    sources.write_responses(files.selectExpr("length", "null as gone"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"length":2}', '{"length":3}']


def test_a_live_table_is_read_in_ranges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(100).selectExpr("id", "concat('u', id) as name")
    rows.write.format("jdbc").options(url=url, dbtable="users", driver=driver).save()
    read = sources.jdbc(spark, url, "users", "ID", 0, 99, parts=4, driver=driver)
    assert read.rdd.getNumPartitions() == 4
    assert {tuple(r) for r in read.filter("ID >= 90").collect()} == {(i, f"u{i}") for i in range(90, 100)} and read.count() == 100


def test_strings_of_customers_are_parsed_in_several_tasks(spark):
    for name in ("f6_parse_pairs", "f8_init_user", "f9_base_string", "f10_expiry"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_a_date_is_parsed_once_for_its_age(spark):
    plan = catalog.QUERIES["f10_expiry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UrlCodec.decode") == 2


def dealings(df):
    """How often a plan deals rows out."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")


def test_sign_ins_are_dealt_out_before_they_are_sorted(spark):
    data = "/root/testdata/sf0.001"
    assert service.sign_in_requests(spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert dealings(service.api_sign_in_users(spark, data)) == 1


def test_answers_to_sign_ins_come_from_dealt_requests(spark):
    """Both the users' first requests and the sums of blocks are made of rows that no single task holds."""
    assert dealings(service.api_sign_in_answers(spark, "/root/testdata/sf0.001")) == 3


def test_sign_ins_are_ordered_in_tasks_of_one_size(spark):
    """The requests are dealt out by number before their windows and not moved again; nothing made of them is broadcast, however small customer's file."""
    plan = service.api_sign_in_answers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line and "_block" in line and "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1 and "Broadcast" not in plan
    assert plan.count("SortMergeJoin") == 2


def test_registrations_and_arrivals_are_dealt_out(spark):
    data = "/root/testdata/sf0.001"
    assert dealings(service.api_register(spark, data)) == 1
    assert dealings(service.i1_arrivals(spark, data)) >= 1
