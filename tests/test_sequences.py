"""Requests in order against plain loops, and streams against one batch, in any split and with batches that come again."""

import datetime
import random
from urllib.parse import parse_qs, unquote

import pytest
from pyspark.sql import functions as F

from chatloom import streaming
from chatloom.functions import init_data
from chatloom.operators import requests as rq
from chatloom.operators.in_order import in_order

AT = datetime.datetime(2024, 1, 1)
now_ = lambda: F.lit(AT).cast("timestamp_ntz")
SIGN_IN = "request_id long, tg_uid long, username string, display_name string, language_code string"
USERS = "tg_uid long, username string, display_name string, language_code string, accepted_terms_at timestamp_ntz"


def test_running_columns_equal_a_loop(spark):
    r = random.Random(1)
    rows = [(i * r.choice([1, 1, 7]) + i - 500, r.choice([1, 1, 1, 2, 3, None]), r.choice([None, "a", "b", "c"])) for i in range(400)]
    rows = list({o: (k, o, v) for o, k, v in rows}.values())
    want, seen, last = set(), {}, {}
    for k, o, v in sorted(rows, key=lambda x: x[1]):
        if k is None:
            want.add((k, o, v, 0, v))
            continue
        if v is not None:
            last[k] = v
        want.add((k, o, v, seen.get(k, 0), last.get(k)))
        seen[k] = seen.get(k, 0) + (v == "b")
    df = spark.createDataFrame(rows, "k long, o long, v string").repartition(3)
    for block in (1, 7, 100, 10**6):
        assert {tuple(x) for x in in_order(df, "k", "o", {"n": F.col("v") == "b"}, {"last": F.col("v")}, block).collect()} == want
    assert in_order(df.limit(0), "k", "o", {"n": F.lit(True)}).count() == 0


@pytest.mark.parametrize("parts", [None, 1, 5])
def test_first_values_and_rows_of_the_same_key_come_along(spark, parts):
    rows = [(5, 1, "b"), (-30, 1, None), (31, 1, "a"), (7, 2, "c"), (9, None, "d"), (40, 3, None)]
    df = spark.createDataFrame([(k, o, v) for o, k, v in rows], "k long, o long, v string").repartition(3)
    names = spark.createDataFrame([(1, "one"), (3, None), (4, "four"), (None, "nobody")], "k long, name string")
    got = in_order(df, "k", "o", {"n": F.lit(True)}, block=10, firsts={"first": F.col("v")}, beside=names, parts=parts)
    assert got.columns == ["k", "o", "v", "n", "first", "name"]
    assert {x.o: (x.n, x["first"], x["name"]) for x in got.collect()} == {-30: (0, None, "one"), 5: (1, None, "one"), 31: (2, None, "one"), 7: (0, "c", None), 9: (0, "d", None), 40: (0, None, None)}


@pytest.mark.parametrize("block", [50, 10**6])
def test_sign_ins_dealt_over_tasks_equal_a_loop(spark, block):
    users, given = sequence(7)
    old, asked = spark.createDataFrame(users, USERS), spark.createDataFrame(given, SIGN_IN).repartition(4)
    assert {x.request_id: tuple(x) for x in rq.sign_ins(old, asked, now_(), block, parts=3).collect()} == signed_in(users, given)[0]
    assert rq.sign_ins(old, asked.limit(0), now_(), parts=3).count() == 0


def served(requests, owners, ent, free):
    """Each request after the other, as the service takes them."""
    used, out = {u: n for u, n, _ in ent}, {}
    daily = {u: d for u, _, d in ent}
    for i, conv, uid, header, kind, text in sorted(requests):
        if kind == "text" and not (text and len(text) <= 4000):
            out[i] = 422
        elif owners.get(conv) != uid or uid is None:
            out[i] = 404
        elif uid not in free and not ((header or "").strip().isdigit() and int(header) in free) and daily.get(uid) is not None and used[uid] >= daily[uid]:
            out[i] = 429
        elif kind != "text" and not (text or "").strip():
            out[i] = 400
        else:
            out[i] = 200
            if uid in used:
                used[uid] += 1
    return out, used


@pytest.mark.parametrize("seed", range(3))
def test_quota_in_order_equals_a_loop(spark, seed):
    r = random.Random(seed)
    owners = {c: c % 12 for c in range(40)}
    ent = [(u, r.randrange(8), r.choice([5, 6, 9, 60, None])) for u in range(11)]
    requests = []
    for i in r.sample(range(10_000), 600):
        conv = r.randrange(44)
        uid = r.choice([owners.get(conv), owners.get(conv), owners.get(conv), 3, None]) if i % 3 else 3
        conv = r.choice([c for c in owners if owners[c] == 3]) if i % 3 == 0 else conv
        requests.append((i, conv, uid, r.choice([None, None, "", " 99 ", "x", "98"]), r.choice(["text", "audio", "image"]), r.choice(["ok", "ok", "ok", "", " ", None, "y" * 4001])))
    out = rq.message_outcomes(
        spark.createDataFrame(requests, "request_id long, conv_id long, uid long, header string, kind string, text string").repartition(4),
        spark.createDataFrame([(c, u, None, 0) for c, u in owners.items()], "conv_id long, user_id long, title string, last_turn long"),
        entitled := spark.createDataFrame(ent, "user_id long, used long, daily int"),
        F.lit("99, 5"),
        block=r.choice([10, 1000, 10**6]),
    ).persist()
    want, used = served(requests, owners, ent, {99, 5})
    assert {x.request_id: x.status for x in out.collect()} == want
    assert {200, 400, 404, 422, 429} == set(want.values())
    assert {x.user_id: x.used for x in rq.bumped_usage(entitled, out).collect()} == used


def test_all_next_versions_of_one_batch(spark):
    conv = spark.createDataFrame([(1, 10, "", 3, AT)], "conv_id long, user_id long, title string, last_turn long, updated_at timestamp_ntz")
    ent = spark.createDataFrame([(10, 3, 5)], "user_id long, used long, daily int")
    req = spark.createDataFrame([(i, 1, 10, None, "text", f"q{i}") for i in range(4)], "request_id long, conv_id long, uid long, header string, kind string, text string")
    replies = spark.createDataFrame([(i, "completed", f"a{i}", 5) for i in range(4)], "request_id long, run string, reply string, tokens long")
    new = rq.next_versions(req, conv, ent, replies, F.lit(""), F.lit(datetime.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    assert sorted((x.request_id, x.status) for x in new["outcomes"].collect()) == [(0, 200), (1, 200), (2, 429), (3, 429)]
    assert sorted((x.turn, x.content) for x in new["messages"].collect()) == [(4, "q0"), (5, "a0"), (6, "q1"), (7, "a1")]
    assert [tuple(x) for x in new["conversations"].collect()] == [(1, 10, "q0", datetime.datetime(2025, 1, 1))]
    assert [tuple(x) for x in new["entitlements"].collect()] == [(10, 5, 5)]


def signed_in(users, given):
    """(answers by request, users behind them) of one sign-in after the other."""
    table = {u[0]: list(u) + [False] for u in users}
    answers = {}
    for i, uid, name, shown, lang in sorted(given, key=lambda g: g[0]):
        if uid is None:
            answers[i] = (i, None, None, None, None, None, None)
            continue
        new = uid not in table
        if new:
            table[uid] = [uid, name, shown or f"User {uid}", lang, AT, True]
        else:
            table[uid][1] = name or table[uid][1]
            table[uid][2] = shown or table[uid][2]
        answers[i] = (i, *table[uid][:5], new)
    return answers, {tuple(u) for u in table.values()}


def sequence(seed, n=300):
    r = random.Random(seed)
    users = [(u, r.choice([None, "", f"old{u}"]), r.choice([None, f"Old {u}"]), "en", None) for u in range(6)]
    some = lambda kind, i: r.choice([None, "", "", f"{kind}{i}"])
    given = [(i, r.choice([4, 4, 9, 9, 9, *range(20), None]), some("n", i), some("D", i), r.choice(["ru", "de", None])) for i in r.sample(range(5000), n)]
    return users, [*given, (5001, 21, "nick", "", "ru"), (5002, 21, "", "Name", "de")]


@pytest.mark.parametrize("block", [1, 50, 10**6])
def test_sign_ins_equal_a_loop(spark, block):
    users, given = sequence(block)
    answers, after = signed_in(users, given)
    old, asked = spark.createDataFrame(users, USERS), spark.createDataFrame(given, SIGN_IN).repartition(4)
    assert {x.request_id: tuple(x) for x in rq.sign_ins(old, asked, now_(), block).collect()} == answers
    assert {tuple(x) for x in rq.registered(old, asked, now_()).collect()} == after
    plans = spark.createDataFrame([(3, "free"), (2, "free"), (1, "pro")], "plan_id int, type string")
    new = rq.registered(old, asked, now_())
    assert {tuple(x) for x in rq.new_subscriptions(new, plans).collect()} == {(u[0], 2) for u in after if u[5]}
    assert rq.new_subscriptions(new, plans.filter("type = 'pro'")).count() == 0
    assert rq.sign_ins(old, asked.limit(0), now_()).count() == 0 and rq.registered(old, asked.limit(0), now_()).count() == len(users)


@pytest.mark.parametrize("seed, every", [(1, 20), (2, 2), (3, 1)])
def test_users_of_a_stream_equal_one_batch_in_any_split(spark, tmp_path, seed, every):
    users, given = sequence(seed, 120)
    random.Random(seed).shuffle(given)
    _, after = signed_in(users, given)
    old, plans = spark.createDataFrame(users, USERS), spark.createDataFrame([(2, "free")], "plan_id int, type string")
    write = lambda rows: spark.createDataFrame(rows, SIGN_IN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: streaming.UserStream(spark, f"file://{tmp_path}/users", every)
    for at in range(0, 40, 8):
        write(given[at : at + 8])
    stream().drain(streaming.file_stream(spark, f"{tmp_path}/in", files_per_trigger=1))
    assert {tuple(x) for x in stream().read(old, plans, now_())[0].collect()} == signed_in(users, given[:40])[1]
    for at in range(40, len(given), 30):
        write(given[at : at + 30])
    stream().drain(streaming.file_stream(spark, f"{tmp_path}/in", files_per_trigger=1))
    now, new = stream().read(old, plans, now_())
    assert {tuple(x) for x in now.collect()} == after
    assert sorted(tuple(x) for x in new.collect()) == sorted((u[0], 2) for u in after if u[5])


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    users, given = sequence(7, 60)
    parts = [rq.sign_in_parts(spark.createDataFrame(given[at : at + 10], SIGN_IN)) for at in range(0, 60, 10)]
    stream = streaming.UserStream(spark, f"file://{tmp_path}/users", every=2)
    for number, part in enumerate(parts):
        stream.add(part, number)
        stream.add(part, number)
    old, plans = spark.createDataFrame(users, USERS), spark.createDataFrame([(2, "free")], "plan_id int, type string")
    assert {tuple(x) for x in stream.read(old, plans, now_())[0].collect()} == signed_in(users, given[:60])[1]
    # A base whose write was cut off doesn't stand.
    (tmp_path / "users/bases" / f"{5:012d}" / "_SUCCESS").unlink()
    assert {tuple(x) for x in stream.read(old, plans, now_())[0].collect()} == signed_in(users, given[:60])[1]
    assert not any(f"{n:012d}" in p for p in stream.read(old, plans, now_())[0].inputFiles() for n in (0, 1, 2))


def counted(rows):
    out = {}
    for u, t in rows:
        if u is None or t is None:
            continue
        for level, since in (("day", t.date()), ("month", t.date().replace(day=1)), ("lifetime", None)):
            n, last = out.get((u, level, since), (0, t))
            out[u, level, since] = (n + 1, max(last, t))
    return {(*k, *v) for k, v in out.items()}


def test_usage_in_any_order_equals_a_recount(spark, tmp_path):
    r = random.Random(4)
    events = [(r.choice([1, 1, 2, 3, None]), datetime.datetime(2024, 3, 1) - datetime.timedelta(hours=r.randrange(2400)) if r.random() < 0.95 else None) for _ in range(300)]
    # The latest days first, one file a batch: nothing is dropped as late.
    events.sort(key=lambda e: e[1] or AT, reverse=True)
    table = streaming.usage_stream(spark, f"file://{tmp_path}/usage", every=3)
    for at in range(0, 300, 30):
        spark.createDataFrame(events[at : at + 30], "user_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        table.drain(streaming.file_stream(spark, f"{tmp_path}/in", files_per_trigger=1))
        assert {tuple(x) for x in table.read().collect()} == counted(events[: at + 30])
    # A new day is added without a look at old events.
    table.append(spark.createDataFrame([(1, AT)], "user_id long, ts timestamp_ntz"), 10)
    read = table.read()
    assert {tuple(x) for x in read.collect()} == counted([*events, (1, AT)])
    assert read.inputFiles() and not any(f"{tmp_path}/in" in f for f in read.inputFiles())


def test_one_level_and_nothing(spark, tmp_path):
    day = streaming.usage_stream(spark, f"file://{tmp_path}/days", levels=("day",))
    assert day.read().count() == 0
    day.append(spark.createDataFrame([(1, AT), (1, AT)], "user_id long, ts timestamp_ntz"), 0)
    assert [tuple(x) for x in day.read().collect()] == [(1, "day", AT.date(), 2, AT)]


def test_decoding_equals_the_standard_library(spark):
    r = random.Random(5)
    bits = ["%", "%2", "%20", "+", "a", "é", "%C3%A9", "%zz", "&", "=", "k", "%26", "%25", "%u", "%%", "x y", "%E6%BC%A2"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(400)] + ["a=x%20y%", "a=1+2%", "a=%FF"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", init_data.pairs(F.col("t")).alias("p")).collect()
    for x in got:
        want = {k: v[0] for k, v in parse_qs(texts[x.i], keep_blank_values=True).items()}
        assert x.p == want, texts[x.i]
    user = '{"id":1,"first_name":"50%25+%zz"}'
    row = spark.createDataFrame([(user,)], "u string").select(init_data.user(F.create_map(F.lit("user"), F.col("u"))).alias("u")).first()
    assert row.u.first_name == unquote("50%25+%zz")


def test_unknown_senders_become_users_once(spark):
    from chatloom.operators import arrivals as ar

    user = "struct<id: long, first_name: string, last_name: string, username: string, language_code: string>"
    rows = [
        (3, (7, "A", "B", "nick", "de"), "5", None), (1, (7, "First", None, "", None), None, None), (2, (1, "Known", None, "new", "fr"), None, None), (4, None, " 8 ", (9, "no", None, None, None)),
        (5, None, "bad", (9, "", "", None, "")), (6, None, "", None), (7, None, None, None), (8, None, "1", None), (9, None, "7", None),
    ]
    requests = spark.createDataFrame(rows, f"request_id long, signed {user}, header string, parsed {user}")
    users = spark.createDataFrame([(1, "one", "One", "en")], "tg_uid long, username string, display_name string, language_code string")
    plans = spark.createDataFrame([(4, "pro", 9, 90)], "plan_id int, type string, daily int, monthly int")
    got = ar.arrivals(requests, users, plans)
    assert {tuple(x) for x in got["answers"].collect()} == {(1, 7, True), (2, 1, False), (3, 7, False), (4, 8, True), (5, 9, True), (6, 0, True), (7, 0, False), (8, 1, False), (9, 7, False)}
    assert {tuple(x) for x in got["users"].collect()} == {(1, "one", "One", "en"), (7, "user_7", "First", "ru"), (8, "user_8", "User 8", "ru"), (9, "user_9", "User 9", "ru"), (0, "guest", "Гость", "ru")}
    assert {tuple(x) for x in got["plans"].collect()} == {(4, "pro", 9, 90), (5, "free", 20, 500)}
    assert sorted(map(tuple, got["subscriptions"].collect())) == [(0, 5), (7, 5), (8, 5), (9, 5)]
    again = ar.arrivals(requests, got["users"], got["plans"])
    assert not any(x.is_new for x in again["answers"].collect()) and again["subscriptions"].count() == 0 and again["plans"].count() == 2
    assert ar.arrivals(requests.limit(0), users, plans)["users"].count() == 1
