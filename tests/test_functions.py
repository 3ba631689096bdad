"""Column functions on literal cases, and the cleaning of answers against plain restatements."""

import base64
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from chatloom import functions as fn
from chatloom.functions import answers, init_data


def one(spark, column, **values):
    """The value of a column expression over one row of strings, nulls or numbers."""
    names = list(values) or ["x"]
    types = {int: "bigint", str: "string", type(None): "string"}
    schema = ", ".join(f"{n} {types[type(values.get(n))]}" for n in names)
    return spark.createDataFrame([tuple(values.get(n) for n in names)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "first, last, uid, want",
    [("Ann", None, 7, "Ann"), ("", None, 7, "User 7"), ("Ann", "Lee", 7, "Ann Lee"), (None, "Lee", 7, "Lee"), ("  ", "\t", 7, "User 7")],
)
def test_display_name(spark, first, last, uid, want):
    assert one(spark, fn.display_name(F.col("first"), F.col("last"), F.col("uid")), first=first, last=last, uid=uid) == want


@pytest.mark.parametrize("text, want", [(" 1, x,,2", [1, 2]), ("", []), ("3,3, 3 ", [3]), ("-4,1_0,99999999999999999999", [-4]), (None, None)])
def test_id_set(spark, text, want):
    assert one(spark, fn.id_set(F.col("x")), x=text) == want


@pytest.mark.parametrize("limit, used, want", [(5, 7, 0), (5, 2, 3), (5, 0, 5)])
def test_remaining(spark, limit, used, want):
    assert one(spark, fn.remaining(F.col("a"), F.col("b")), a=limit, b=used) == want


def test_remaining_counts_missing_use_as_none(spark):
    assert one(spark, fn.remaining(F.col("a"), F.lit(None).cast("bigint")), a=5) == 5


@pytest.mark.parametrize("age, want", [(86_400, False), (86_401, True), (-5, False)])
def test_expiry(spark, age, want):
    assert one(spark, fn.is_expired(F.col("a"), F.col("b")), a=1_000_000 - age, b=1_000_000) is want


def test_missing_date_is_expired(spark):
    assert one(spark, fn.is_expired(F.lit(None).cast("bigint"), F.col("b")), b=1_000_000) is True


@pytest.mark.parametrize("values, want", [(("", None, "c"), "c"), (("a", "b", "c"), "a"), ((None, "b", "c"), "b"), (("", "", ""), "")])
def test_first_nonempty(spark, values, want):
    named = dict(zip("abc", values))
    assert one(spark, fn.first_nonempty(*[F.col(c) for c in named]), **named) == want


@pytest.mark.parametrize("text, n, want", [("abc", 2, "ab"), ("ab", 120, "ab"), ("😀😀😀", 2, "😀😀"), (None, 3, None)])
def test_prefix_counts_code_points(spark, text, n, want):
    assert one(spark, fn.prefix(F.col("x"), n), x=text) == want


@pytest.mark.parametrize("url, want", [("http://a", "http://a?q=1"), ("http://a?b", "http://a?b&q=1")])
def test_append_query(spark, url, want):
    assert one(spark, fn.append_query(F.col("x"), F.lit("q=1")), x=url) == want


def test_badges_and_data_url(spark):
    assert [one(spark, fn.input_badge(F.col("x")), x=k) for k in ("audio", "image", "text", None)] == ["🎤 ", "📷 ", "", ""]
    long = "ab" * 60
    assert one(spark, fn.data_url(F.lit("image/png"), F.encode("x", "UTF-8")), x=long) == "data:image/png;base64," + base64.b64encode(long.encode()).decode()


@pytest.mark.parametrize(
    "text, spans, want",
    [("abcdefghij", [(5, 7), (1, 2)], "acdehij"), ("abc", [], "abc"), ("abc", [(0, 9)], "abc"), ("abc", [(2, 2), (-1, 2)], "abc"), ("abc", None, "abc")],
)
def test_annotations(spark, text, spans, want):
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start int, end int>>")
    assert df.select(answers.strip_annotations(F.col("t"), F.col("s"))).first()[0] == want


@pytest.mark.parametrize("text, want", [("a【4:0†x】b", "ab"), (r"\(x\) \[y\]", "$x$ $$y$$"), ("a   b", "a b"), ("  a\t\tb \n", "a\t\tb"), (None, None)])
def test_formatting(spark, text, want):
    assert one(spark, answers.clean_formatting(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("$A$A", "$A$"),
        ("$A$А", "$A$"),
        ("x $abc", "x $abc"),
        ("$A$AB", "$A$AB"),
        ("$A$AБ", "$A$Б"),
        ("$$A$$A", "$$A$$A"),
        (r"$\frac{a}{b}$a/b.", r"$\frac{a}{b}$."),
        ("$$", "$$"),
        ("", ""),
        (None, None),
    ],
)
def test_inline_echo(spark, text, want):
    assert one(spark, answers.remove_latex_echoes(F.col("x")), x=text) == want


def test_plain_echo(spark):
    assert one(spark, answers.remove_plain_echoes(F.col("x")), x="CD = 6,0CD = 6,0 см") == "CD = 6,0 см"


@pytest.mark.parametrize(
    "text, mode, want",
    [
        ("a{,}b $x_{1}$ {c}", "strict", "a,b $x_{1}$ c"),
        (r"5\text{ см}", "strict", r"5\text см"),
        (r"5\text{ см}", "intended", "5см"),
        ("{a} $b{", "strict", "a $b{"),
        ("", "strict", ""),
        (None, "strict", None),
    ],
)
def test_outside_math(spark, text, mode, want):
    assert one(spark, answers.clean_outside_math(F.col("x"), mode), x=text) == want


def without_braces(text):
    """Braces go unless between dollar signs, or behind one that none closes."""
    out, i = "", 0
    while i < len(text):
        sign = "$$" if text.startswith("$$", i) else "$" if text[i] == "$" else ""
        if sign:
            end = text.find(sign, i + len(sign))
            end = len(text) if end < 0 else end + len(sign)
            out, i = out + text[i:end], end
        else:
            out, i = out + (text[i] if text[i] not in "{}" else ""), i + 1
    return out


def test_outside_math_on_random_texts(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("{}a $\\\n") for _ in range(r.randrange(14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for row in df.select("x", answers.clean_outside_math(F.col("x")).alias("y")).collect():
        assert row.y == without_braces(row.x), row.x


def test_signed_string(spark):
    raw = "b=2&a=1&user=%7B%22id%22%3A7%2C%22first_name%22%3A%22A%2BB%22%7D&a=9&blank=&broken&hash=ff"
    values = init_data.pairs(F.col("x"))
    assert one(spark, values, x=raw) == {"b": "2", "a": "1", "user": '{"id":7,"first_name":"A+B"}', "blank": "", "broken": "", "hash": "ff"}
    who = one(spark, init_data.user(values), x=raw)
    assert (who["id"], who["first_name"], who["last_name"]) == (7, "A+B", None)
    base = 'a=1\nb=2\nblank=\nbroken=\nuser={"id":7,"first_name":"A+B"}'
    assert one(spark, init_data.base_string(values), x=raw) == base
    key = hmac.new(b"WebAppData", b"token", hashlib.sha256).digest()
    signed = one(spark, init_data.signature("token")(init_data.base_string(values)), x=raw)
    assert signed == hmac.new(key, base.encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("raw", ["", "user=nonsense", "user=%7B%22id%22%3A7%7D", "user=%7B%22first_name%22%3A%22A%22%7D", None])
def test_user_needs_id_and_first_name(spark, raw):
    assert one(spark, init_data.user(init_data.pairs(F.col("x"))), x=raw) is None


@pytest.mark.parametrize("signed, header, parsed, want", [(1, "2", 3, 1), (None, " 2 ", 3, 2), (None, "x", 3, 3), (None, None, None, 0)])
def test_identity_precedence(spark, signed, header, parsed, want):
    df = spark.createDataFrame([(signed, header, parsed)], "s bigint, h string, p bigint")
    assert df.select(init_data.resolve_id(F.col("s"), F.col("h"), F.col("p"))).first()[0] == want
