"""Answer cleaning of texts put together from pieces whose cleaned form is known, and of whole documents."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatloom import catalog
from chatloom.functions import answers, int_or_null, strip

DATA = "/root/testdata/sf0.001"
#: Pieces of answers and what is left of each; none changes what stands beside it.
PIECES = [
    ("word", "word"), ("при【4:0†x】вет", "привет"), ("q【】【1】w", "qw"), ("a    b", "a b"), ("\\(n\\)", "$n$"), ("\\[m\\]", "$$m$$"), ("{x}", "x"), ("{,}", ","), ("5\\text{ см}", "5\\text см"),
    ("$a_{1}$a1", "$a_{1}$"), ("$a_{1}$a1.", "$a_{1}$."), ("$A$А", "$A$"), ("$A$AB", "$A$AB"), ("$A$AБ", "$A$Б"), ("$A$БA", "$A$БA"), ("$A$ A", "$A$ A"), ("$$A$$A", "$$A$$A"), ("$k$K", "$k$K"), ("$с$c", "$с$"),
    ("$\\frac{a}{b}$a/b,", "$\\frac{a}{b}$,"), ("$\\sqrt{2}$√2!", "$\\sqrt{2}$!"), ("$\\text{см}$см", "$\\text{см}$"), ("$\\alpha x$x", "$\\alpha x$"), ("$x\\ y^{2}$x y2", "$x\\ y^{2}$"), ("\\(p\\)p", "$p$"), ("$ $", "$ $"), ("$$\\frac{c}{d}$$", "$$\\frac{c}{d}$$"),
    ("CD = 6,0CD = 6,0 см", "CD = 6,0 см"), ("x=1.5 x=1.5 so", "x=1.5 so"), ("Угол=30.25Угол=30.25!", "Угол=30.25!"), ("y = 1,5 y = 1,6 no", "y = 1,5 y = 1,6 no"), ("a=1,5b=1,5 no", "a=1,5b=1,5 no"), ("abcdefg=1.0abcdefg=1.0 no", None), ("n=5 n=5 no", "n=5 n=5 no"),
]
# Of a longer name the last five letters echo, which no name goes before.
PIECES = [(raw, raw if done is None else done) for raw, done in PIECES]
ENDS = [("", ""), ("$ {open", "$ {open"), ("$$ {a} $", "$$ {a} $"), ("【never", "【never"), ("  ", "")]
SPECIAL = set("$\\{}【】=")


def answer(r):
    some = [r.choice(PIECES) for _ in range(r.randrange(12))] + [r.choice(ENDS)]
    raw, done = (" ".join(x for x in side if x) for side in zip(*some))
    return r.choice(["", " ", "\u3000"]) + raw, done


@pytest.mark.parametrize("seed", range(3))
def test_answers_of_known_pieces(spark, seed):
    r = random.Random(seed)
    texts = [answer(r) for _ in range(3000)]
    frame = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "t": [t for t, _ in texts]}))
    for x in frame.select("i", answers.clean_answer(F.col("t")).alias("c")).collect():
        assert x.c == texts[x.i][1], repr(texts[x.i][0])


def test_full_chain_on_documents(spark):
    """Whole documents without a sign that means something keep all but runs of spaces and white ends."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.text for r in catalog.QUERIES["t_full_chain"](spark, DATA).collect()}
    echoed = {r.doc_id: r.text for r in catalog.QUERIES["t3_echoes_in_documents"](spark, DATA).collect()}
    assert got.keys() == texts.keys() == echoed.keys()
    bare = [i for i, t in texts.items() if not SPECIAL & set(t)]
    assert len(bare) > 100
    for i in bare:
        words = " ".join(w for w in texts[i].split(" ") if w)
        assert got[i] == ("$q_{1}$ x " + words).strip()
        assert echoed[i] == "$q_{1}$ " + texts[i]


def test_batches_of_texts_are_bounded(spark):
    """Texts that Python cleans come in batches of bounded rows and bytes, whatever the session had."""
    for name in ("t_full_chain", "t3_echoes_in_documents"):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        catalog.QUERIES[name](spark, DATA)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
        assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_braces_on_threads(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    got = {(r.conv_id, r.turn): r.content for r in catalog.QUERIES["api_thread_cleaned"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if r.role != "assistant":
            assert got[r.conv_id, r.turn] == r.text
        elif "$" not in r.text:
            assert got[r.conv_id, r.turn] == "".join(c for c in r.text if c not in "{}")


def test_braces_of_known_pieces(spark):
    r = random.Random(8)
    known = [("a", "a"), ("{", ""), ("}", ""), ("\n", "\n"), ("${x}$", "${x}$"), ("$$ {$} $$", "$$ {$} $$"), ("{b}", "b")]
    texts = []
    for _ in range(2000):
        some = [r.choice(known) for _ in range(r.randrange(15))]
        # A sign next to another one would make a longer one.
        some = [s for pair in zip(some, [(" ", " ")] * len(some)) for s in pair] + [r.choice([("", ""), ("$ {", "$ {"), ("$$ {}", "$$ {}")])]
        texts.append(tuple("".join(x) for x in zip(*some)))
    frame = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "t": [t for t, _ in texts]}))
    for x in frame.select("i", answers.clean_outside_math(F.col("t")).alias("b")).collect():
        assert x.b == texts[x.i][1], repr(texts[x.i][0])


def test_display_of_very_long_texts(spark):
    far = "x" * 50_000
    rows = [(1, "$" + far + "{,}"), (2, "{,}" + far + "$"), (3, "{,}" + far + "{,}")]
    got = {x.i: x.t for x in spark.createDataFrame(rows, "i int, s string").select("i", answers.display_text(F.col("s")).alias("t")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "," + far + ","}


def test_strip_and_integers_in_any_script(spark):
    texts = ["  a b ", "\u3000\u00a0x\x1c\t", "", None, " \n", "\x85é\u2009", " " * 30_000 + "y" + " " * 30_000 + "z"]
    got = [x.t for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", strip(F.col("s")).alias("t")).orderBy("i").collect()]
    assert got == [t if t is None else t.strip() for t in texts]
    numbers = spark.createDataFrame([(i, t) for i, t in enumerate(["+5", " -7\n", "\t12", "+", "1 2", "+-3"])], "i int, s string")
    assert [x.n for x in numbers.select("i", int_or_null(F.col("s")).alias("n")).orderBy("i").collect()] == [5, -7, 12, None, None, None]
