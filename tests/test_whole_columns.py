"""Queries that pass whole columns through their operators, on documents and pages longer than any prefix."""

import base64

from chatloom import catalog
from chatloom.functions import answers

LONG = "слово и ещё " * 40
TEXTS = [LONG + "АВС = 1,5АВС = 1,5 end", LONG + "$x_{1}$x1 cost $5", "y = 2.0 y = 2.0; " + LONG + "AB=1.25 AB=1.25", "", LONG + "a=1,5b=1,5 = 0"]


def run(spark, tmp_path, name):
    spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "doc_id long, text string, html string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id as page_id", "html").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    return [r[1] for r in sorted(rows)]


def test_normalize_echo(spark, tmp_path):
    table = str.maketrans(answers.CYRILLIC, answers.LATIN)
    assert run(spark, tmp_path, "t2a_normalize_echo") == [f"АВСДж {t} хУ".translate(table) for t in TEXTS]


def without_echoes(t):
    """The longest name of up to five letters, =, a decimal number, and the same slice again behind white space: one of the two goes."""
    out, i = "", 0
    while i < len(t):
        for letters in range(5, 0, -1):
            name = t[i : i + letters]
            if len(name) < letters or not all(c.isalpha() for c in name):
                continue
            j = i + letters
            while j < len(t) and t[j].isspace():
                j += 1
            if t[j : j + 1] != "=":
                continue
            j += 1
            while j < len(t) and t[j].isspace():
                j += 1
            k = j
            while k < len(t) and t[k].isdigit():
                k += 1
            if k == j or t[k : k + 1] not in (",", "."):
                continue
            stop = k + 1
            while stop < len(t) and t[stop].isdigit():
                stop += 1
            # The last digits may belong to what follows.
            for end in range(stop, k + 1, -1):
                again = end
                while again < len(t) and t[again].isspace():
                    again += 1
                if t.startswith(t[i:end], again):
                    out, i = out + t[i:end], again + end - i
                    break
            else:
                continue
            break
        else:
            out, i = out + t[i], i + 1
    return out


def test_plain_echoes(spark, tmp_path):
    want = [without_echoes(f"CD = 6,0CD = 6,0 см {t}") for t in TEXTS]
    assert want[0].startswith("CD = 6,0 см ") and want[0].count("АВС") == 1 and want[2].count("AB") == 1
    assert run(spark, tmp_path, "t4_plain_echoes") == want


def test_latex_echoes(spark, tmp_path):
    want = [f"$q_{{1}}$ {t}" for t in TEXTS]
    want[1] = f"$q_{{1}}$ {LONG}$x_{{1}}$ cost $5"
    assert run(spark, tmp_path, "t3_echoes_in_documents") == want


def test_data_url(spark, tmp_path):
    assert run(spark, tmp_path, "f13_data_url") == ["data:text/html;base64," + base64.b64encode(t.encode()).decode() for t in TEXTS]
