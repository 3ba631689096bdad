"""Cleaning of generated answers: citations, math markup and repeated fragments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import strip

#: Cyrillic letters and the Latin ones that an echo takes for them.
CYRILLIC = "АВСЕНКМОРТХУаеорсухД"
LATIN = "ABCEHKMOPTXYaeopcyxD"
#: Delimiters of math and what stands for them.
DELIMITERS = ((r"\(", "$"), (r"\)", "$"), (r"\[", "$$"), (r"\]", "$$"))
#: Fixed value: a citation.
CITATION = "【[^】]*】"
#: Fixed value: math, closed or not, or else a brace.
MATH_OR_BRACE = r"(\$\$[\s\S]*?\$\$|\$\$[\s\S]*|\$[^$]+\$|\$[^$]*)|[{}]"


def strip_annotations(text: Column, spans: Column) -> Column:
    """Cut spans out, the last first; one that no longer fits the shortened text stays."""
    later_first = F.array_sort(spans, lambda a, b: b["start"] - a["start"])

    def cut(value: Column, span: Column) -> Column:
        fits = (span["start"] >= 0) & (span["start"] < span["end"]) & (span["end"] <= F.length(value))
        return F.when(fits, F.concat(F.substring(value, F.lit(1), span["start"]), F.substring(value, span["end"] + 1, F.length(value)))).otherwise(value)

    return F.coalesce(F.aggregate(later_first, text, cut), text)


def reply_text(blocks: Column) -> Column:
    """The text blocks of a reply in a row."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["value"]), "")


def clean_formatting(text: Column) -> Column:
    text = F.regexp_replace(text, CITATION, "")
    for old, new in DELIMITERS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(text, "  +", " "))


def normalize_echo(text: Column) -> Column:
    return F.translate(text, CYRILLIC, LATIN)


#: Pattern and replacement, in order: how inline math reads as plain text.
PLAIN_STEPS = (
    (r"\\text\s*\{([^}]*)\}", "$1"),
    (r"\\frac\s*\{([^}]*)\}\{([^}]*)\}", "$1/$2"),
    (r"\\sqrt\s*\{([^}]*)\}", "√$1"),
    (r"\\[a-zA-Z]+", ""),
    (r"[{}_\\^]", ""),
    (r"\s+", " "),
)


def latex_to_plain(latex: Column) -> Column:
    for pattern, to in PLAIN_STEPS:
        latex = F.regexp_replace(latex, "(?U)" + pattern, to)
    return strip(latex)


#: Python writes a group as \\1 where Java writes $1.
_STEPS = [(re.compile(p), to.replace("$", "\\")) for p, to in PLAIN_STEPS]
_SCRIPTS = str.maketrans(CYRILLIC, LATIN)
#: Display math, an inline formula, or what follows a dollar sign that none closes.
_PART = re.compile(r"\$\$.*?\$\$|\$\$.*|\$([^$]*)\$|\$[^$]*\Z", re.S)


def _plain(inner: str) -> str:
    for pattern, to in _STEPS:
        inner = pattern.sub(to, inner)
    return inner.strip()


def drop_echo(text: str | None) -> str | None:
    """Without the plain copy right behind an inline formula, whichever look-alike letters it has.

    A copy counts if it has 1 to 60 characters and ends where its token ends:
    before no letter or digit, or where the script changes at U+0400.
    """
    if not text or "$" not in text:
        return text
    out, at = [], 0
    while m := _PART.search(text, at):
        out.append(text[at : m.end()])
        at = m.end()
        plain = _plain(m[1]) if m[1] is not None else ""
        end = at + len(plain)
        if 1 <= len(plain) <= 60 and text[at:end].translate(_SCRIPTS) == plain.translate(_SCRIPTS):
            after = text[end : end + 1]
            if not after.isalnum() or (plain[-1] < "Ѐ") != (after < "Ѐ"):
                at = end
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def remove_latex_echoes(text: pd.Series) -> pd.Series:
    """A scan whose look-ahead depends on the data: the one function here that columns can't express."""
    return text.map(drop_echo)


#: Fixed value: a short name with a decimal number, twice in a row.
PLAIN_ECHO = r"([A-ZА-ЯЁa-zа-яё]{1,5}\s*=\s*\d+[,.]\d+)\s*\1"


def remove_plain_echoes(text: Column) -> Column:
    # Without an equals sign there is nothing to find, and the pattern is slow at not finding it.
    return F.when(F.contains(text, F.lit("=")), F.regexp_replace(text, "(?U)" + PLAIN_ECHO, "$1")).otherwise(text)


def clean_outside_math(text: Column, mode: str = "strict") -> Column:
    """Outside math, ``strict`` drops braces only; ``intended`` also reads {,} as a comma, and \\text{x} as x, and drops commands."""
    if mode == "strict":
        return F.regexp_replace(text, MATH_OR_BRACE, "$1")
    math = r"(\$\$[\s\S]*?\$\$|\$\$[\s\S]*|\$[^$]+\$|\$[^$]*)"
    for pattern, to in ((r"\{(,)\}", "$1$2"), (r"\\text\s*\{\s*([^}]*)\}", "$1$2"), (r"\\[a-zA-Z]+()", "$1$2")):
        text = F.regexp_replace(text, f"{math}|{pattern}", to)
    return F.regexp_replace(text, MATH_OR_BRACE, "$1")


def clean_answer(text: Column, mode: str = "strict") -> Column:
    """The whole chain behind the cutting of annotations."""
    return clean_outside_math(remove_plain_echoes(remove_latex_echoes(clean_formatting(text))), mode)


def display_text(raw: Column) -> Column:
    """What the client shows; as there, display delimiters lose one of their signs."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), CITATION, "")
    for old, _ in DELIMITERS:
        text = F.replace(text, F.lit(old), F.lit("$"))
    text = F.regexp_replace(text, r"([^\n])\$\$", "$1\n\\$")
    text = F.regexp_replace(text, r"\$\$([^\n])", "\\$\n$1")
    # A dollar sign before or behind protects {,}, however far away: so only texts without one change.
    text = F.when(F.contains(text, F.lit("$")), text).otherwise(F.replace(text, F.lit("{,}"), F.lit(",")))
    return strip(F.regexp_replace(text, "\n{4,}", "\n\n\n"))
