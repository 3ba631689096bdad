"""Signed key-value strings: parsing, the base string, and the signature."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import once

#: The fields of a user, and the word that signing begins with.
SIGNING_WORD = b"WebAppData"
USER = "id BIGINT, first_name STRING, last_name STRING, username STRING, language_code STRING, is_premium BOOLEAN, photo_url STRING"


def pairs(raw: Column) -> Column:
    """Map of decoded keys to decoded values, the first value of a key winning; a part without ``=`` is a key with an empty value."""
    parts = F.filter(F.split(raw, "&"), lambda p: p != "")
    value = lambda p: F.when(F.contains(p, F.lit("=")), _decode(F.substr(p, F.instr(p, "=") + 1))).otherwise("")
    entries = F.transform(parts, lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("key"), value(p).alias("value")))
    # Each part is decoded once: named inside a lambda, the entries would be decoded anew for each of them.
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(entries, none, lambda m, x: F.when(F.map_contains_key(m, x["key"]), m).otherwise(F.map_concat(m, F.create_map(x["key"], x["value"]))))


def _decode(text: Column) -> Column:
    """Percent-decoded UTF-8, plus signs as spaces. A % that no two hex digits follow stays one; bytes that are no UTF-8 become U+FFFD."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def user(values: Column) -> Column:
    """The user of parsed values, null where it isn't JSON with an id and a first name.

    The value was decoded once with the string; what is still encoded in it is
    decoded again, where a plus sign stays one.
    """
    again = _decode(F.replace(values["user"], F.lit("+"), F.lit("%2B")))
    return once(F.from_json(again, USER), lambda u: F.when(u["id"].isNotNull() & u["first_name"].isNotNull(), u))


def base_string(values: Column) -> Column:
    """All pairs but the hash, by key, one a line."""
    rest = F.filter(F.map_entries(values), lambda e: e["key"] != "hash")
    return F.array_join(F.transform(F.array_sort(rest), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")


def signature(bot_token: str):
    """HMAC-SHA256 chain over the base string; Spark has no keyed hash of its own."""
    key = hmac.new(SIGNING_WORD, bot_token.encode(), hashlib.sha256).digest()

    @F.pandas_udf(T.StringType())
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return sign


def resolve_id(validated: Column, header: Column, parsed: Column) -> Column:
    """Whose request it is: the signed user, else the header, else the unsigned user, else the guest 0."""
    from . import int_or_null

    return F.coalesce(validated, int_or_null(header), parsed, F.lit(0).cast("bigint"))
