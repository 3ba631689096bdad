"""Column functions of the chat service."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once for each row, however often ``use`` names it and inside whatever lambda."""
    return F.transform(F.array(value), use)[0]


def prefix(text: Column, n: int) -> Column:
    """The first n characters; shorter text as it is."""
    return F.substring(text, 1, n)


def first_nonempty(*values: Column) -> Column:
    """The first value that is neither null nor empty; the last as it is."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


#: All white space of Unicode, and the separators 28 to 31.
WHITE_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at either end, in one pass from each end."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def display_name(first: Column, last: Column, uid: Column) -> Column:
    full = strip(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
    return first_nonempty(full, F.concat(F.lit("User "), uid.cast("string")))


def remaining(limit: Column, used: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), limit - F.coalesce(used, F.lit(0)))


def int_or_null(text: Column) -> Column:
    """The integer that the text is, white space around it and a sign allowed, else null."""
    bare = strip(text)
    return F.when(bare.rlike("^[+-]?[0-9]+$"), bare.try_cast("bigint"))


def id_set(text: Column) -> Column:
    """The distinct integers of a comma list; other entries don't count."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), int_or_null), lambda x: x.isNotNull()))


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), "\r\n", ""))


def append_query(url: Column, query: Column) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), query)


def input_badge(kind: Column) -> Column:
    return F.when(kind == "audio", "🎤 ").when(kind == "image", "📷 ").otherwise("")


def is_expired(auth_date: Column, as_of: Column, seconds: int = 86_400) -> Column:
    """Older than a day at ``as_of``; a missing date is 0, a later one is accepted."""
    return (as_of - F.coalesce(auth_date, F.lit(0))) > seconds
