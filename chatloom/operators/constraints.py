"""Rows that break what a schema says of them: one pass for each table, and a shuffle only for keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dealt

#: Bytes of a table whose keys one task counts before they move.
SHARE = 8 << 20


@dataclass(frozen=True)
class Rules:
    """What holds for a table whose rows are named by ``key``.

    required columns aren't null; texts have at most so many characters; others
    have one of some values; no two rows agree in the columns of a unique key; a
    reference (columns, parent table, its columns) is found there. Null meets
    all but the first, as in SQL.
    """

    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)
    allowed: dict[str, tuple] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()

    def of_rows(self) -> dict[str, Column]:
        """Each constraint that a row alone can break, with the condition that it does."""
        out = {f"required {c}": F.col(c).isNull() for c in self.required}
        out |= {f"length {c}": F.length(c) > n for c, n in self.lengths.items()}
        return out | {f"allowed {c}": ~F.col(c).isin(list(v)) for c, v in self.allowed.items()}


#: What the service's own tables ask for (see sources.SCHEMAS).
SERVICE = {
    "users": Rules(("id",), ("id", "tg_uid"), {"username": 255, "display_name": 255, "language_code": 10}, {}, (("id",), ("tg_uid",))),
    "plans": Rules(("id",), ("id", "name"), {"name": 50, "type": 20}, {"type": ("free", "basic", "premium")}, (("id",), ("name",))),
    "subscriptions": Rules(
        ("id",), ("id", "user_id", "plan_id"), {"status": 20}, {"status": ("active", "expired", "cancelled")}, (("id",),), ((("user_id",), "users", ("id",)), (("plan_id",), "plans", ("id",)))
    ),
    "conversations": Rules(("id",), ("id", "user_id", "openai_thread_id"), {"openai_thread_id": 255, "title": 255}, {}, (("id",), ("openai_thread_id",)), ((("user_id",), "users", ("id",)),)),
    "messages": Rules(
        ("id",), ("id", "conversation_id", "role", "content"), {"role": 20, "input_type": 20}, {"role": ("user", "assistant"), "input_type": ("text", "audio", "image")}, (("id",),), ((("conversation_id",), "conversations", ("id",)),)
    ),
}


def _named(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def flagged(df: DataFrame, rules: Rules) -> DataFrame:
    """df with _broken: a bit for each constraint of rules.of_rows(), in their order. One pass, no shuffle."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(0).cast("bigint") for i, c in enumerate(rules.of_rows().values())]
    return df.withColumn("_broken", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("bigint")))


def violations(tables: dict[str, DataFrame], rules: dict[str, Rules]) -> DataFrame:
    """(table_name, key, rule, n): one row for each row and constraint of its own that it breaks, for each value that a unique key has
    several times (with how often), and for each value of a reference that its parent lacks (with the number of rows that name it).

    Keys are written as texts, their columns joined by |. The columns of keys
    and references are dealt out by all of them together, so each task counts a
    share of the rows, whatever their files look like, and a value that a third
    of all rows have is one row of each task before values meet. More than 63 constraints of rows are refused.
    """
    out = []
    for name, r in rules.items():
        df = tables[name]
        checks = list(r.of_rows())
        if len(checks) > 63:
            raise ValueError(f"{name} has {len(checks)} constraints of rows; a flag has 63 bits")
        if checks:
            broken = flagged(df, r).filter("_broken != 0")
            each = F.array_compact(F.array(*[F.when(F.col("_broken").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(checks)]))
            out.append(broken.select(F.lit(name).alias("table_name"), _named(r.key).alias("key"), F.explode(each).alias("rule"), F.lit(1).cast("bigint").alias("n")))
        named = dict.fromkeys([*r.key, *(c for columns in (*r.unique, *(x[0] for x in r.references)) for c in columns)])
        keyed = dealt(df.select(*named), *named, share=SHARE)
        for columns in r.unique:
            several = keyed.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
            out.append(several.select(F.lit(name).alias("table_name"), _named(columns).alias("key"), F.lit(f"unique {', '.join(columns)}").alias("rule"), "n"))
        for columns, parent, theirs in r.references:
            values = keyed.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
            known = tables[parent].select(*[F.col(b).alias(f"_{a}") for a, b in zip(columns, theirs)])
            on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in columns])
            lost = values.join(known, on, "left_anti")
            out.append(lost.select(F.lit(name).alias("table_name"), _named(columns).alias("key"), F.lit(f"reference {', '.join(columns)} to {parent}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, out)
