"""Schema versions: an ordered log of steps, and rows of any version read as those of another through one projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Add:
    """A new column, with a value for rows of before; going down, it is lost."""

    name: str
    kind: str
    value: object = None

    def up(self, c: dict[str, Column]) -> dict[str, Column]:
        return c | {self.name: F.lit(self.value).cast(self.kind)}

    def down(self, c: dict[str, Column]) -> dict[str, Column]:
        return {k: v for k, v in c.items() if k != self.name}


@dataclass(frozen=True)
class Drop:
    """A column goes; going down, it comes back empty."""

    name: str
    kind: str

    def up(self, c: dict[str, Column]) -> dict[str, Column]:
        return {k: v for k, v in c.items() if k != self.name}

    def down(self, c: dict[str, Column]) -> dict[str, Column]:
        return c | {self.name: F.lit(None).cast(self.kind)}


@dataclass(frozen=True)
class Rename:
    old: str
    new: str

    def up(self, c: dict[str, Column]) -> dict[str, Column]:
        return {self.new if k == self.old else k: v for k, v in c.items()}

    def down(self, c: dict[str, Column]) -> dict[str, Column]:
        return {self.old if k == self.new else k: v for k, v in c.items()}


@dataclass(frozen=True)
class Backfill:
    """Nulls of a column become a value; going down, they stay filled."""

    name: str
    value: object

    def up(self, c: dict[str, Column]) -> dict[str, Column]:
        return {k: F.coalesce(v, F.lit(self.value)) if k == self.name else v for k, v in c.items()}

    def down(self, c: dict[str, Column]) -> dict[str, Column]:
        return c


@dataclass(frozen=True)
class Split:
    """Some columns move to a table of their own, under the row's key; going down, they come back by it."""

    table: str
    key: str
    names: tuple[str, ...]

    def up(self, c: dict[str, Column]) -> dict[str, Column]:
        return {k: v for k, v in c.items() if k not in self.names}

    def down(self, c: dict[str, Column]) -> dict[str, Column]:
        raise LookupError(f"rows need their part in {self.table}: join it first (see History.read)")


Step = Add | Drop | Rename | Backfill | Split


class History:
    """Steps by version: steps[n] lead from version n to n + 1.

    Steps that change columns alone fold into one expression for each column, so
    reading an old version costs a projection, whatever the number of steps, and
    columns that are dropped later aren't read.
    """

    def __init__(self, *steps: tuple[Step, ...]):
        self.steps = steps

    @property
    def newest(self) -> int:
        return len(self.steps)

    def _between(self, start: int, stop: int) -> list[tuple[Step, bool]]:
        """(step, whether up) from one version to the other."""
        if start <= stop:
            return [(s, True) for version in self.steps[start:stop] for s in version]
        return [(s, False) for version in reversed(self.steps[stop:start]) for s in reversed(version)]

    def read(self, df: DataFrame, version: int, target: int | None = None, parts: dict[str, DataFrame] | None = None) -> DataFrame:
        """Rows of a version as those of another one, the newest if none is named.

        Going down over a Split needs its table in parts (by the same key and
        columns as it has in the version behind the split); rows without a part
        have nulls.
        """
        path = self._between(version, self.newest if target is None else target)
        columns = {c: F.col(f"`{c}`") for c in df.columns}
        for step, up in path:
            if isinstance(step, Split) and not up:
                df = df.select(*[v.alias(k) for k, v in columns.items()])
                part = (parts or {}).get(step.table)
                if part is None:
                    step.down(columns)
                df = df.join(part.select(step.key, *step.names), step.key, "left")
                columns = {c: F.col(f"`{c}`") for c in df.columns}
            else:
                columns = (step.up if up else step.down)(columns)
        return df.select(*[v.alias(k) for k, v in columns.items()])

    def part(self, df: DataFrame, version: int, table: str) -> DataFrame:
        """What rows of a version before a split have in the table that it makes."""
        columns = {c: F.col(f"`{c}`") for c in df.columns}
        for step, _ in self._between(version, self.newest):
            if isinstance(step, Split) and step.table == table:
                return df.select(*[columns[c].alias(c) for c in (step.key, *step.names)])
            columns = step.up(columns)
        raise LookupError(f"no step behind version {version} makes {table}")

    def read_all(self, versions: dict[int, DataFrame]) -> DataFrame:
        """Rows of several versions side by side, as those of the newest one."""
        return reduce(DataFrame.unionByName, [self.read(df, n) for n, df in versions.items()])
