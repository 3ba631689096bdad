"""A table kept by merging partial results: what a batch adds up to is written under its number, and bases sum up the batches before them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import children, delete, exists

#: Batches that a reader merges at most before a new base sums them up.
EVERY = 20


class MergedTable:
    """Partial results in ``folder``, whose ``merge`` may take them in any order and number.

    A batch that comes again, because its job was lost before the stream noted
    it, overwrites what it wrote: so each counts once. A base stands only when
    its write is whole; until then, and while it is written again, readers take
    the base before it and the batches since. Nothing is kept in state that a
    watermark would drop, so rows count however late they are. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.spark, self.folder, self.schema, self.merge, self.every = spark, folder.rstrip("/"), schema, merge, every
        self.columns = spark.createDataFrame([], schema).columns

    def add(self, parts: DataFrame, number: int) -> None:
        """The partial result of batch ``number``; numbers go up by one and may come again."""
        parts.select(*self.columns).write.mode("overwrite").parquet(f"{self.folder}/batches/{number:012d}")
        if (number + 1) % self.every == 0:
            base, batches = self._standing(before=number)
            self._of(base, [*batches, number] if number not in batches else batches).write.mode("overwrite").parquet(f"{self.folder}/bases/{number:012d}")
            # The base before this one serves readers that began with it; those before that are done with.
            for old in self._bases():
                if base is not None and old < base:
                    delete(self.spark, f"{self.folder}/bases/{old:012d}")
            for old in self._batches():
                if base is not None and old <= base:
                    delete(self.spark, f"{self.folder}/batches/{old:012d}")

    def _bases(self) -> list[int]:
        return sorted(int(n) for n in children(self.spark, f"{self.folder}/bases") if exists(self.spark, f"{self.folder}/bases/{n}/_SUCCESS"))

    def _batches(self) -> list[int]:
        return sorted(int(n) for n in children(self.spark, f"{self.folder}/batches") if exists(self.spark, f"{self.folder}/batches/{n}/_SUCCESS"))

    def _standing(self, before: int | None = None) -> tuple[int | None, list[int]]:
        """The newest whole base (of a number below ``before``), and the batches behind it."""
        bases = [b for b in self._bases() if before is None or b < before]
        base = bases[-1] if bases else None
        return base, [n for n in self._batches() if base is None or n > base]

    def _of(self, base: int | None, batches: list[int]) -> DataFrame:
        paths = ([f"{self.folder}/bases/{base:012d}"] if base is not None else []) + [f"{self.folder}/batches/{n:012d}" for n in batches]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return self.merge(rows)

    def read(self) -> DataFrame:
        """The merged table as it stands now; it reads no input of the batches."""
        return self._of(*self._standing())

    def drain(self, rows: DataFrame, parts: Callable[[DataFrame], DataFrame]) -> None:
        """Take all that a stream has to give; a later call goes on where this one stopped."""
        query = rows.writeStream.foreachBatch(lambda batch, number: self.add(parts(batch), number))
        query.option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).start().awaitTermination()
