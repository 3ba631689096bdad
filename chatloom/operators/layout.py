"""Tables laid out for reads by key: found by their files' ranges and filters, joined where they lie."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir


def keyed(df: DataFrame, path: str, owner: str, order: list[str], unique: list[str] = (), files: int = 32) -> DataFrame:
    """Write df in ranges of its owner, each sorted by owner and order, and read it back.

    The footer of each file has the range of owners in it, so a read of one owner
    opens the file or two that hold it; for each unique key there is a Bloom
    filter, so a read by such a key skips the parts that don't. An owner of many
    rows is parted by the order.
    """
    writer = df.repartitionByRange(files, owner, *order).sortWithinPartitions(owner, *order).write.mode("overwrite")
    for key in unique:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", "1000000")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Bucketed:
    """Parents and children dealt over the same buckets by one key, so that joins, groups and cascades of that key move nothing."""

    def __init__(self, spark: SparkSession, buckets: int = 32):
        self.spark, self.buckets, self.names = spark, buckets, []

    def put(self, df: DataFrame, key: str, *order: str) -> DataFrame:
        """df as a table of this layout. The key gets one name and type in all of them from the caller."""
        name = f"keyed_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/chatloom/{name}"
        df.repartition(self.buckets, key).write.option("path", path).bucketBy(self.buckets, key).sortBy(key, *order).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        """Take the tables' names from the catalogue; their files stay until the folder is cleared."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
