"""Rows as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
