"""Where rows come from and go to: Parquet tables, literal rows, JSON bodies, binary files, JSON responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strip

#: Types of the service's own tables.
SCHEMAS = {
    "users": "id INT NOT NULL, tg_uid BIGINT NOT NULL, username STRING, display_name STRING, language_code STRING, is_active BOOLEAN, accepted_terms_at TIMESTAMP_NTZ, accepted_privacy_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "plans": "id INT NOT NULL, name STRING NOT NULL, type STRING, daily_queries INT, monthly_queries INT, price_monthly INT, price_yearly INT, features STRING, is_active BOOLEAN, created_at TIMESTAMP_NTZ",
    "subscriptions": "id INT NOT NULL, user_id INT NOT NULL, plan_id INT NOT NULL, status STRING, queries_used_today INT, queries_used_month INT, last_query_date TIMESTAMP_NTZ, started_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ, cancelled_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "conversations": "id INT NOT NULL, user_id INT NOT NULL, openai_thread_id STRING NOT NULL, title STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "messages": "id INT NOT NULL, conversation_id INT NOT NULL, role STRING NOT NULL, content STRING NOT NULL, input_type STRING, tokens_used INT, created_at TIMESTAMP_NTZ",
}


#: From here on a size is no estimate but says that there is none.
_UNKNOWN = 1 << 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planned_bytes(df: DataFrame) -> int:
    """What the plan's inputs hold, files by their size and other rows by their parts. Only the plan is asked, no job runs."""
    most = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        size = int(leaf.stats().sizeInBytes())
        if size < _UNKNOWN:
            total += size
        elif leaf.nodeName() == "LogicalRDD":
            total += leaf.rdd().getNumPartitions() * most
    return total


def planned_parts(df: DataFrame) -> int:
    """How many parts of a scan's usual size that is."""
    return max(1, -(-planned_bytes(df) // df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are so small that a scan wouldn't use them.

    For expressions that cost much more than moving the rows. Spark deals files
    out by its cost of opening one; below that for each core, there is less than
    a part for each.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < cores * spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() else df


#: What one Arrow batch holds at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds, whatever the lengths of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: Bytes of files whose rows one task gets where much is made of each.
SHARE = 1 << 20


def dealt_parts(df: DataFrame, share: int = SHARE) -> int:
    """As many tasks as give each that share of df's files, one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-planned_bytes(df) // share))


def dealt(df: DataFrame, *by: str, share: int = SHARE) -> DataFrame:
    """df over as many tasks as its size asks for, however few row groups its files have: those can't be parted in reading.

    For narrow rows that become many, or cost much more than moving them. They
    are dealt by the hash of some columns: in turn, each reading task would have
    to sort its rows first.
    """
    return df.repartition(dealt_parts(df, share), *by)


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32, **options) -> DataFrame:
    """A live table, read in ranges of its key by as many connections as ``parts``; rows outside the bounds go to the outer ranges."""
    options |= {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**{k: str(v) for k, v in options.items()}).load()


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def json_body(column: str, schema: str) -> Column:
    """A request body; null where it isn't JSON of that shape."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def valid_text(text: Column, most: int = 4000) -> Column:
    """A message of 1 to ``most`` characters."""
    return F.coalesce(F.length(text).between(1, most), F.lit(False))


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of uploads; content is read only where it is used. Spark lists no empty files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def media_messages(uploads: DataFrame, recognised: DataFrame, key: str) -> DataFrame:
    """uploads with the text that was recognised in each, and status 200, or 400 where there is none but white space.

    The bytes are joined to their texts, not the other way round: they stay
    where they lie as long as texts are few enough to be broadcast.
    """
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    return uploads.join(recognised.select(key, "text"), key, "left").withColumn("status", F.when(blank, 400).otherwise(200))


def json_response(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def write_responses(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
