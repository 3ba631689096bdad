"""From documents to token counts: the stages of a training-data pipeline.

Quality, exact copies, near copies, mixing, encoding. Each stage reads what the
one before it kept; all but the last return the columns of documents, whatever
other columns there are. In all stages null text is empty, a null id is an id
behind all others, an empty table gives an empty result, and texts are whole,
however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import chunk_dedup, cube_mix, minhash, queries, weak_quality
from chatloom.llm.runtime import SPACES, cut, table, whole_text

#: Decisions that may be broadcast, at some 100 bytes each; more are joined by a shuffle.
FEW = 200_000


def _joined(docs: DataFrame, decisions: DataFrame, keys: list, how: str) -> DataFrame:
    """docs with the columns k0, k1 of keys joined null-safely to those of decisions."""
    decisions = cut(decisions, "decisions")
    if decisions.count() <= FEW:
        decisions = F.broadcast(decisions)
    marked = docs.select(F.struct(*docs.columns).alias("row"), *[k.alias(f"d{i}") for i, k in enumerate(keys)])
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"d{i}").eqNullSafe(F.col(f"k{i}"))
    return marked.join(decisions, on, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer keeps. Equal texts share their fate; texts without words get the scorer's bias."""
    return weak_quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest doc_id. Of rows that repeat its id and text, the one with the smallest other columns."""
    found = cut(chunk_dedup.exact_dedup(docs), "exact")
    text = F.sha2(F.encode(F.regexp_replace(whole_text(), SPACES, " "), "UTF-8"), 256)
    keys = [F.col("doc_id"), text]
    gone = found.filter("not kept").select(F.col("doc_id").alias("k0"), F.col("text_sha256").alias("k1")).distinct()
    left = _joined(docs, gone, keys, "left_anti").select("row.*")
    # Rows that repeat the id of the row that stays, too.
    again = cut(found.filter("kept").groupBy(F.col("doc_id").alias("k0"), F.col("text_sha256").alias("k1")).count().filter("count > 1").drop("count"), "repeats")
    if again.isEmpty():
        return left
    left = cut(left, "with-repeats")
    several = _joined(left, again, keys, "left_semi").select("d0", "d1", "row").groupBy("d0", "d1").agg(F.min("row").alias("row")).select("row.*")
    return _joined(left, again, keys, "left_anti").select("row.*").unionByName(several)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect: the one with the smallest doc_id, then text hash. Rows that repeat both stay together."""
    units = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(whole_text()).alias("text_hash")).alias("id"), "text")
    gone = minhash.near_duplicates(units).filter("id != class_id").select(F.col("id.doc_id").alias("k0"), F.col("id.text_hash").alias("k1"))
    return _joined(docs, gone, [F.col("doc_id"), F.xxhash64(whole_text())], "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that repeat id and text are taken alike, as often as the luckiest of them."""
    ids = docs.select(F.struct("doc_id", F.xxhash64(whole_text()).alias("text_hash")).alias("id"), "text", "source")
    taken = cube_mix.mix(ids, id_col="id").filter("copies > 0").groupBy(F.col("doc_id.doc_id").alias("k0"), F.col("doc_id.text_hash").alias("k1")).agg(F.max("copies").cast("int").alias("copies"))
    joined = _joined(docs, taken, [F.col("doc_id"), F.xxhash64(whole_text())], "inner")
    return joined.withColumn("n", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def token_counts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the identifiers of every document in the mix, a row for each row."""
    return queries.token_digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", token_counts),
]

#: Weak labels, MinHash and sampling have no SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
