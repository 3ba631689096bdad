"""An inverted index over texts: postings by term, read by the few buckets that a search names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dealt_parts
from ..storage import children, exists

#: Folders that terms are dealt over, and documents that one row of postings may hold.
BUCKETS, CHUNK = 64, 4096

#: Bytes of documents that one task indexes, and ranges of ids whose postings in a bucket lie in one file.
SHARE, RANGES = 8 << 20, 64

POSTINGS = "term string, chunk bigint, first bigint, n int, offsets array<int>, places array<array<int>>, segment bigint, bucket int"


def terms(text: Column) -> Column:
    """The runs of letters and digits of a text, in order and in lower case. No stemming: a term is found as it is written."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def nested(rows: DataFrame) -> DataFrame:
    """Postings with a list of places for each document, from one list in which -1 - place stands for each document's first: lists of short lists are large in a shuffle."""
    m = F.col("marked")
    starts = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i) < 0))
    own = lambda s, i: F.slice(m, s + 1, F.coalesce(F.get("starts", i + 1), F.size(m)) - s)
    places = F.transform("starts", lambda s, i: F.transform(own(s, i), lambda p: F.when(p < 0, -p - 1).otherwise(p)))
    return starts.select("term", "chunk", "first", "n", "offsets", places.alias("places"), "bucket")


class TokenIndex:
    """Postings of (id, text) rows in ``folder``, in segments that are added one by one and never written again.

    A row of postings holds a term's documents of one range of ids: the first
    id, how far behind it the others are, and the places of the term in each,
    from 0. So a frequent term has many rows and no task gets all of it. A
    segment's files lie in folders by bucket, sorted by term: a search reads the
    buckets of its terms, and of these files the parts that may hold them.

    Ids are whole numbers and expected to be unique; a document of an id that
    comes again, in the same or another segment, adds its places to those before.
    Rows without an id are not found, texts without terms are in no postings.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, chunk: int = CHUNK):
        self.spark, self.folder, self.buckets, self.chunk = spark, folder.rstrip("/"), buckets, chunk

    def add(self, docs: DataFrame, segment: int, id_col: str, *texts: str) -> None:
        """Index the first of some columns that isn't null, for each document; a segment that comes again takes the place of what it wrote before."""
        rows, parts = self.made(docs, id_col, *texts), dealt_parts(docs, SHARE)
        rows = rows.repartition(parts, F.col("bucket"), F.expr(f"chunk div {RANGES}")).sortWithinPartitions("bucket", "term", "chunk")
        nested(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/segment={segment}")

    def made(self, docs: DataFrame, id_col: str, *texts: str) -> DataFrame:
        """The postings of documents, not yet dealt over buckets, with the places of all documents in one list (see nested)."""
        rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(*texts).alias("text"))
        # Whole texts meet by ranges of ids: they are smaller than their terms, and then a range's postings are made where it lies, without moving a term.
        ranged = rows.withColumn("chunk", F.expr(f"(id - pmod(id, {self.chunk})) div {self.chunk}")).repartitionByRange(dealt_parts(docs, SHARE), "chunk")
        words = ranged.select("chunk", F.pmod("id", F.lit(self.chunk)).cast("bigint").alias("nth"), F.posexplode(terms(F.col("text"))).alias("place", "term"))
        # A number for each occurrence, the document's place in its range above the term's in the document: plain numbers are sorted fast and are smaller than structs.
        lists = words.groupBy("chunk", "term").agg(F.sort_array(F.collect_list(F.shiftleft("nth", 32) + F.col("place"))).alias("found"))
        nth = lambda x: F.shiftright(x, 32)
        place = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        least = nth(F.col("found")[0])
        same = lambda x, i: (i > 0) & (nth(F.get("found", i - 1)) == nth(x))
        return lists.select(
            "term",
            "chunk",
            (F.col("chunk") * self.chunk + least).alias("first"),
            F.array_distinct(F.transform("found", lambda x: (nth(x) - least).cast("int"))).alias("offsets"),
            F.transform("found", lambda x, i: F.when(same(x, i), place(x)).otherwise(-place(x) - 1)).alias("marked"),
            bucket_of(F.col("term"), self.buckets).alias("bucket"),
        ).withColumn("n", F.size("offsets"))

    def postings(self, *words: str) -> DataFrame:
        """The rows of some terms (of all, without any named); other buckets are not read."""
        whole = [n for n in children(self.spark, self.folder) if exists(self.spark, f"{self.folder}/{n}/_SUCCESS")]
        if not whole:
            return self.spark.createDataFrame([], POSTINGS)
        rows = self.spark.read.schema(POSTINGS).option("basePath", self.folder).parquet(*[f"{self.folder}/{n}" for n in whole])
        if not words:
            return rows
        numbers = self.spark.createDataFrame([(w,) for w in words], "term string").select(bucket_of(F.col("term"), self.buckets)).distinct().collect()
        return rows.filter(F.col("bucket").isin([n[0] for n in numbers]) & F.col("term").isin(list(words)))

    def found(self, *words: str) -> DataFrame:
        """(term, id, places) of some terms (of all, without any named)."""
        return _unrolled(self.postings(*words))

    def any_of(self, *words: str) -> DataFrame:
        """Ids of the documents that hold one of the terms."""
        return self.found(*_spelled(words)).select("id").distinct()

    def all_of(self, *words: str) -> DataFrame:
        """Ids of the documents that hold all terms."""
        words = _spelled(words)
        ids = _unrolled(_common_ranges(self.postings(*words), len(words)))
        return ids.groupBy("id").agg(F.count_distinct("term").alias("k")).filter(F.col("k") == len(words)).select("id")

    def phrase(self, *words: str) -> DataFrame:
        """Ids of the documents that hold the terms right behind each other."""
        spelled = _spelled(words, once=False)
        known = list(dict.fromkeys(spelled))
        rows = _unrolled(_common_ranges(self.postings(*known), len(known)))
        held = rows.groupBy("id").agg(*[F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("places")))).alias(f"p{i}") for i, w in enumerate(known)])
        starts = [_back(F.col(f"p{known.index(w)}"), n) for n, w in enumerate(spelled)]
        return held.filter(F.size(reduce(F.array_intersect, starts)) > 0).select("id")


def _spelled(words: tuple[str, ...], once: bool = True) -> list[str]:
    out = [w.lower() for w in words]
    if not out:
        raise ValueError("a search names a term at least")
    return list(dict.fromkeys(out)) if once else out


def _back(places: Column, n: int) -> Column:
    """Where a phrase begins of which this is the n-th term."""
    return F.transform(places, lambda p: p - n)


def _common_ranges(rows: DataFrame, k: int) -> DataFrame:
    """The postings of ranges of ids in which all k terms occur: others are left before any list is unrolled."""
    ranges = rows.groupBy("chunk").agg(F.count_distinct("term").alias("k")).filter(F.col("k") == k).select("chunk")
    return rows.join(ranges, "chunk", "left_semi")


def _unrolled(rows: DataFrame) -> DataFrame:
    at = F.arrays_zip(F.transform("offsets", lambda x: F.col("first") + x).alias("id"), F.col("places").alias("places"))
    return rows.select("term", F.explode(at).alias("x")).select("term", "x.id", "x.places")
