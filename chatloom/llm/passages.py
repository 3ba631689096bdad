"""Substring de-duplication: runs of 40 words and more that repeat word for word, wherever lines break.

So long is what edits leave of most passages of over 50 words; a run that short
is no accident either.

The paragraphs are all runs of ``least`` words of a text. Each is named by the
least hash among its shorter runs of ``gram`` words, a MinHash of one band, so
equal paragraphs have one name. Neighbours mostly share theirs: what travels is
a row for each change of the named run, with the hash of all the words that the
paragraphs of one name cover, its stretch. Equal stretches agree in all their
paragraphs. Only where one name has several stretches is one copy of each read
again and its paragraphs compared by 128-bit digests. No pairs are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .minhash import FEW
from .runtime import Steps, arrow_batches, spread, whole_text
from .words import Powers, mix, word_hashes

#: Words of the shortest passage, and of the runs that name it: the name is the least of LEAST - GRAM + 1 hashes.
LEAST, GRAM = 40, 16

#: Two bases, for the two halves of a digest; the first one's powers also hash grams and stretches.
_FIRST, _SECOND = Powers(), Powers(0xD1342543DE82EF95)


def _least_of(g: np.ndarray, n: int) -> np.ndarray:
    """Where the least of each n entries in a row stands, the first of equal ones."""
    at, size = np.arange(len(g)), 1
    while size < n:
        step = min(size, n - size)
        left, right = at[: len(at) - step], at[step:]
        at, size = np.where(g[right] < g[left], right, left), size + step
    return at


def stretches(h: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first paragraph, number of paragraphs, name, stretch) of each change of the run that names.

    h has the words of all texts, ends where each text's words begin and the
    last ones end. Paragraphs that would reach into the next text are left out.
    """
    n = len(h) - least + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = _FIRST.sums(h)
    at = np.arange(len(h) - gram + 1)
    # Mixed again, so that no property of the hash prefers one place to another.
    g = mix(_FIRST.hashes(sums, at, at + gram))
    least_at = _least_of(g, least - gram + 1)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:n]
    inside = np.arange(n) + least <= ends[text + 1]
    new = np.ones(n, bool)
    # By place, not by value: so no two paragraphs of one stretch are equal.
    new[1:] = (least_at[1:] != least_at[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    # A stretch ends before the next change, or where its text has no more paragraphs.
    stop = np.append(np.flatnonzero(new), n)
    stop = stop[np.searchsorted(stop, first, "right")]
    stop = np.minimum(stop, ends[text[first] + 1] - least + 1)
    return text[first], first - ends[text[first]], stop - first, g[least_at[first]], _FIRST.hashes(sums, first, stop + (least - 1))


def _named(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ends = word_hashes(batch.column(2))
            text, start, m, name, stretch = stretches(h, ends, least, gram)
            taken = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(start.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(stretch.view(np.int64))],
                names=["doc_id", "text_hash", "start", "m", "name", "stretch"],
            )

    return run


def _windows(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ends = word_hashes(batch.column(0))
            one, two = _FIRST.sums(h), _SECOND.sums(h)
            asked = batch.column(1)
            sizes = asked.value_lengths().to_numpy(zero_copy_only=False)
            rows = asked.flatten()
            start, m = rows.field("start").to_numpy().astype(np.int64), rows.field("m").to_numpy().astype(np.int64)
            begin = start + np.repeat(ends[:-1], sizes)
            for s in range(0, len(m), 1000):
                part = slice(s, s + 1000)
                counts = m[part]
                offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.repeat(begin[part], counts) + offset
                taken = pa.array(np.repeat(np.arange(s, s + len(counts)), counts))
                yield pa.RecordBatch.from_arrays(
                    [rows.field("name").take(taken), rows.field("stretch").take(taken), pa.array(offset.astype(np.int32))] + [pa.array(p.hashes(x, at, at + least).view(np.int64)) for p, x in ((_FIRST, one), (_SECOND, two))],
                    names=["name", "stretch", "offset", "h1", "h2"],
                )

    return run


def remove_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of the spans that ``found`` doesn't keep; all columns stay, whatever their names.

    Spans belong to an id and a text: of rows that repeat an id, each loses its
    own. Overlapping spans are one cut. With a cut word goes the white space
    behind it. A document without such a span keeps its very text, null included.
    """
    arrow_batches(docs.sparkSession)
    gone = found.filter("not kept").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(whole_text(text_col)).alias("row_hash"))
    joined = row.join(gone, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash")), "left")
    whole = joined.filter("spans is null").select("row.*")
    parted = joined.filter("spans is not null").select(F.coalesce(F.col(f"row.{text_col}"), F.lit("")).alias("text"), "spans", "row")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t, [(s["start_word"], s["n_words"]) for s in spans]) for t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = batch.column(2).flatten()
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return whole.unionByName(parted.mapInArrow(run, docs.schema))


_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    gone = np.zeros(max(s + n for s, n in spans), bool)
    for s, n in spans:
        gone[s : s + n] = True
    head = re.match(r"[\x20\x09-\x0D]*", text)[0]
    return head + "".join(w for k, w in enumerate(_WORD.findall(text)) if k >= len(gone) or not gone[k])


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, start_word, n_words, class_doc, class_word, n_links, kept: one row per span that repeats.

    A span is a longest run of words of which every ``least`` in a row stand, in
    the same order and distance, at the place (class_doc, class_word) where they
    come first in the table: by doc_id (nulls last), then by place. Words are
    what white space parts, counted from 0. n_links is the largest number of
    other places that one of its paragraphs stands at. Spans that are their own
    first place are kept; to remove the others loses no text. Spans may overlap.

    Rows that repeat both id and text give their spans once, but count as places.
    Of rows that repeat an id only, each has its own spans, told apart by
    text_hash, the xxhash64 of the text. Shorter, empty and
    null texts have none; an empty table gives an empty result. Other columns
    are ignored.
    """
    if not 0 < gram <= least:
        raise ValueError(f"runs of {gram} words in passages of {least}")
    spark = docs.sparkSession
    arrow_batches(spark)
    steps = Steps(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = whole_text(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    named = steps.cut(spread(source).mapInArrow(_named(least, gram), f"doc_id {id_type}, text_hash bigint, start int, m int, name bigint, stretch bigint"), "passage-names")

    # Written, so that the join with the many places of one name may be split over tasks.
    shared = steps.cut(named.groupBy("name").agg(F.count("*").alias("k")).filter("k > 1").drop("k"), "passage-shared")
    hits = steps.cut(named.join(shared, "name"), "passage-hits")
    place = F.struct(F.col("doc_id").isNull().alias("no_doc"), "doc_id", "text_hash", F.col("start").alias("at"))
    key = ["name", "stretch"]
    kinds = steps.cut(hits.groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("m").alias("m")), "passage-kinds")
    several = steps.cut(kinds.groupBy("name").agg(F.count("*").alias("k")).filter("k > 1").select("name"), "passage-several")

    # Paragraphs of the stretches that share their name with another one, read from one copy of each.
    asked = kinds.join(several, "name", "left_semi")
    copies = asked.groupBy(F.col("first.doc_id").alias("rep_id"), F.col("first.text_hash").alias("rep_hash")).agg(F.collect_list(F.struct("name", "stretch", F.col("first.at").alias("start"), "m")).alias("asked"))
    copies = steps.cut(copies, "passage-copies")
    copies = F.broadcast(copies.select("rep_id", "rep_hash")) if copies.count() <= FEW else copies.select("rep_id", "rep_hash")
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))
    # Rows that repeat an id and a text give one text.
    texts = source.join(copies, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = texts.join(spark.read.parquet(steps.paths[-1]), same).select("text", "asked")
    windows = steps.cut(texts.mapInArrow(_windows(least, gram), "name bigint, stretch bigint, offset int, h1 bigint, h2 bigint"), "passage-windows")
    from_first = F.struct("first.no_doc", "first.doc_id", "first.text_hash", (F.col("first.at") + F.col("offset")).alias("at"))
    windows = windows.join(kinds.select(*key, "n", "first"), key).select(*key, "offset", "h1", "h2", "n", from_first.alias("place"))
    windows = steps.cut(windows, "passage-places")
    firsts = windows.groupBy("h1", "h2").agg(F.sum("n").alias("places"), F.min("place").alias("first")).filter("places > 1")
    firsts = steps.cut(firsts, "passage-firsts")

    # Of each stretch, the parts that have one first place.
    doc = F.struct("first.no_doc", "first.doc_id", "first.text_hash")
    found = windows.join(firsts, ["h1", "h2"]).select(*key, "offset", "places", doc.alias("doc"), (F.col("first.at") - F.col("offset")).alias("shift"))
    line = Window.partitionBy(*key, "doc", "shift").orderBy("offset")
    found = found.withColumn("island", F.col("offset") - F.row_number().over(line)).groupBy(*key, "doc", "shift", "island").agg(F.min("offset").alias("offset"), F.count("*").cast("int").alias("m"), F.max("places").alias("places"))
    found = found.select(*key, "offset", "m", "doc", (F.col("shift") + F.col("offset")).alias("at"), "places")
    alone = kinds.filter("n > 1").join(several, "name", "left_anti").select(*key, F.lit(0).alias("offset"), "m", doc.alias("doc"), F.col("first.at").alias("at"), F.col("n").alias("places"))
    parts = steps.cut(found.unionByName(alone), "passage-parts")

    # Back to all places of a stretch; what goes on in the next stretch is one span.
    own = hits.select(*key, "doc_id", "text_hash", "start").distinct()
    own = own.join(parts.withColumnRenamed("doc", "class"), key).select("doc_id", "text_hash", "class", (F.col("start") + F.col("offset")).alias("start"), "m", "places", (F.col("at") - F.col("start") - F.col("offset")).alias("shift"))
    line = ["doc_id", "text_hash", "class", "shift"]
    order = Window.partitionBy(*line).orderBy("start")
    before = F.lag(F.col("start") + F.col("m")).over(order)
    spans = own.withColumn("new", F.when(before == F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    spans = spans.groupBy(*line, "island").agg(F.min("start").alias("start"), F.sum("m").alias("m"), F.max("places").alias("places"))
    return steps.end(
        spans.select(
            "doc_id",
            "text_hash",
            F.col("start").alias("start_word"),
            (F.col("m") + (least - 1)).cast("int").alias("n_words"),
            F.col("class.doc_id").alias("class_doc"),
            (F.col("start") + F.col("shift")).alias("class_word"),
            (F.col("places") - 1).alias("n_links"),
            (F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("text_hash") == F.col("class.text_hash")) & (F.col("shift") == 0)).alias("kept"),
        ),
        "passages",
    )
