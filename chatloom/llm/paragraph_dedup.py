"""Substring de-duplication: paragraphs that repeat, exactly or nearly, in any documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import RECALL, SHINGLE, THRESHOLD, near_duplicates
from .runtime import WORDS, whole_text

#: Words that a paragraph has at least: a passage of over 50 words with some lost to edits.
LEAST_WORDS = 40
#: Fewer hashes than documents get: 15 bands of 4 rows, with the same recall. There are many more
#: paragraphs, and what the shorter bands find in vain is compared exactly.
MOST_HASHES = 64


def paragraphs(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, para, text: the lines of at least so many words, para being the line's number from 0 and text_hash the whole text's."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_hash"), F.posexplode(F.split(whole_text(text_col), "\n")).alias("para", "text"))
    return lines.filter(F.regexp_count("text", F.lit(WORDS)) >= least_words)


def repeated_paragraphs(
    docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text_hash, para, class_doc, class_para, n_links, kept: one row per paragraph that another one repeats.

    A paragraph is a line of at least ``least_words`` words, ``para`` its number
    from 0 among all lines. Paragraphs whose shingle sets have the Jaccard
    similarity are linked; of each connected component the first (by doc_id,
    then text_hash, then para; null ids last) is kept and the others are to be
    removed. Within a document paragraphs count alike. Of rows that repeat an id,
    each has its own paragraphs, told apart by text_hash; rows that repeat the
    text as well have one fate. Null, empty and short texts have no paragraphs; an empty table gives
    an empty result. Other columns are ignored.
    """
    units = paragraphs(docs, least_words, id_col, text_col).select(F.struct(F.col("doc_id").isNull().alias("no_doc"), "doc_id", "text_hash", "para").alias("id"), "text")
    found = near_duplicates(units, threshold, n, recall, most_hashes=MOST_HASHES)
    return found.filter("n_links > 0").select(
        "id.doc_id", "id.text_hash", "id.para", F.col("class_id.doc_id").alias("class_doc"), F.col("class_id.para").alias("class_para"), "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def remove_paragraphs(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the paragraphs that ``found`` doesn't keep cut out of the text; all columns stay, whatever their names.

    Paragraphs belong to an id and a text: of rows that repeat an id, each loses
    its own. A document that loses no paragraph keeps its very text, null included.
    """
    gone = found.filter("not kept").groupBy("doc_id", "text_hash").agg(F.collect_set("para").alias("paras"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(whole_text(text_col)).alias("row_hash"))
    joined = row.join(gone, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash")), "left")
    left = F.filter(F.split(f"row.{text_col}", "\n"), lambda x, i: ~F.array_contains("paras", i))
    out = F.when(F.col("paras").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[out.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns])
