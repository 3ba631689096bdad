"""Similarity join of documents on the Jaccard similarity of their word n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import RECALL, SHINGLE, THRESHOLD, near_duplicates


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_class_links, n_shingles (see near_duplicates).

    Null and empty texts are their own class without links. Repeated rows link
    with each other. An empty table gives an empty result. Other columns are
    ignored.
    """
    units = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return near_duplicates(units, threshold, n, recall).withColumnRenamed("id", "doc_id")
