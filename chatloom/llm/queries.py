"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_dedup, cube_mix, divergence, drake_kmeans, katz, mpeg_audio, ngram_join, page_wrappers, paragraph_dedup, passages, shards, token_files, weak_quality
from .runtime import free_shuffles, scratch, table, whole_text

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of each document's identifiers, of what they decode to, and of their offsets."""
    coded = bpe.encode(docs, RANKS, PATTERN, offsets=True, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("offsets").alias("offsets_hash"),
    )


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = "read"
    return mpeg_audio.read_media(mpeg_audio.store_texts(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        "n_bytes",
        F.length(f"{r}.payload").cast("long").alias("payload_bytes"),
        F.sha2(f"{r}.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(f"{r}.payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string(
            "mpeg%s layer%d %dHz %dch frames=%d us=%d kbits=%d bad=%d skipped=%d table=%s:%d:%d seek=%s",
            f"{r}.version", f"{r}.layer", f"{r}.rate", f"{r}.channels", f"{r}.frames", f"{r}.duration_us", f"{r}.kbits", f"{r}.bad_crc", f"{r}.skipped",
            f"{r}.table_kind", f"{r}.table_frames", f"{r}.table_bytes", F.hex(F.xxhash64(f"{r}.offsets")),
        ).alias("feature"),
        F.col(f"{r}.samples").alias("samples"),
        F.col(f"{r}.rate").alias("rate"),
        F.col(f"{r}.duration_us").alias("duration_us"),
        F.size(f"{r}.offsets").cast("long").alias("seek_points"),
        F.col(f"{r}.offsets").alias("seek_offsets"),
    )


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents"))


#: The free identifier behind the vocabulary.
END_OF_DOCUMENT = 50256


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN, END_OF_DOCUMENT)


ARRIVALS = 4


def op5_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, scratch(spark, "shards"))
    for arrival in shards.arrivals(docs, ARRIVALS):
        store.append(arrival)
        store.compact()
    store.compact_all()
    store.expire()
    text = whole_text()
    return store.read(docs.schema).select("doc_id", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    scores, _ = katz.katz(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf_dir, "documents"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat as wholes (para is set), and exact runs of 40 words and more in any lines (start_word is set)."""
    docs = table(spark, sf_dir, "documents")
    spans = passages.repeated_passages(docs)
    free_shuffles(spark)
    return paragraph_dedup.repeated_paragraphs(docs).unionByName(spans, allowMissingColumns=True).drop("text_hash")


def op11_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake_kmeans.cluster(table(spark, sf_dir, "embeddings")).drop("measured")


def op12_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrappers.extract(table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mpeg_audio": op2_mpeg_audio,
    "op3_weak_quality": op3_weak_quality,
    "op4_separator_scan": op4_separator_scan,
    "op5_shard_compaction": op5_shard_compaction,
    "op6_katz_backoff": op6_katz_backoff,
    "op7_cube_mix": op7_cube_mix,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_paragraph_dedup": op10_paragraph_dedup,
    "op11_drake_clusters": op11_drake_clusters,
    "op12_page_wrappers": op12_page_wrappers,
    "op13_source_divergence": op13_source_divergence,
}

OP8_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

#: Compaction loses and changes nothing.
OP5_SQL = """
SELECT doc_id, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

#: A full scan in every round; no bounds.
_NEAREST = """a{n} AS MATERIALIZED (SELECT vec_id, any_value(x.v) AS v, min({{'d': d, 'c': c}}).c AS cluster, min(d) AS distance FROM (
    SELECT e.row, e.vec_id, e.v, c.c AS c, list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, c{n} c) x GROUP BY x.row, vec_id)"""
_MOVED = """s{m} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
c{m} AS MATERIALIZED (SELECT c, coalesce((SELECT list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) FROM s{m} WHERE cluster = c), v) AS v FROM c{n})"""
OP11_SQL = (
    """
WITH e AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY name, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS name, v FROM e ORDER BY name, v LIMIT 16)),
"""
    + ",\n".join(_NEAREST.format(n=n) + ("" if n == 3 else ",\n" + _MOVED.format(n=n, m=n + 1)) for n in range(4))
    + """
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       (SELECT sha256(array_to_string(v, ',')) FROM c3 WHERE c = cluster) AS centroid_sha256
FROM a3
"""
)

#: All kept terms of all sources, zero counts included; no index.
OP13_SQL = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
o AS MATERIALIZED (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v))::BIGINT AS q
    FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
pair AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op5_shard_compaction": OP5_SQL,
    "op8_chunk_dedup": OP8_SQL,
    "op11_drake_clusters": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
