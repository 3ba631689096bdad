"""Token counts from flat token files that carry no index.

A file is identifiers only, each document followed by the separator. It is read
in blocks of bounded size, by any number of tasks; a block finds its separators
with one vector comparison and reports how many there are, where the last one
stands, and where the documents that end in it end. Two prefix scans over these
reports, the sum of separators and the maximum of last positions, stitch what
crosses blocks: they give the number and the start of each block's first
document. The scans run in two levels, so that no task holds a file's blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, vocabulary
from .runtime import arrow_batches, cut, scratch, spread, whole_text

BLOCK_BYTES = 4 << 20
#: Blocks whose reports one task scans.
SPAN = 1024
#: Blocks that one task searches on average.
BLOCKS_PER_TASK = 32


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def width_for(vocab_size: int, separator: int) -> str:
    """The item type that holds every identifier of the vocabulary and the separator behind or between them."""
    return "<u2" if max(vocab_size - 1, separator) < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Tokenize and write one flat file per task; returns (file, length, ordinal, doc_id) rows and the item type.

    The rows only say which document went where; the files hold no trace of it.
    A task writes under a name of its own attempt and renames the file when it
    is whole, and only the rows of committed tasks name files, so lost or
    repeated tasks leave nothing that is read. Null and empty texts are empty
    documents: a separator alone. A separator that is an identifier of the
    vocabulary is refused, since a text could hold it.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    root = scratch(spark, "tokens")
    tokens = vocabulary(ranks_path).spelled.split("\n")
    if separator < 0 or separator < len(tokens) and tokens[separator]:
        raise ValueError(f"separator {separator} is an identifier of the vocabulary, or none at all")
    dtype = width_for(len(tokens), separator)
    get = codec(spark, ranks_path, pattern)
    source = spread(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task = get(), TaskContext.get()
        fs, folder = _place(root)
        fs.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.tokens"
        end = np.array([separator], dtype).tobytes()
        ids, size = [], 0
        with fs.open_output_stream(f"{folder}/.{name}") as out:
            for batch in batches:
                flat = b"".join(np.frombuffer(c.encode(t), np.int32).astype(dtype).tobytes() + end for t in batch.column(1).to_pylist())
                out.write(flat)
                size += len(flat)
                ids.append(batch.column(0))
        if not ids:
            fs.delete_file(f"{folder}/.{name}")
            return
        fs.move(f"{folder}/.{name}", f"{folder}/{name}")
        at = 0
        for part in ids:
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{root}/{name}"] * n), pa.array([size] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), part], names=["file", "length", "ordinal", "doc_id"]
            )
            at += n

    rows = source.mapInArrow(run, f"file string, length bigint, ordinal bigint, doc_id {kind}")
    return cut(rows, "token-file-rows"), dtype


def scan(files: DataFrame, separator: int, dtype: str, block_bytes: int = BLOCK_BYTES, span: int = SPAN) -> DataFrame:
    """file, ordinal, start, n_tokens, closed: the documents of flat files given as (file, length) rows.

    ``start`` counts identifiers. A document without its separator at a file's
    end has closed = false. Separators side by side are empty documents. Empty
    files hold none. A trailing part of an identifier is not read.
    """
    spark = files.sparkSession
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width
    blocks = files.filter(F.col("length") >= width).select(
        "file", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes).cast("int"))).alias("block")
    )
    # Blocks of some hundred megabytes to a task, however many there are.
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / block_bytes)), F.lit(0))).first()[0]
    blocks = blocks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCKS_PER_TASK)), "file", "block")
    arrow_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, block in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = _place(file)
                with fs.open_input_file(path) as f:
                    f.seek(block * block_bytes)
                    data = f.read(min(block_bytes, length - block * block_bytes))
                ids = np.frombuffer(data, dtype, len(data) // width)
                found = np.flatnonzero(ids == separator) + block * (block_bytes // width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int32()), pa.array([length // width], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["file", "block", "items", "at"]
                )

    reports = blocks.mapInArrow(run, "file string, block int, items bigint, at array<bigint>")
    reports = cut(
        reports.select("file", "block", "items", "at", F.size("at").cast("long").alias("n"), F.expr("if(size(at) > 0, at[size(at) - 1], null)").alias("last"), F.floor(F.col("block") / span).alias("part")),
        "token-reports",
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("file", "part").orderBy("block"))
    across = before(Window.partitionBy("file").orderBy("part"))
    parts = reports.groupBy("file", "part").agg(F.sum("n").alias("pn"), F.max("last").alias("pl")).select(
        "file", "part", F.coalesce(F.sum("pn").over(across), F.lit(0)).alias("n0"), F.coalesce(F.max("pl").over(across), F.lit(-1)).alias("l0")
    )
    stitched = reports.join(parts, ["file", "part"]).select(
        "file", "block", "items", "at", "n",
        (F.col("n0") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"),
        F.greatest("l0", F.max("last").over(inside)).alias("prev"),
    )
    # Ends of documents in this block, and where each one starts: behind the separator before it.
    closed = stitched.select("file", "first", "prev", "at", F.posexplode("at").alias("k", "end")).select(
        "file",
        (F.col("first") + F.col("k")).alias("ordinal"),
        F.expr("if(k = 0, prev, at[k - 1]) + 1").alias("start"),
        F.expr("end - if(k = 0, prev, at[k - 1]) - 1").alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    ends = reports.groupBy("file").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("prev"), F.max("items").alias("items"))
    rest = ends.filter("items > prev + 1").select("file", "ordinal", (F.col("prev") + 1).alias("start"), F.expr("items - prev - 1").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def count_documents(docs: DataFrame, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, start, closed for every row of docs, found by scanning the files written from it.

    Null and empty texts have no tokens; repeated rows are documents each; an
    empty table gives an empty result. Other columns are ignored.
    """
    rows, dtype = write_token_files(docs, ranks_path, pattern, separator, id_col, text_col)
    files = rows.groupBy("file").agg(F.max("length").alias("length"))
    found = scan(files, separator, dtype, block_bytes)
    return rows.select("file", "ordinal", "doc_id").join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "start", "closed")
