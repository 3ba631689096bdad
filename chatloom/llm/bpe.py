"""Byte-level BPE over Arrow batches with the tokenizers library's BPE model.

The model's alphabet is 256 printable characters, one for each byte. A text is
split by the vocabulary's pattern, each piece is written in that alphabet and
merged by the model; decoding turns the alphabet's characters back into bytes.
Pieces repeat, so each worker keeps a cache of what the model has answered,
bounded in bytes; it changes speed, never results. Merges are worked out once on
the driver and broadcast with the vocabulary, whose file bounds their size.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.models import BPE

from .runtime import arrow_batches, spread, whole_text

#: Bytes each of a worker's two caches may hold, with some ENTRY bytes for each entry's objects.
CACHE, ENTRY = 24 << 20, 180
#: Where a space may not part two pieces: white space, a space, then white space or the end.
_RUN = re.compile(r"\s (?!\S)")
#: White space as the vocabulary's own library has it: the Unicode property.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The character for each byte: itself where printable in Latin-1, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of more than one byte, in order of rank.

    The pair is what is left of the token's bytes when only lower ranks merge.
    """
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Vocabulary(NamedTuple):
    """Tokens spelled in the alphabet, by identifier and separated by line feeds, and the identifiers that merge, in order."""

    spelled: str
    merges: bytes


@functools.lru_cache(maxsize=4)
def vocabulary(ranks_path: str) -> Vocabulary:
    ranks, alphabet = read_ranks(ranks_path), byte_alphabet()
    table = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = "".join(alphabet[b] for b in token)
    pairs = [(ranks[a], ranks[b]) for a, b in merges_of(ranks)]
    return Vocabulary("\n".join(table), np.array(pairs, np.int32).tobytes())


class _Known(dict):
    """A bounded cache: asks ``make`` for what it lacks and keeps it while there is room."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if self.room > 0 and len(key) < 64:
            self.room -= ENTRY + 2 * len(key) + len(value)
            self[key] = value
        return value


#: Tokens whose bytes are looked at in one go: so that no text needs arrays of eight times its length.
PIECE = 1 << 16


def _pieces(ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first token, last token + 1, first byte, last byte + 1) of each piece."""
    for s in range(0, len(ends), PIECE):
        e = min(s + PIECE, len(ends))
        yield s, e, int(ends[s - 1]) if s else 0, int(ends[e - 1])


class Decoder:
    """Turns identifiers back into bytes by the reversed byte alphabet."""

    def __init__(self, v: Vocabulary):
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        table = [bytes(map(byte.__getitem__, token)) for token in v.spelled.split("\n")]
        self._lens = np.array([len(t) for t in table], np.int64)
        self._starts = np.cumsum(self._lens) - self._lens
        self._blob = np.frombuffer(b"".join(table), np.uint8)

    def flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all identifiers in a row, and where each one's bytes end."""
        lens = self._lens[ids]
        ends = np.cumsum(lens)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        for s, e, low, high in _pieces(ends):
            first = self._starts[ids[s:e]] - (ends[s:e] - lens[s:e] - low)
            out[low:high] = self._blob[np.arange(high - low) + np.repeat(first, lens[s:e])]
        return out, ends

    def decode(self, ids) -> bytes:
        return self.flat(np.asarray(ids, np.int64))[0].tobytes()

    def spans(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Character spans [start, end) of the tokens whose bytes end there, a row for each.

        A token that holds a part of a character spans the whole character, so
        neighbours that split one character overlap there.
        """
        out, before = np.empty((len(ends), 2), np.int32), 0
        for s, e, low, high in _pieces(ends):
            char = before + np.cumsum((data[low:high] & 0xC0) != 0x80)  # 1-based character of each byte
            out[s:e, 0] = char[np.append(low, ends[s : e - 1]) - low] - 1
            out[s:e, 1] = char[ends[s:e] - 1 - low]
            before = int(char[-1])
        return out

    def offsets(self, ids) -> list[tuple[int, int]]:
        return [tuple(x) for x in self.spans(*self.flat(np.asarray(ids, np.int64))).tolist()]


class Codec(Decoder):
    """Encodes text to identifiers too, by the vocabulary's merges."""

    def __init__(self, v: Vocabulary, pattern: str, cache: int = CACHE):
        super().__init__(v)
        self._letters = dict(enumerate(byte_alphabet()))
        tokens = v.spelled.split("\n")
        pairs = np.frombuffer(v.merges, np.int32).reshape(-1, 2).tolist()
        self._model = BPE({t: i for i, t in enumerate(tokens) if t}, [(tokens[a], tokens[b]) for a, b in pairs], cache_capacity=0, ignore_merges=True)
        pattern = pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
        self._split = regex.compile(pattern).findall
        self._pieces = _Known(self._merge, cache)
        self._chunks = _Known(self._chunk, cache)
        self.vocab_size = len(tokens)

    def _merge(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self._letters)
        return np.array([t.id for t in self._model.tokenize(spelled)], np.int32).tobytes()

    def _join(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._split(text)))

    def _chunk(self, chunk: str) -> bytes:
        return self._join(" " + chunk)

    def encode(self, text: str) -> bytes:
        """Identifiers as little-endian int32.

        A piece starts at every space that no white space surrounds, so the text
        may be cut there and each cut-off chunk looked up as a whole.
        """
        if _RUN.search(text):
            return self._join(text)
        head, *rest = text.split(" ")
        return self._join(head) + b"".join(map(self._chunks.__getitem__, rest))


_OF_WORKER: dict[tuple, Decoder] = {}


def _shipped(spark: SparkSession, ranks_path: str, make: Callable[[Vocabulary], Decoder], *key) -> Callable[[], Decoder]:
    """For tasks: one codec or decoder per worker process, made from the broadcast vocabulary."""
    sent = spark.sparkContext.broadcast(vocabulary(ranks_path))
    key = (ranks_path, *key)

    def get() -> Decoder:
        if key not in _OF_WORKER:
            _OF_WORKER[key] = make(sent.value)
        return _OF_WORKER[key]

    return get


def codec(spark: SparkSession, ranks_path: str, pattern: str) -> Callable[[], Codec]:
    return _shipped(spark, ranks_path, lambda v: Codec(v, pattern), pattern)


def decoder(spark: SparkSession, ranks_path: str) -> Callable[[], Decoder]:
    return _shipped(spark, ranks_path, Decoder)


def _ends(sizes) -> pa.Array:
    return pa.array(np.cumsum([0, *sizes]).astype(np.int32))


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    offsets: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """doc_id, ids array<int> and, if asked for, offsets array<array<int>> (character spans) and decoded binary.

    decoded is what decode() gives for the ids, in the same pass. Null and empty
    texts give an empty list; repeated rows give repeated rows; an empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    source = spread(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")))
    id_type = source.schema["doc_id"].dataType.simpleString()
    get = codec(spark, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        for batch in batches:
            coded = [c.encode(t) for t in batch.column(1).to_pylist()]
            counts = _ends(len(x) // 4 for x in coded)
            flat = np.frombuffer(b"".join(coded), np.int32)
            out = {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(counts, pa.array(flat))}
            if offsets or decoded:
                data, ends = c.flat(flat.astype(np.int64))
                bounds = np.concatenate([[0], ends])[counts.to_numpy()]
            if offsets:
                spans, at = c.spans(data, ends), counts.to_numpy()
                # Characters are counted from the text's own first one.
                full = np.flatnonzero(np.diff(at))
                spans -= np.repeat(spans[at[full], 0], np.diff(at)[full])[:, None]
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(spans) + 1, 2, dtype=np.int32)), pa.array(spans.reshape(-1)))
                out["offsets"] = pa.ListArray.from_arrays(counts, pairs)
            if decoded:
                out["decoded"] = _binary(data, bounds)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = f"doc_id {id_type}, ids array<int>" + ", offsets array<array<int>>" * offsets + ", decoded binary" * decoded
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes that the identifiers spell.

    A list that begins or ends inside a character gives that character's part of
    the bytes; ``F.decode`` of whole lists gives back the text. Null gives null,
    an empty list no bytes; repeated rows are decoded one by one, an empty table
    gives an empty result.
    """
    source = encoded.select("doc_id", "ids")
    id_type = source.schema["doc_id"].dataType.simpleString()
    get = decoder(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = get()
        for batch in batches:
            lists = batch.column(1)
            flat, ends = c.flat(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data = _binary(flat, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)])
            if lists.null_count:
                data = pa.array([None if gone else x for gone, x in zip(lists.is_null().to_pylist(), data.to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, data], names=["doc_id", "ids", "decoded"])

    return source.mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded binary")
