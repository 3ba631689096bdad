"""MPEG audio columns: frames are found again after garbage, tags and
variable-bitrate tables are read, checksums are verified, and exact durations
and the byte offset of every frame come out.

``store`` writes bytes as the ancillary data of silent Layer III frames, so any
binary can be kept losslessly in a valid stream and read back by ``read``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import arrow_batches, spread, whole_text

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1, layer), samples/s by version.
KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
#: Bits of a Layer II subband's allocation, as (bits, subbands) in a row: for low rates of MPEG-1 at 44.1 and 48 kHz, at 32 kHz, for others, and for MPEG-2.
ALLOCATED = {"c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "2": ((4, 4), (3, 7), (2, 19))}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
LENGTH_TAG = "payload_bytes"


class Header(NamedTuple):
    version: str
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    samples: int
    size: int
    side: int


@lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The frame header in four bytes, None if they aren't one (free format counts as none)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] < 0xE0:
        return None
    version, layer = VERSIONS.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    kbits, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or kbits in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    first, mono = version == "1", word[3] >> 6 == 3
    kbits, rate, padding = KBITS[first, layer][kbits - 1], RATES[version][rate], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if first or layer == 2 else 576
    size = (12000 * kbits // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // rate + padding
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(version, layer, not word[1] & 1, kbits, rate, mono, samples, size, side)


def _crc_entry(byte: int) -> int:
    crc = byte << 8
    for _ in range(8):
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


_CRC = [_crc_entry(b) for b in range(256)]


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of data, or of its first so many bits."""
    whole, left = divmod(8 * len(data) if bits is None else bits, 8)
    crc = 0xFFFF
    for byte in data[:whole]:
        crc = (crc << 8 & 0xFF00) ^ _CRC[crc >> 8 ^ byte]
    for k in range(left):
        bit = data[whole] >> 7 - k & 1
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if (crc >> 15) ^ bit else crc << 1 & 0xFFFF
    return crc


# Writing.


def _syncsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def _id3(values: dict[str, str]) -> bytes:
    frames = b""
    for key, value in values.items():
        body = b"\x00" + key.encode("latin-1") + b"\x00" + value.encode("latin-1")
        frames += b"TXXX" + len(body).to_bytes(4, "big") + b"\x00\x00" + body
    return b"ID3\x03\x00\x00" + _syncsafe(len(frames)) + frames


@lru_cache(64)
def _frame_start(kbits_index: int, protected: bool) -> tuple[bytes, int]:
    """Header, checksum and empty side information of an MPEG-1 Layer III mono frame at 44.1 kHz; bytes left in it."""
    word = bytes([0xFF, 0xFA | (not protected), kbits_index << 4, 0xC0])
    side = bytes(17)
    check = crc16(word[2:] + side).to_bytes(2, "big") if protected else b""
    start = word + check + side
    return start, header(word).size - len(start)


def store(payload: bytes) -> bytes:
    """A variable-bitrate stream that holds payload: tag, table frame, then as few frames as hold it."""
    room = [(_frame_start(i, True), i) for i in range(1, 15)]
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        start, space = next((s for s, _ in room if s[1] >= left), room[-1][0])
        frames.append(start + payload[at : at + space].ljust(space, b"\0"))
        at += space
    start, space = _frame_start(9, False)
    total = len(start) + space + sum(map(len, frames))
    ends, done = [], len(start) + space
    for f in frames:
        ends.append(done)
        done += len(f)
    toc = bytes(min(255, 256 * ends[k * len(frames) // 100] // total) for k in range(100)) if frames else bytes(100)
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return _id3({LENGTH_TAG: str(len(payload))}) + start + table.ljust(space, b"\0") + b"".join(frames)


# Reading.


def _syncsafe_of(b: bytes) -> int:
    return sum((x & 0x7F) << shift for x, shift in zip(reversed(b), (0, 7, 14, 21)))


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """Where audio may begin, and the user text fields in Latin-1 or UTF-8 of an ID3v2 tag."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    version, flags, size = data[3], data[5], _syncsafe_of(data[6:10])
    stop = min(10 + size + 10 * bool(flags & 0x10), len(data))
    body, out = data[10 : 10 + size], {}
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    wide = 4 if version > 2 else 3
    at = 0
    if flags & 0x40 and version > 2:
        at = _syncsafe_of(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    head = wide + (6 if version > 2 else 3)
    while at + head <= len(body) and body[at : at + wide].strip(b"\0"):
        n = body[at + wide : at + 2 * wide]
        length = _syncsafe_of(n) if version == 4 else int.from_bytes(n, "big")
        field = body[at + head : at + head + length]
        if body[at : at + wide] in (b"TXXX", b"TXX") and field[:1] in (b"\0", b"\3"):
            key, _, value = field[1:].decode("latin-1" if field[0] == 0 else "utf-8", "replace").partition("\0")
            out[key] = value.rstrip("\0")
        at += head + length
    return stop, out


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in the frame at ``at``; toc is the seek table, in 256ths of the bytes or as VBRI's steps in bytes."""
    x = at + 4 + 2 * h.protected + h.side
    number = lambda p, n=4: int.from_bytes(data[p : p + n], "big")
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, p, out = number(x + 4), x + 8, {"kind": data[x : x + 4].decode(), "frames": None, "bytes": None, "toc": None}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = number(p), p + 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    v = at + 36
    if data[v : v + 4] == b"VBRI":
        entries, scale, width = number(v + 18, 2), number(v + 20, 2), number(v + 22, 2)
        steps = [number(v + 26 + k * width, width) * scale for k in range(entries) if v + 26 + (k + 1) * width <= at + h.size]
        return {"kind": "VBRI", "bytes": number(v + 10), "frames": number(v + 14), "toc": steps}
    return None


def _allocated(h: Header) -> list[int]:
    """Bits of each subband's allocation in a Layer II frame."""
    each = h.kbits if h.mono else h.kbits // 2
    if h.version != "1":
        name = "2"
    elif each <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for bits, n in ALLOCATED[name] for _ in range(n)]


def _protected_bits(data: bytes, at: int, h: Header) -> int:
    """Bits behind the checksum that it covers.

    Layer III: the side information. Layer I: the bit allocation, whose subbands
    from the bound on both channels of joint stereo share. Layer II: that, and
    two bits for each channel and subband that has any.
    """
    if h.layer == 3:
        return 8 * h.side
    mode, extension = data[at + 3] >> 6, data[at + 3] >> 4 & 3
    widths = [4] * 32 if h.layer == 1 else _allocated(h)
    bound = min(len(widths), 4 * (extension + 1) if mode == 1 else len(widths))
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (channels * bound + 32 - bound)
    given = 0
    n = sum(widths[:bound]) * channels + sum(widths[bound:])
    bits = int.from_bytes(data[at + 6 : at + 6 + -(-n // 8)], "big") >> -n % 8
    p = n
    for k, width in enumerate(widths):
        for _ in range(channels if k < bound else 1):
            p -= width
            if bits >> p & ((1 << width) - 1):
                given += 1 if k < bound else channels
    return n + 2 * given


def _checksum(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a protected frame's checksum is right; None without one."""
    if not h.protected:
        return None
    n = 16 + _protected_bits(data, at, h)
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + -(-(n - 16) // 8)], n) == int.from_bytes(data[at + 4 : at + 6], "big")


def read(data: bytes | None) -> dict:
    """What a stream holds.

    payload: the bytes of all frames behind their side information, cut to the
    length that the tag names. Where a frame ends the next one begins, if there
    is a header of its kind that another one or the end follows, or whose
    checksum isn't wrong. At the start and after any other bytes, which are
    skipped and counted, both must hold; so a frame between garbage on both
    sides is garbage too, and a stream of one frame is that frame. A frame with a
    wrong checksum in the row of others still counts and is counted as bad.
    Checksums are verified in all layers. Free format isn't read. Null is read
    as an empty stream.
    """
    data = data or b""
    at, tags = _tags(data)
    stop = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    out = {"version": None, "layer": None, "rate": None, "channels": None, "samples": 0, "frames": 0, "bad_crc": 0, "skipped": 0, "table": None, "offsets": [], "kbits": 0}
    kind, bodies, in_step = None, [], False
    of = lambda h: (h.version, h.layer, h.rate)
    while at + 4 <= stop:
        h = header(data[at : at + 4])
        ok = h is not None and at + h.size <= stop and (kind is None or of(h) == kind)
        if ok:
            after = at + h.size
            follows = header(data[after : after + 4]) if after + 4 <= stop else None
            goes_on, right = after == stop or follows is not None and of(follows) == of(h), _checksum(data, at, h)
            ok = goes_on or right is not False if in_step else goes_on and right is not False
        in_step = ok
        if not ok:
            nxt = data.find(b"\xff", at + 1, stop)
            nxt = stop if nxt < 0 else nxt
            out["skipped"] += nxt - at
            at = nxt
            continue
        first = kind is None
        kind = of(h)
        if first:
            out.update(version=h.version, layer=h.layer, rate=h.rate, channels=1 if h.mono else 2)
            out["table"] = _table(data, at, h)
        if not (first and out["table"]):
            out["bad_crc"] += right is False
            out["offsets"].append(at)
            out["frames"] += 1
            out["samples"] += h.samples
            out["kbits"] += h.kbits
            bodies.append(data[at + 4 + 2 * h.protected + h.side : at + h.size])
        at += h.size
    if at < stop:
        out["skipped"] += stop - at
    payload = b"".join(bodies)
    length = tags.get(LENGTH_TAG, "")
    out["payload"] = payload[: int(length)] if length.isdigit() else payload
    return out


def padded(text: str, unit: int = 64) -> bytes:
    data = text.encode()
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media binary: each text padded to a positive multiple of 64 bytes, as a stream.

    Null text is empty and gives 64 zero bytes. Repeated rows give repeated rows,
    an empty table an empty result; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    source = spread(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([store(padded(t)) for t in texts], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


READ = (
    "payload binary, version string, layer int, rate int, channels int, frames bigint, samples bigint,"
    " duration_us bigint, kbits bigint, bad_crc bigint, skipped bigint, table_kind string, table_frames bigint,"
    " table_bytes bigint, offsets array<bigint>"
)


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The columns of ``media`` and, under ``read``, what ``read`` finds: a struct of the columns in READ.

    The duration is samples / rate seconds, exactly; duration_us is that rounded
    down. offsets has the byte at which each frame begins. Null media is an empty
    stream: no frames, null format. Repeated rows are read one by one, an empty
    table gives an empty result, columns may have any names but ``read``, which
    is refused.
    """
    if "read" in media.columns:
        raise ValueError("the table has a column named read")
    arrow_batches(media.sparkSession)
    names = media.columns
    fields = [f.strip().split(" ") for f in READ.split(",")]
    kinds = {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    arrow = pa.struct([(n, kinds[t]) for n, t in fields])
    schema = T.StructType([*media.schema.fields, T.StructField("read", T.StructType.fromDDL(READ))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(names.index(media_col)).to_pylist():
                r = read(data)
                t = r["table"] or {"kind": None, "frames": None, "bytes": None}
                r |= {"duration_us": r["samples"] * 1_000_000 // r["rate"] if r["rate"] else 0, "table_kind": t["kind"], "table_frames": t["frames"], "table_bytes": t["bytes"]}
                found.append({n: r[n] for n, _ in fields})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*names, "read"])

    return media.mapInArrow(run, schema)
