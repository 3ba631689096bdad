"""Byte-level BPE and MPEG audio against other implementations and round trips."""

import hashlib
import random
import sys
import zlib

import public_tokenizers
import pytest
import tiktoken

from chatloom.llm import bpe, mpeg_audio, queries

PATTERN = public_tokenizers.PATTERN
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary(RANKS), PATTERN)


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def ids(codec, text):
    import numpy as np

    return np.frombuffer(codec.encode(text), np.int32).tolist()


CASES = ["", " ", "  ", "a", " a", "a  b", "a \n b", "\n \nX", "a\n ", "it's we'll I'M", "x" * 3000, "é漢字🙂 ½Ⅷ", "a b 　c", "\x1c\x1d a", "<|endoftext|>", "a   b", "1234 5a_b --- !!", " \t \r\n\v\f z"]


def test_cases_equal_the_other_library(codec, other):
    for text in CASES:
        assert ids(codec, text) == other.encode_ordinary(text), repr(text)
        assert codec.decode(ids(codec, text)) == text.encode()


def test_every_character_equals_the_other_library(codec, other):
    chars = [chr(c) for c in range(0x3400) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3400, sys.maxunicode, 37) if not 0xD800 <= c < 0xE000]
    for c in chars:
        text = f"a{c}b {c} {c}{c}1"
        assert ids(codec, text) == other.encode_ordinary(text), hex(ord(c))


def test_random_white_space(codec, other):
    r = random.Random(1)
    for _ in range(4000):
        text = "".join(r.choice([" ", " ", "\n", "\t", "a", "Bc", "1", ".", " ", "é", "'s"]) for _ in range(r.randint(0, 14)))
        assert ids(codec, text) == other.encode_ordinary(text), repr(text)


def test_offsets_cover_the_text(codec):
    for text in CASES:
        spans = codec.offsets(ids(codec, text))
        assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
        assert all(a < b for a, b in spans) and all(y[0] <= x[1] for x, y in zip(spans, spans[1:]))
    assert codec.offsets(ids(codec, "ab cd")) == [(0, 2), (2, 5)]


def test_split_characters_and_pieces(codec, monkeypatch):
    """Tokens that end inside a character, and arrays in pieces of a few tokens."""
    text = "é漢字🙂 𒀀𒀁 ab½ " * 30
    whole = ids(codec, text)
    assert len(whole) > len(text) / 2 and any(len(codec.decode([i])) < len(codec.decode([i]).decode("utf-8", "replace").encode()) for i in whole)
    want = []
    at = 0
    for i in whole:
        n = len(codec.decode([i]))
        first, last = text.encode()[:at].decode("utf-8", "ignore"), text.encode()[: at + n]
        want.append((len(first), len(last.decode("utf-8", "ignore")) + (last.decode("utf-8", "ignore").encode() != last)))
        at += n
    for piece in (1, 7, 1 << 16):
        monkeypatch.setattr(bpe, "PIECE", piece)
        assert codec.decode(whole) == text.encode() and codec.offsets(whole) == want
        for k in range(len(whole)):
            assert codec.decode(whole[:k]) + codec.decode(whole[k:]) == text.encode()


def frame(spark, texts, **more):
    rows = [(i, t, "x", b"k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, media binary")


def test_queries_on_awkward_texts(spark, other):
    texts = [*CASES, None, "", "a", "long " * 40_000, "long " * 40_000]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in queries.token_digests(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = other.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.encode(docs, RANKS, PATTERN, offsets=True, decoded=True)
    apart = {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, RANKS).collect()}
    one = bpe.Codec(bpe.vocabulary(RANKS), PATTERN)
    for r in coded.collect():
        assert apart[r.doc_id] == bytes(r.decoded) == (texts[r.doc_id] or "").encode()
        assert [tuple(x) for x in r.offsets] == one.offsets(r.ids)
    assert bpe.encode(docs, RANKS, PATTERN, offsets=True).filter("doc_id = 3").first().offsets == [[0, 1]]
    assert queries.token_digests(docs.limit(0)).count() == 0


def test_media_round_trip(spark):
    texts = [*CASES, None, "z" * 64, "y" * 63, "w" * 5000, "long " * 40_000]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in mpeg_audio.read_media(mpeg_audio.store_texts(docs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        r = got[i]["read"]
        assert bytes(r.payload) == want and got[i].n_bytes == len(raw)
        assert r.bad_crc == r.skipped == 0 and r.samples == 1152 * r.frames == 1152 * r.table_frames
        assert r.table_bytes == len(got[i].media) - got[i].media.index(b"\xff\xfb")
        assert all(got[i].media[o] == 0xFF for o in r.offsets) and len(r.offsets) == r.frames
    assert mpeg_audio.read_media(mpeg_audio.store_texts(docs.limit(0))).count() == 0


def test_resynchronises_and_counts_bad_checksums():
    whole = mpeg_audio.store(bytes(3100))
    clean = mpeg_audio.read(whole)
    assert (clean["frames"], clean["bad_crc"], clean["skipped"]) == (4, 0, 0)
    second = clean["offsets"][1]
    r = mpeg_audio.read(whole[:second] + b"\xff\x00junk\xff\xfb" * 5 + whole[second:])
    assert r["frames"] == 4 and r["skipped"] == 40 and r["samples"] == clean["samples"]
    broken = bytearray(whole)
    broken[second + 8] ^= 1
    assert mpeg_audio.read(bytes(broken))["bad_crc"] == 1
    tail = mpeg_audio.read(whole + b"TAG" + bytes(125))
    assert tail["frames"] == 4 and tail["skipped"] == 0
    for junk in (None, b"", b"\xff", b"ID3", b"\xff\xfb" * 50, bytes(range(256)) * 4):
        assert mpeg_audio.read(junk)["frames"] == 0


def plain_frames(data):
    """A second reader: all offsets from which frames of one kind follow each other up to the end, by the formula of the standard."""
    rates, kbits = (44100, 48000, 32000), (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    at = 10 + sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0))) if data[:3] == b"ID3" else 0
    out = []
    while at < len(data):
        bits = int.from_bytes(data[at : at + 4], "big")
        assert bits >> 21 == 0x7FF and bits >> 17 & 15 == 0b1101
        out.append(at)
        at += 144 * 1000 * kbits[bits >> 12 & 15] // rates[bits >> 10 & 3] + (bits >> 9 & 1)
    assert at == len(data)
    return out


@pytest.mark.parametrize("size", [64, 640, 4096, 70_016])
def test_frames_equal_a_second_reader(size):
    data = mpeg_audio.store(bytes(random.Random(size).randbytes(size)))
    table, *frames = plain_frames(data)
    r = mpeg_audio.read(data)
    assert r["offsets"] == frames and r["frames"] == len(frames) and data[table + 21 : table + 25] == b"Xing"


def test_garbage_shaped_like_headers_is_no_frame():
    payload = random.Random(4).randbytes(4000)
    whole = mpeg_audio.store(payload)
    clean = mpeg_audio.read(whole)
    assert clean["payload"] == payload and clean["frames"] >= 4
    lone = whole[clean["offsets"][1] :][:4]
    for k in range(1, clean["frames"]):
        for garbage in (lone + bytes(300), lone * 9, b"junk" + lone + bytes(2000), lone[:2] + b"\x50\xc0" + bytes(90)):
            cut = clean["offsets"][k]
            r = mpeg_audio.read(whole[:cut] + garbage + whole[cut:])
            assert r["payload"] == payload and r["frames"] == clean["frames"] and r["bad_crc"] == 0 and r["skipped"] == len(garbage), (k, garbage[:8])


def test_layers_one_and_two_and_their_checksums():
    for word, protected_bytes in ((b"\xff\xfe\x90\xc0", 16), (b"\xff\xfe\x90\x00", 32), (b"\xff\xfe\x90\x50", 20)):
        h = mpeg_audio.header(word)
        body = random.Random(h.size).randbytes(h.size - 6)
        frame = word + mpeg_audio.crc16(word[2:] + body[:protected_bytes]).to_bytes(2, "big") + body
        r = mpeg_audio.read(frame * 4)
        assert (r["layer"], r["frames"], r["bad_crc"], r["samples"]) == (1, 4, 0, 4 * 384)
        broken = bytearray(frame * 4)
        broken[h.size + 6 + protected_bytes - 1] ^= 1
        assert mpeg_audio.read(bytes(broken))["bad_crc"] == 1
        broken = bytearray(frame * 4)
        broken[h.size + 6 + protected_bytes] ^= 1
        assert mpeg_audio.read(bytes(broken))["bad_crc"] == 0


def plain_crc(bits):
    """The checksum bit by bit, as the standard draws its shift register."""
    register = [1] * 16
    for bit in bits:
        back = register[0] ^ bit
        register = register[1:] + [0]
        if back:
            for k in (0, 13, 15):
                register[k] ^= 1
    return int("".join(map(str, register)), 2)


LOW, HIGH = [4] * 11 + [3] * 12 + [2] * 4, [4] * 11 + [3] * 12 + [2] * 7


@pytest.mark.parametrize(
    "word, widths, channels, bound",
    [
        (b"\xff\xfc\x80\xc0", HIGH, 1, 30), (b"\xff\xfc\x80\x00", LOW, 2, 27), (b"\xff\xfc\x80\x50", LOW, 2, 8), (b"\xff\xfc\xe0\x70", HIGH, 2, 16), (b"\xff\xfc\x84\xc0", LOW, 1, 27),
        (b"\xff\xfc\x10\xc0", [4, 4] + [3] * 6, 1, 8), (b"\xff\xfc\x18\xc0", [4, 4] + [3] * 10, 1, 12), (b"\xff\xf4\x80\xc0", [4] * 4 + [3] * 7 + [2] * 19, 1, 30),
    ],
)
def test_layer_two_checksums(word, widths, channels, bound):
    r = random.Random(len(widths) + channels)
    h = mpeg_audio.header(word)
    bits = lambda n, k: [n >> (k - 1 - i) & 1 for i in range(k)]
    covered, scales = [], 0
    for k, width in enumerate(widths):
        for _ in range(channels if k < bound else 1):
            given = r.choice([0, r.randrange(1 << width)])
            covered += bits(given, width)
            scales += 0 if not given else 1 if k < bound else channels
    covered += [r.randrange(2) for _ in range(2 * scales)]
    body = covered + [r.randrange(2) for _ in range(8 * (h.size - 6) - len(covered))]
    pack = lambda b: bytes(int("".join(map(str, b[i : i + 8])), 2) for i in range(0, len(b), 8))
    check = plain_crc(bits(int.from_bytes(word[2:], "big"), 16) + covered)
    frame = word + check.to_bytes(2, "big") + pack(body)
    assert len(frame) == h.size
    found = mpeg_audio.read(frame * 4)
    assert (found["layer"], found["frames"], found["bad_crc"], found["samples"]) == (2, 4, 0, 4 * 1152)
    for at, bad in ((len(covered) - 1, 1), (len(covered), 0)):
        body[at] ^= 1
        assert mpeg_audio.read(frame * 2 + frame[:6] + pack(body) + frame)["bad_crc"] == bad
        body[at] ^= 1


def test_a_stream_of_one_frame_is_that_frame():
    word = b"\xff\xfb\x90\x64"
    frame = word + bytes(mpeg_audio.header(word).size - 4)
    for n in (1, 2, 3):
        r = mpeg_audio.read(frame * n)
        assert (r["frames"], r["skipped"], r["samples"], r["rate"]) == (n, 0, 1152 * n, 44100)
    assert mpeg_audio.read(b"xx" + frame)["frames"] == 1 and mpeg_audio.read(frame + b"xx")["frames"] == 0


def test_media_beside_columns_of_any_name(spark):
    media = spark.createDataFrame([(1, mpeg_audio.store(b"abc"), "x"), (1, mpeg_audio.store(b"abc"), "x"), (2, None, None)], "`a b` long, `m,1` binary, `version: int` string")
    got = mpeg_audio.read_media(media, "m,1")
    assert got.columns == ["a b", "m,1", "version: int", "read"]
    assert sorted((r[0], bytes(r["read"].payload), r["read"].frames) for r in got.collect()) == [(1, b"abc", 1), (1, b"abc", 1), (2, b"", 0)]
    assert mpeg_audio.read_media(media.limit(0), "m,1").count() == 0
    with pytest.raises(ValueError):
        mpeg_audio.read_media(media.withColumnRenamed("a b", "read"), "m,1")


def test_tags_and_seek_tables():
    audio = mpeg_audio.store(b"x" * 640)[10 + sum((b & 127) << s for b, s in zip(mpeg_audio.store(b"x" * 640)[6:10], (21, 14, 7, 0))) :]
    field = b"\x00payload_bytes\x0064"
    safe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    two = b"TXX" + len(field).to_bytes(3, "big") + field
    three = b"\x00\x00\x00\x06" + bytes(6) + b"TXXX" + len(field).to_bytes(4, "big") + b"\0\0" + field
    four = b"TXXX" + safe(len(field)) + b"\0\0" + field
    noisy = (b"PRIV" + (3).to_bytes(4, "big") + b"\0\0" + b"a\xff\x00" + b"TXXX" + len(field).to_bytes(4, "big") + b"\0\0" + field).replace(b"\xff\x00", b"\xff\x00\x00")
    for version, flags, body, tail in ((2, 0, two, b""), (3, 0x40, three, b""), (4, 0, four, b""), (4, 0x10, four, b"3DI" + bytes(7)), (3, 0x80, noisy, b"")):
        r = mpeg_audio.read(b"ID3" + bytes([version, 0, flags]) + safe(len(body)) + body + tail + audio)
        assert (len(r["payload"]), r["skipped"]) == (64, 0), version
    word = bytes([0xFF, 0xFB, 0x90, 0xC0])
    size = mpeg_audio.header(word).size
    vbri = word + bytes(32) + b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (3, 2, 2, 4, 100, 200, 300))
    r = mpeg_audio.read(vbri.ljust(size, b"\0") + (word + bytes(size - 4)) * 2)
    assert r["table"] == {"kind": "VBRI", "bytes": 5000, "frames": 7, "toc": [200, 400, 600]} and r["frames"] == 2


def test_a_column_named_read_is_refused(spark):
    with pytest.raises(ValueError):
        mpeg_audio.read_media(spark.createDataFrame([(b"", 1)], "media binary, read int"))


def test_header_fields():
    h = mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x64]))
    assert (h.version, h.layer, h.kbits, h.rate, h.size, h.samples, h.mono) == ("1", 3, 128, 44100, 417, 1152, False)
    h = mpeg_audio.header(bytes([0xFF, 0xF3, 0x40, 0xC0]))
    assert (h.version, h.layer, h.kbits, h.rate, h.size, h.samples, h.side) == ("2", 3, 32, 22050, 104, 576, 9)
    assert mpeg_audio.header(b"\xff\xff\xff\xff") is None
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7
    assert zlib.crc32(b"") == 0
