"""Media columns: MPEG audio.

``encode`` stores bytes losslessly in an MPEG-1 Layer III stream: an ID3v2 tag with the payload's size, a frame with a Xing table, then
protected mono frames at 48 kHz whose granules are silent and whose ancillary bits carry the payload. ``probe`` parses any MPEG audio bytes: it
skips ID3v2, ID3v1 and APEv2 tags, resynchronises on frame headers (a header counts if the next frame, or the end of the audio, stands where it
says), reads Xing, Info and VBRI tables, verifies the CRC-16 of protected Layer III frames, and gives exact durations (samples and rate) and
the byte offset of each frame for seeking. ``payload`` reads stored bytes back.

Defined results: null media gives null results; empty media, or media without a frame, 0 frames, 0 samples and no offsets. A frame whose CRC
is wrong is counted in crc_bad and still timed. Bytes between frames are counted in skipped_bytes. A null payload is encoded as 0 bytes.
One row is one task's business, so results don't depend on other rows, repeated or not, and further columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, table

_V1L1 = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
_V1L2 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
_V1L3 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_V2L1 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
_V2L23 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE, HEAD = 17, 4 + 2 + 17  # side information of a mono frame; header, CRC and side information
SIZES = tuple(3 * k for k in _V1L3)  # bytes of a 48 kHz frame, by bitrate index
FULL = SIZES[14] - HEAD
PAD_TO = 64


def _crc_table() -> np.ndarray:
    t = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        t[i] = c
    return t


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of an array of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for j in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ CRC[(c >> np.uint16(8)) ^ rows[:, j]]
    return c


class Header(NamedTuple):
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    rate: int
    size: int
    samples: int
    mono: bool


_HEADERS: dict[bytes, Header | None] = {}


def header(b: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free format has no size of its own and counts as none."""
    if b not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[b] = _header(b)
    return _HEADERS[b]


def _header(b: bytes) -> Header | None:
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, k, r, pad = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3, b[2] >> 1 & 1
    if version == 1 or layer == 4 or k in (0, 15) or r == 3 or b[3] & 3 == 2:
        return None
    kbps = ((_V1L1, _V1L2, _V1L3) if version == 3 else (_V2L1, _V2L23, _V2L23))[layer - 1][k]
    rate = RATES[version][r]
    if layer == 1:
        size, samples = (12 * kbps * 1000 // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * kbps * 1000 // rate + pad
    return Header(version, layer, not b[1] & 1, rate, size, samples, b[3] >> 6 == 3)


def _side(h: Header) -> int:
    return (17 if h.mono else 32) if h.version == 3 else (9 if h.mono else 17)


def _head(k: int) -> bytes:
    return bytes((0xFF, 0xFA, k << 4 | 1 << 2, 0xC0))  # MPEG-1, Layer III, protected, 48 kHz, mono


def _fixed(k: int) -> bytes:
    head = _head(k)
    c = int(crc16(np.frombuffer(head[2:] + bytes(SIDE), np.uint8)[None])[0])
    return head + struct.pack(">H", c) + bytes(SIDE)


_FIXED = {k: _fixed(k) for k in range(1, 15)}


def encode(data: bytes | None) -> bytes:
    data = data or b""
    full, rest = divmod(len(data), FULL)
    last = next((k for k in range(1, 15) if SIZES[k] - HEAD >= rest), 14)
    n = full + bool(rest)
    frames = np.zeros((full, SIZES[14]), np.uint8)
    frames[:, :HEAD] = np.frombuffer(_FIXED[14], np.uint8)
    frames[:, HEAD:] = np.frombuffer(data, np.uint8, full * FULL).reshape(full, FULL)
    end = _FIXED[last] + data[full * FULL :] + bytes(SIZES[last] - HEAD - rest) if rest else b""
    value = f"\x00payload_bytes\x00{len(data)}".encode("latin-1")
    tag = b"TXXX" + struct.pack(">IH", len(value), 0) + value
    id3 = b"ID3\x03\x00\x00" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag
    size = SIZES[14] + frames.size + len(end)
    toc = bytes(min(255, 256 * (SIZES[14] + min(n, n * i // 100) * SIZES[14]) // size) for i in range(100))
    xing = (_FIXED[14] + b"Xing" + struct.pack(">III", 7, n, size) + toc).ljust(SIZES[14], b"\0")
    return b"".join((id3, xing, frames.tobytes(), end))


def _tags(b: bytes) -> tuple[int, int, dict[str, str]]:
    """Where the audio begins and ends, and the texts of the ID3v2 tag."""
    at, end, texts = 0, len(b), {}
    while b[at : at + 3] == b"ID3" and at + 10 <= end:
        n = b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9]
        stop, p = min(end, at + 10 + n), at + 10
        while b[at + 3] in (3, 4) and p + 10 <= stop and b[p : p + 4].isalnum():
            size = struct.unpack(">I", b[p + 4 : p + 8])[0] if b[at + 3] == 3 else b[p + 4] << 21 | b[p + 5] << 14 | b[p + 6] << 7 | b[p + 7]
            body, name = b[p + 10 : min(stop, p + 10 + size)], b[p : p + 4].decode("latin-1")
            if name[0] == "T" and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                texts[key] = value.rstrip("\0")
            p += 10 + size
        at = stop + 10 * bool(b[at + 5] & 16)
    if end - at >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
    if end - at >= 32 and b[end - 32 : end - 24] == b"APETAGEX":
        n, flags = struct.unpack("<I", b[end - 20 : end - 16])[0], struct.unpack("<I", b[end - 12 : end - 8])[0]
        end = max(at, end - n - 32 * bool(flags & 1 << 31))
    return min(at, end), end, texts


class Probe(NamedTuple):
    frames: int
    samples: int
    rate: int
    offsets: np.ndarray
    table: str  # Xing, Info, VBRI or nothing
    table_frames: int
    table_ok: bool  # the table's number of frames is what was found
    crc_checked: int
    crc_bad: int
    skipped: int
    tags: dict[str, str]
    payload: bytes


def probe(b: bytes) -> Probe:
    at, end, texts = _tags(b)
    offsets: list[int] = []
    sizes: list[int] = []
    kinds: list[Header] = []
    skipped, stream = 0, None
    while at + 4 <= end:
        h = header(b[at : at + 4])
        ok = h is not None and h.size >= 4 and at + h.size <= end and (stream in (None, h[:2] + (h.rate,)))
        if ok and at + h.size + 4 <= end and stream is None:  # the first header needs another behind it
            n = header(b[at + h.size : at + h.size + 4])
            ok = n is not None and n[:2] + (n.rate,) == h[:2] + (h.rate,)
        elif ok and at + h.size + 4 <= end and b[at + h.size] != 0xFF:  # a later one may end a stretch only before junk, and is kept if it was in step
            ok = bool(offsets) and offsets[-1] + sizes[-1] == at
        if not ok:
            nxt = b.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            at = nxt
            continue
        stream = h[:2] + (h.rate,)
        offsets.append(at)
        sizes.append(h.size)
        kinds.append(h)
        at += h.size
    skipped += max(0, end - at)
    name, count, first = "", 0, 0
    if kinds:
        p = offsets[0] + 4 + 2 * kinds[0].protected
        x = p + _side(kinds[0])
        if b[x : x + 4] in (b"Xing", b"Info"):
            name, first = b[x : x + 4].decode(), 1
            count = struct.unpack(">I", b[x + 8 : x + 12])[0] if b[x + 7] & 1 else 0
        elif b[offsets[0] + 36 : offsets[0] + 40] == b"VBRI":
            name, first = "VBRI", 1
            count = struct.unpack(">I", b[offsets[0] + 50 : offsets[0] + 54])[0]
    checked = bad = 0
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(kinds):
        if h.protected and h.layer == 3:
            groups.setdefault(_side(h), []).append(offsets[i])
    raw = np.frombuffer(b, np.uint8)
    for side, at_ in groups.items():
        o = np.array(at_, np.int64)
        o = o[o + 6 + side <= len(b)]
        cols = np.array([2, 3, *range(6, 6 + side)])
        found = raw[o + 4].astype(np.uint16) << np.uint16(8) | raw[o + 5]
        checked += len(o)
        bad += int((crc16(raw[o[:, None] + cols]) != found).sum())
    audio = kinds[first:]
    lengths = [s - 4 - 2 * h.protected - _side(h) for s, h in zip(sizes[first:], audio)]
    data = b"".join(b[o + s - n : o + s] for o, s, n in zip(offsets[first:], sizes[first:], lengths) if n > 0)
    n = texts.get("payload_bytes", "")
    return Probe(
        len(audio), sum(h.samples for h in audio), kinds[0].rate if kinds else 0, np.array(offsets[first:], np.int64), name, count, bool(name) and count == len(audio),
        checked, bad, skipped, texts, data[: int(n)] if n.isascii() and n.isdigit() else data,
    )


PROBE_SCHEMA = "frames long, samples long, sample_rate int, duration_us long, seek_offsets array<long>, vbr_table string, table_frames long, table_ok boolean, crc_checked long, crc_bad long, skipped_bytes long, payload binary"


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(PAD_TO, -(-len(data) // PAD_TO) * PAD_TO), b"\0")


def _encode_batch(data: pd.Series) -> pd.Series:
    """binary payload -> MPEG audio bytes."""
    return data.map(lambda x: encode(bytes(x) if x is not None else None))


def _row(b: bytes) -> tuple:
    p = probe(b)
    return (p.frames, p.samples, p.rate, p.samples * 1_000_000 // p.rate if p.rate else 0, p.offsets, p.table, p.table_frames, p.table_ok, p.crc_checked, p.crc_bad, p.skipped, p.payload)


def _probe_batch(media: pd.Series) -> pd.DataFrame:
    """MPEG audio bytes -> PROBE_SCHEMA; a null gives nulls."""
    names = [x.split()[0] for x in PROBE_SCHEMA.split(", ")]
    return pd.DataFrame([(None,) * len(names) if b is None else _row(bytes(b)) for b in media], columns=names, dtype=object)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long, crc_bad long"


def digest(text: str | None) -> tuple:
    n, data = padded(text)
    media = encode(data)
    p = probe(media)
    sha = hashlib.sha256(p.offsets.astype("<i8").tobytes()).hexdigest()[:16]
    us = p.samples * 1_000_000 // p.rate
    feature = f"mp3:{p.rate}Hz:frames={p.frames}:samples={p.samples}:{p.table}={'ok' if p.table_ok else 'bad'}:crc_bad={p.crc_bad}/{p.crc_checked}:skipped={p.skipped}:seek={sha}"
    return (n, len(p.payload), hashlib.sha256(p.payload).hexdigest(), zlib.crc32(p.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, p.frames, us, p.crc_bad)


def _digest_batch(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([digest(x) for x in text], columns=[x.split()[0] for x in DIGEST.split(", ")])


def encode_bytes(data: Column) -> Column:
    """A binary column as MPEG audio."""
    return F.pandas_udf(_encode_batch, "binary")(data)


def probe_media(media: Column) -> Column:
    """A struct of PROBE_SCHEMA for a column of MPEG audio."""
    return F.pandas_udf(_probe_batch, PROBE_SCHEMA)(media)


def op1_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(_digest_batch, DIGEST)("text").alias("m"))
    return d.select("doc_id", "m.*")


QUERIES = {"op1_mpeg_media": op1_mpeg_media}
ORACLES: dict[str, str] = {}
