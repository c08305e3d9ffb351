"""Suffix-array dedup: remove each byte covered by a string of ``LENGTH`` bytes that also starts earlier in the corpus.

The blockwise suffix sort with a difference cover, for a corpus that no machine holds:

- The cover sample. A difference cover holds, for any two suffixes, a shift below v at which both are sampled. Its sample here is chosen by content instead of by
  residue: in every window of LENGTH bytes the smallest of its K-byte hashes (leftmost of equals). Two equal windows then have their sampled position at the
  same shift, which is all that is asked of a cover, with 2 in 70 positions sampled rather than a tenth and more, and sampled positions of unlike texts never meet.
- Names. Each sampled position has a name for the bytes from SPAN before it to LENGTH behind it. Where a name was seen before, all windows there are repeats; the
  rest, sampled positions whose K bytes occur with several names, keep one position a name.
- Buckets. Those are sorted one bucket (of K-byte hashes) at a time. The suffix that starts o bytes before a sampled position is ordered by its first o bytes,
  then by the rank of the sampled suffix, which the bucket computes once; suffixes of equal order up to LENGTH bytes are equal windows. Bytes
  decide here.

A bucket's rows fit a task: there are more buckets for more input. A K-byte string with more than ``HOT`` names is not kept in one bucket: its windows are counted one by
one in a grouped sum with partial sums before the shuffle. Of the positions of one name that a scan task holds at a time (``FLUSH`` bytes of texts), the first alone goes to the bucket of
its K bytes; the others are repeats already, and are spread over all buckets by document, which only hand them on. K bytes with ``LOOSE`` names or more there (a passage in ever
other surroundings) surely have several: their positions are spread by name, and their bucket is told so by one row. So of a passage that a third of all
documents hold, its bucket gets at most LOOSE rows for FLUSH bytes of input.

What decides: names, and windows about a hot K-byte string, are equal if 128 bits of hashes are; in buckets, bytes are compared.

Defined results: a null text counts as empty; a text shorter than LENGTH keeps all. A null doc_id comes before all others. Rows of equal doc_id and text are one document
and get the same result; other texts under one doc_id are documents of their own, ordered by text hash. Matches never cross documents. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, release, small_batches, table

LENGTH, K = 100, 32
SPAN = LENGTH - K  # a window starts at most so far before its sampled position
CTX = SPAN + LENGTH
PAD = 0xFF  # no byte of UTF-8
#: Bytes that are hashed at once, and bytes of text a bucket stands for.
BLOCK, BUCKET_BYTES = 4 << 20, 8 << 20
#: Texts whose sampled positions a scan task holds before it sends them.
FLUSH = 48 << 20
HOT = 50_000
LOOSE = 8
NULL_ID = -(1 << 63)

_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes from each place on (the last K - 1 places have none)."""
    h, step = _TABLE[b], 1
    for m in _MUL:
        h = (h[:-step] * m) ^ (h[step:] + (h[:-step] >> np.uint64(29)))
        step *= 2
    h *= _MUL[0]
    h ^= h >> np.uint64(32)
    return h


def _slide(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    m, n = v, 1
    while 2 * n <= w:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(m) - (w - n)], m[w - n :]) if w > n else m


def sampled(b: np.ndarray, h: np.ndarray, spans: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Places of the cover sample in b, whose windows with a PAD, or outside the spans, don't count."""
    n = len(b) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 23) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    least = _slide(v, SPAN + 1)[:n]
    padded = np.concatenate(([0], np.cumsum(b == PAD, dtype=np.int32)))
    ok = padded[LENGTH:] == padded[:-LENGTH]
    if spans is not None:
        inside = np.zeros(n, bool)
        for a, z in spans:
            inside[a : max(a, z - LENGTH + 1)] = True
        ok &= inside
    at = (least[ok] & low).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


_NAME = (-68, -36, -4, 28, 60, 68)
assert SPAN == 68 and LENGTH - K == 68


def names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of the CTX bytes about each place."""
    c = np.zeros(len(at), np.uint64)
    for i, o in enumerate(_NAME):
        c = (c ^ h[at + o]) * _MUL[i % 5]
        c ^= c >> np.uint64(31)
    return c


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text's place, offset, bytes) in blocks of about BLOCK bytes; a long text comes in parts that share LENGTH - 1 bytes, so each window is in one."""
    block, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            part = t[a : a + BLOCK + LENGTH - 1]
            if size and size + len(part) > BLOCK:
                yield block
                block, size = [], 0
            block.append((i, a, part))
            size += len(part) + CTX
    if block:
        yield block


def sample_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text's place, position, K-byte hash and name of each sampled position. What a part of a long text lacks of a name's bytes is taken from the text."""
    out: list[tuple] = []
    gap = bytes([PAD]) * LENGTH
    for block in pieces(texts):
        parts, starts, at = [gap], [], len(gap)
        for i, a, part in block:
            t = texts[i]
            before, after = t[max(0, a - SPAN) : a], t[a + len(part) : a + len(part) + LENGTH]
            parts += [before, part, after, gap]
            starts.append((at, at + len(before), at + len(before) + len(part)))
            at += len(before) + len(part) + len(after) + len(gap)
        b = np.frombuffer(b"".join(parts), np.uint8)
        h = hashes(b)
        p = sampled(b, h, [x[1:] for x in starts])
        s = np.array([x[1] for x in starts])
        owner = np.searchsorted(np.array([x[0] for x in starts]), p, "right") - 1
        position = p - s[owner] + np.array([x[1] for x in block])[owner]
        out.append((np.array([x[0] for x in block])[owner], position, h[p], names(h, p)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


SENT = "bucket int, payload binary"
_ROW = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("sha", "<i8"), ("pos", "<i4"), ("kind", "u1")])


def _columns(r: np.ndarray) -> bytes:
    """Rows by column, which packs better in the shuffle."""
    return len(r).to_bytes(4, "little") + b"".join(np.ascontiguousarray(r[n]).tobytes() for n in r.dtype.names)


def _rows(p: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = int.from_bytes(p[:4], "little"), 4
    r = np.empty(n, dtype)
    for name in dtype.names:
        t = dtype[name]
        r[name] = np.frombuffer(p, t.base, n * int(np.prod(t.shape, dtype=int)), at).reshape((n, *t.shape))
        at += n * t.itemsize
    return r


def _first(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """r in the order of (h, c, doc, sha, pos) without equal rows, and whether each is the first with its h and c."""
    r = r[np.lexsort((r["pos"], r["sha"], r["doc"], r["c"], r["h"]))]
    same = np.zeros(len(r), bool)
    name = np.zeros(len(r), bool)
    if len(r):
        name[1:] = (r["h"][1:] == r["h"][:-1]) & (r["c"][1:] == r["c"][:-1])
        same[1:] = name[1:] & (r["doc"][1:] == r["doc"][:-1]) & (r["sha"][1:] == r["sha"][:-1]) & (r["pos"][1:] == r["pos"][:-1])
    return r[~same], ~name[~same]


#: OPEN: first of its name so far; FULL: not the first; SPREAD: first of its name, of K bytes with several names; TOLD: the K bytes have several names.
OPEN, FULL, SPREAD, TOLD = range(4)


def _spread(r: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows by the bucket of their K bytes; FULL ones, which no bucket has to look at, by document, SPREAD ones by name."""
    b = (r["h"] >> np.uint64(11)) % np.uint64(buckets)
    if "kind" in r.dtype.names:
        other = np.where(r["kind"] == FULL, r["doc"].astype(np.uint64), r["h"] ^ r["c"]) * _MUL[0]
        b = np.where((r["kind"] == FULL) | (r["kind"] == SPREAD), (other >> np.uint64(20)) % np.uint64(buckets), b)
    order = np.argsort(b, kind="stable")
    r, b = r[order], b[order]
    cuts = np.flatnonzero(np.diff(b, prepend=buckets + 1))
    for i in range(0, len(cuts), 64):
        part = cuts[i : i + 64]
        ends = [*cuts[i + 1 : i + 65], len(r)][: len(part)]
        yield pa.RecordBatch.from_arrays([pa.array(b[part].astype(np.int32)), pa.array([_columns(r[x:y]) for x, y in zip(part, ends)], pa.binary())], ["bucket", "payload"])


def _texts(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def sample_partition(buckets: int, flush: int = FLUSH, loose: int = LOOSE):
    """For mapInArrow over (doc, sha, text): rows of the cover sample by bucket; of equal names one stays, the others are marked FULL at once."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r, first = _first(np.concatenate(held))
        if not len(r):
            return
        head = np.diff(r["h"], prepend=~r["h"][:1]) != 0
        group = np.cumsum(head) - 1
        several = np.bincount(group[first], minlength=group[-1] + 1)[group] >= loose
        r["kind"] = np.where(first, np.where(several, SPREAD, OPEN), FULL)
        told = r[head & several]
        told["kind"] = TOLD
        yield from _spread(np.concatenate([r, told]), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            texts = _texts(b.column(2))
            i, pos, h, c = sample_texts(texts)
            r = np.empty(len(i), _ROW)
            r["h"], r["c"], r["pos"], r["kind"] = h, c, pos, OPEN
            r["doc"], r["sha"] = b.column(0).to_numpy(zero_copy_only=False)[i], b.column(1).to_numpy(zero_copy_only=False)[i]
            held.append(r)
            size += sum(map(len, texts))
            if size >= flush:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return run


MARKS = "doc long, sha long, pos int, h long, open boolean"


def name_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over a partition of buckets: FULL positions (their windows are repeats), and OPEN ones, the first of each name where the K bytes have several."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(k, []).append(p)
    for k in sorted(held):
        r = np.concatenate([_rows(p, _ROW) for p in held.pop(k)])
        sent, told = r[r["kind"] == FULL], np.unique(r["h"][r["kind"] == TOLD])
        spread, new = _first(r[r["kind"] == SPREAD])
        r, first = _first(r[r["kind"] == OPEN])
        group = np.cumsum(np.diff(r["h"], prepend=~r["h"][:1]) != 0) - 1
        several = (np.bincount(group[first], minlength=len(r))[group] > 1) | np.isin(r["h"], told) if len(r) else first
        full, openly = np.concatenate([sent, spread[~new], r[~first]]), np.concatenate([spread[new], r[first & several]])
        for x, is_open in ((full, False), (openly, True)):
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"].copy()), pa.array(x["sha"].copy()), pa.array(x["pos"].copy()), pa.array(x["h"].astype(np.int64)), pa.array(np.full(len(x), is_open))], ["doc", "sha", "pos", "h", "open"])


_CTX = np.dtype([("h", "<u8"), ("doc", "<i8"), ("sha", "<i8"), ("pos", "<i4"), ("left", "<i2"), ("right", "<i2"), ("ctx", "u1", (CTX,))])


def contexts(doc: int, sha: int, text: bytes, pos: np.ndarray, h: np.ndarray) -> np.ndarray:
    r = np.empty(len(pos), _CTX)
    b = np.frombuffer(bytes([PAD]) * SPAN + text + bytes([PAD]) * LENGTH, np.uint8)
    r["h"], r["doc"], r["sha"], r["pos"] = h.view(np.uint64), doc, sha, pos
    r["ctx"] = b[pos[:, None].astype(np.int64) + np.arange(CTX)]
    r["left"], r["right"] = np.minimum(pos, SPAN), np.minimum(len(text) - pos, LENGTH)  # bytes that the text has on either side
    return r


def context_partition(buckets: int):
    """For mapInArrow over (doc, sha, text, marks array<struct<pos, h>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            docs, shas, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2))
            flat, offsets = b.column(3).flatten(), b.column(3).offsets.to_numpy()
            offsets = offsets - offsets[0]
            pos, h = flat.field("pos").to_numpy(), flat.field("h").to_numpy()
            for i, t in enumerate(texts):
                a, z = offsets[i], offsets[i + 1]
                held.append(contexts(docs[i], shas[i], t, pos[a:z], h[a:z]))
                n += z - a
            if n > 100_000:
                yield from _spread(np.concatenate(held), buckets)
                held, n = [], 0
        if held:
            yield from _spread(np.concatenate(held), buckets)

    return run


def ranks(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of an array of bytes, and the bytes each row in it shares with the one before."""
    n, width = b.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = b
    words = wide.view(">u8")
    order = np.lexsort(words.T[::-1])
    s = b[order]
    differ = s[1:] != s[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.concatenate(([0], shared))


def repeated_windows(r: np.ndarray) -> np.ndarray:
    """For each context (rows of _CTX in the order of doc, sha, pos) and each shift o in 0..SPAN, whether the window that starts o bytes before
    its sampled position also starts earlier at one of the rows above it."""
    n = len(r)
    r_order, r_shared = ranks(r["ctx"][:, SPAN:])
    l_order, l_shared = ranks(r["ctx"][:, SPAN - 1 :: -1])
    out = np.zeros((n, SPAN + 1), bool)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(SPAN + 1):
        right[r_order] = np.cumsum(r_shared < LENGTH - o)
        left[l_order] = np.cumsum(l_shared < o) if o else 0
        valid = np.flatnonzero((r["left"] >= o) & (r["right"] >= LENGTH - o))
        key = right[valid] * (n + 1) + left[valid]
        out[valid, o] = pd.Series(key).duplicated().to_numpy()
    return out


RANGES = "doc long, sha long, start int, stop int"


def bucket_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over a partition of buckets of contexts: byte ranges that repeated windows cover."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(k, []).append(p)
    for k in sorted(held):
        r = np.concatenate([_rows(p, _CTX) for p in held.pop(k)])
        r = r[np.lexsort((r["pos"], r["sha"], r["doc"]))]
        key = np.stack([r["doc"], r["sha"], r["pos"]], 1)
        r = r[np.concatenate(([True], (key[1:] != key[:-1]).any(1)))]  # equal rows of documents
        m = np.zeros((len(r), SPAN + 3), np.int8)
        m[:, 1:-1] = repeated_windows(r)
        edge = np.diff(m, axis=1)
        i, first = np.nonzero(edge == 1)  # runs of shifts o in [first, last)
        _, last = np.nonzero(edge == -1)
        p = r["pos"][i]
        yield pa.RecordBatch.from_arrays([pa.array(r["doc"][i]), pa.array(r["sha"][i]), pa.array((p - last + 1).astype(np.int32)), pa.array((p - first + LENGTH).astype(np.int32))], ["doc", "sha", "start", "stop"])


WINDOWS = "key1 long, key2 long, doc long, sha long, start int"


def window_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc, sha, text, marks): each window about a hot position by a 128-bit hash."""
    for b in batches:
        docs, shas, texts, marks = b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2)), b.column(3).to_pylist()
        rows = []
        for d, s, t, m in zip(docs, shas, texts, marks):
            starts = {a for x in m for a in range(max(0, x["pos"] - SPAN), min(x["pos"], len(t) - LENGTH) + 1)}
            for a in sorted(starts):
                k = hashlib.blake2b(t[a : a + LENGTH], digest_size=16).digest()
                rows.append((int.from_bytes(k[:8], "little", signed=True), int.from_bytes(k[8:], "little", signed=True), d, s, a))
            if len(rows) > 50_000:
                yield _windows(rows)
                rows = []
        yield _windows(rows)


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key1", "key2", "doc", "sha", "start"])


def removal_ranges(docs: DataFrame, hot: int = HOT, loose: int = LOOSE) -> DataFrame:
    """docs: doc, sha, text. doc, sha, ranges: array<struct<start, stop>> (bytes; may overlap, and run past the text) for documents that lose any."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(16, -(-size // BUCKET_BYTES)))
    sent = docs.mapInArrow(sample_partition(buckets, loose=loose), SENT)
    marks = materialize(sent.repartition(buckets, "bucket").mapInArrow(name_partition, MARKS), "repeats-marks")
    release(spark)
    opened = marks.where("open")
    hot_h = materialize(opened.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"), "repeats-hot")
    any_hot = not hot_h.isEmpty()
    cold = opened.join(hot_h, "h", "left_anti") if any_hot else opened

    def with_text(m: DataFrame) -> DataFrame:
        per_doc = m.groupBy("doc", "sha").agg(F.collect_list(F.struct("pos", "h")).alias("marks"))
        return docs.join(per_doc, ["doc", "sha"]).select("doc", "sha", "text", "marks")

    found = materialize(with_text(cold).mapInArrow(context_partition(buckets), SENT).repartition(buckets, "bucket").mapInArrow(bucket_partition, RANGES), "repeats-ranges")
    release(spark)
    ranges = found.unionByName(marks.where("NOT open").select("doc", "sha", F.greatest(F.col("pos") - SPAN, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("stop")))
    if any_hot:
        w = materialize(with_text(opened.join(hot_h, "h", "left_semi")).mapInArrow(window_partition, WINDOWS).distinct(), "repeats-windows")
        first = w.groupBy("key1", "key2").agg(F.min(F.struct("doc", "sha", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = w.join(first, ["key1", "key2"]).where(F.struct("doc", "sha", "start") != F.col("first"))
        ranges = ranges.unionByName(later.select("doc", "sha", "start", (F.col("start") + LENGTH).cast("int").alias("stop")))
    return ranges.groupBy("doc", "sha").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc, sha, text; sha is 0 throughout where doc_id alone names a row, which saves shuffling it."""
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).alias("k")).first()
    sha = F.lit(0).cast("long") if ids["n"] == ids["k"] else F.xxhash64("text")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), sha.alias("sha"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def merged(starts: np.ndarray, stops: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes below n."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    a, z = starts[order], np.minimum(np.maximum.accumulate(stops[order]), n)
    new = np.concatenate(([True], a[1:] > z[:-1]))
    return list(zip(a[new].tolist(), z[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))].tolist()))


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def keep_partition(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, r in zip(b.column(0).to_pylist(), _texts(b.column(1)), b.column(2)):
                spans = []
                if r.is_valid:
                    x = r.values
                    spans = merged(x.field("start").to_numpy(), x.field("stop").to_numpy(), len(t))
                kept, at = [], 0
                for a, z in spans:
                    kept.append(t[at:a])
                    at = z
                kept = b"".join([*kept, t[at:]])
                rows.append((None if d == NULL_ID else d, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in KEPT.split(", ")])

    return run


def dedup_bytes(docs: DataFrame, with_bytes: bool = True, hot: int = HOT, loose: int = LOOSE) -> DataFrame:
    """KEPT of each row of docs (doc_id, text); kept is null unless with_bytes."""
    small_batches(docs.sparkSession)
    d = keyed(docs)
    r = removal_ranges(d, hot, loose)
    return d.join(r, ["doc", "sha"], "left").select("doc", "text", "ranges").mapInArrow(keep_partition(with_bytes), KEPT)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False).drop("kept")


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict[str, str] = {}
