"""SentencePiece encoding and decoding: segmentations sampled by forward filtering and backward sampling, seeded by row key.

The lattice of a text has a node at each character boundary and an edge for each piece of the vocabulary; a character that no piece spells has an edge of
its UTF-8 bytes' pieces. Edge weights are ``alpha`` times the log of a piece's Zipf probability by its rank (scores of a BPE model are ranks). Forward filtering gives each node
the log of the sum over paths to it; backward sampling draws, from the end, an incoming edge in proportion to what it adds.

No piece has a space behind another character, so the lattice falls into chunks (spaces, then characters up to the next space or newline), and the sample of
a text is that of its chunks. A chunk's nodes are filtered once and kept in a bounded cache; draws are made for all chunks of a batch at a time.

Random numbers come from a counter: the row's key, the chunk's place and the step, so a row's sample depends on neither partitions, batches, cache nor retries.

Decoding is lossless: spaces are U+2581 in pieces, and a U+2581 of the text is encoded by its bytes. No normalisation, no added prefix.

Defined results: a null text counts as empty and has no pieces; equal keys with equal texts give equal samples; a null key is a key. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, table
from graphloom.llm.langid import Table

ALPHA = 0.5
SEED = 0
#: Nodes in the cache, of about 30 bytes with their edges.
MAX_NODES = 8_000_000
WIDTHS = (8, 12, 16, 24, 32, 64)
CHUNK = re.compile(r" *[^ \n]+|\n| +")
SPACE = "▁"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def substrings(c: np.ndarray, longest: int) -> list[np.ndarray]:
    """For l = 1 .. longest: a 64-bit hash of the l characters from each column on, for each row of an array of code points."""
    m = np.uint64(0xBF58476D1CE4E5B9)
    x = (c.astype(np.uint64) + np.uint64(1)) * _ODD
    h, out = x, [mixed(x)]
    for k in range(1, min(longest, c.shape[1])):
        h = (h[:, :-1] ^ (h[:, :-1] >> np.uint64(32))) * m + x[:, k:]
        out.append(mixed(h + np.uint64(k * 0x94D049BB133111EB & (1 << 64) - 1)))
    return out


def code_points(strings: list[str], width: int) -> np.ndarray:
    """A row for each string, 0 behind its end."""
    return np.array(strings, f"<U{width}").view("<u4").reshape(len(strings), width)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, width: tuple[int, ...] = ()):
        self.a, self.n = np.zeros((1024, *width), dtype), 0

    def extend(self, values) -> None:
        end = self.n + len(values)
        if end > len(self.a):
            self.a = np.concatenate([self.a, np.zeros((max(len(self.a), end - len(self.a)), *self.a.shape[1:]), self.a.dtype)])
        self.a[self.n : end] = values
        self.n = end

    @property
    def view(self) -> np.ndarray:
        return self.a[: self.n]


class Sampler:
    def __init__(self, path: str, alpha: float = ALPHA, max_nodes: int = MAX_NODES):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = [0] * 256
        self.weights: dict[str, tuple[float, int]] = {}
        self.spelled: list[bytes] = []
        size = sp.get_piece_size()
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.spelled.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.spelled.append(b"")
            else:
                self.weights[p] = (-alpha * math.log(min(-sp.get_score(i), size) + 2), i)
                self.spelled.append(p.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.weights))
        names = list(self.weights)
        n = np.array([len(x) for x in names])
        h = substrings(code_points(names, self.longest), self.longest)
        keys = np.array([h[k - 1][i, 0] for i, k in enumerate(n)])
        if len(np.unique(keys)) < len(keys):
            raise ValueError("hashes of pieces collide")
        # per row of the table: id, weight
        self.table = Table(keys, np.array([[self.weights[x][1], 0] for x in names], np.float32))
        by_id = np.zeros(size)
        for w, i in self.weights.values():
            by_id[i] = w
        self.by_row = self.table.values[:, 0].astype(np.int64)
        self.row_weight = by_id[self.by_row]
        self.byte_weight = -alpha * math.log(size + 2)
        self.max_nodes = max_nodes
        self._clear()

    def _clear(self) -> None:
        self.last: dict[str, int] = {}  # chunk: its last node
        self.first = _Grown(np.int32)  # by node: its first incoming edge
        # by edge, in the order of target nodes: the running share of the node's probability (2 at its last edge), characters back to its
        # source (0: the chunk's begin), and its piece, or -1 - i for the i-th character that is spelled by bytes
        self.share, self.back, self.piece = _Grown(np.float32), _Grown(np.uint8), _Grown(np.int32)
        self.spelt: dict[str, int] = {}
        self.spelt_ids, self.spelt_many = np.zeros((0, 4), np.int32), np.zeros(0, np.int8)

    @property
    def nodes(self) -> int:
        return self.first.n

    def _spell(self, char: str) -> int:
        i = self.spelt.setdefault(char, len(self.spelt))
        if i == len(self.spelt_many):
            b = char.encode("utf-8", "surrogatepass")
            self.spelt_ids = np.concatenate([self.spelt_ids, [[*(self.byte[x] for x in b), *[0] * (4 - len(b))]]]).astype(np.int32)
            self.spelt_many = np.append(self.spelt_many, np.int8(len(b)))
        return -1 - i

    def lattice(self, chunk: str) -> list[list[tuple[float, int, tuple[int, ...]]]]:
        """By node from 1: incoming edges (weight, source node, ids)."""
        m = chunk.replace(SPACE, "￿").replace(" ", SPACE)
        out = []
        w, longest = self.weights, self.longest
        for j in range(1, len(m) + 1):
            edges = []  # the shortest piece first
            for i in range(j - 1, max(0, j - longest) - 1, -1):
                x = w.get(m[i:j])
                if x is not None:
                    edges.append((x[0], i, (x[1],)))
                elif i == j - 1:
                    b = chunk[i].encode("utf-8", "surrogatepass")
                    edges.append((self.byte_weight * len(b), i, tuple(self.byte[x] for x in b)))
            out.append(edges)
        return out

    def _add(self, chunks: list[str]) -> None:
        """Forward filtering of chunks that the cache lacks: short ones many at a time, by length; long ones alone."""
        by: dict[int, list[str]] = {}
        for c in chunks:
            by.setdefault(next((w for w in WIDTHS if len(c) <= w), 0), []).append(c)
        for width, group in sorted(by.items()):
            if width:
                for i in range(0, len(group), 1 << 19 - width.bit_length()):
                    self._add_short(group[i : i + (1 << 19 - width.bit_length())], width)
            else:
                for c in group:
                    self._add_long(c)

    def _add_short(self, chunks: list[str], width: int) -> None:
        c = code_points(chunks, width).copy()
        plain = c.copy()
        c[plain == 0x2581] = 0xFFFF
        c[plain == 0x20] = 0x2581
        n = np.array([len(x) for x in chunks])  # a NUL at the end of a chunk is a character, too
        longest = min(self.longest, width)
        # by chunk, node from 1, length of the piece that ends there: row of the piece's table, -1 for none
        piece = np.full((len(chunks), width, longest), -1, np.int32)
        inside = np.arange(1, width + 1) <= n[:, None]
        for k, h in enumerate(substrings(c, longest)):
            ends = inside[:, k:]
            found = np.full(h.shape, -1, np.int32)
            found[ends] = self.table.find(h[ends])
            piece[:, k:, k] = found
        weight = np.where(piece >= 0, self.row_weight[piece], -np.inf)
        bare = inside & (piece[:, :, 0] < 0)
        size = np.where(plain < 0x80, 1, np.where(plain < 0x800, 2, np.where(plain < 0x10000, 3, 4)))
        weight[:, :, 0] = np.where(bare, self.byte_weight * size, weight[:, :, 0])
        a = np.full((len(chunks), width + longest), -np.inf)  # node j stands at column j + longest - 1
        a[:, longest - 1] = 0
        share = np.empty_like(weight)
        for j in range(1, width + 1):
            t = a[:, j - 1 : j + longest - 1][:, ::-1] + weight[:, j - 1]
            top = t.max(1, keepdims=True)
            top = np.where(np.isfinite(top), top, 0)
            e = np.exp(t - top)
            total = e.sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                a[:, j + longest - 1] = (top + np.log(total))[:, 0]
                share[:, j - 1] = np.cumsum(e, 1) / total
        i, j, k = np.nonzero((weight > -np.inf) & inside[:, :, None] & (np.arange(longest) <= np.arange(width)[:, None]))
        x = share[i, j, k].astype(np.float32)
        begins = np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        x[np.append(begins[1:], True)] = 2
        own = piece[i, j, k]
        ids = self.by_row[own].astype(np.int32)
        for q in np.flatnonzero(own < 0):
            ids[q] = self._spell(chunks[i[q]][j[q]])
        base = self.nodes + np.concatenate(([0], np.cumsum(n + 1)))
        first = np.zeros(int(n.sum()) + len(n), np.int32)  # a chunk's begin has no edge
        first[base[i[begins]] - self.nodes + j[begins] + 1] = self.share.n + np.flatnonzero(begins)
        self.first.extend(first)
        self.share.extend(x)
        self.back.extend(np.where(j == k, 0, k + 1))
        self.piece.extend(ids)
        self.last.update(zip(chunks, (base[:-1] + n).tolist()))

    def _add_long(self, chunk: str) -> None:
        first, share, back, piece, a = [0], [], [], [], [0.0]
        for j, edges in enumerate(self.lattice(chunk), 1):
            terms = [a[i] + w for w, i, _ in edges]
            top = max(terms)
            e = [math.exp(t - top) for t in terms]
            total, run = sum(e), 0.0
            a.append(top + math.log(total))
            first.append(self.share.n + len(share))
            for x, (w, i, k) in zip(e, edges):
                run += x / total
                share.append(run)
                back.append(j - i if i else 0)
                piece.append(k[0] if i < j - 1 or chunk[i:j] == self.spelled[k[0]].decode("utf-8", "replace") else self._spell(chunk[i]))
            share[-1] = 2.0
        self.last[chunk] = self.nodes + len(chunk)
        for g, v in ((self.first, first), (self.share, share), (self.back, back), (self.piece, piece)):
            g.extend(v)

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
        """Ids of a sampled segmentation of each text."""
        chunks = [CHUNK.findall(t) for t in texts]
        need = set().union(*chunks) - self.last.keys() if chunks else set()
        if self.nodes + sum(map(len, need)) + len(need) > self.max_nodes:
            self._clear()
            need = set().union(*chunks)
            size = sum(map(len, need)) + len(need)
            if size > self.max_nodes and len(texts) > 1:  # too much for one batch
                half = len(texts) // 2
                return self.encode(texts[:half], keys[:half], seed) + self.encode(texts[half:], keys[half:], seed)
        self._add(sorted(need))
        n = np.array([len(c) for c in chunks])
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        node = np.fromiter(map(self.last.__getitem__, chain.from_iterable(chunks)), np.int64, total)
        place = np.arange(total) - np.repeat(ends - n, n)
        start = mixed(keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 2 + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        state = mixed(np.repeat(start, n) + place.astype(np.uint64) * _ODD)
        first, share, back = self.first.view, self.share.view, self.back.view
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        open_ = np.arange(total)
        while len(open_):
            state = state + _ODD
            u = ((mixed(state) >> np.uint64(40)).astype(np.float32)) * np.float32(2.0**-24)
            edge = first[node]
            below = np.flatnonzero(share[edge] <= u)
            while len(below):
                edge[below] += 1
                below = below[share[edge[below]] <= u[below]]
            steps.append((open_, edge))
            far = back[edge]
            more = far > 0
            open_, node, state = open_[more], (node - far)[more], state[more]
        length = np.zeros(total, np.int64)
        for o, _ in steps:
            length[o] += 1
        stop = np.cumsum(length)
        path = np.zeros(int(stop[-1]) if total else 0, np.int64)
        for t, (o, edge) in enumerate(steps):  # the first step is the last piece
            path[stop[o] - 1 - t] = edge
        ids = self.piece.view[path]
        many = np.ones(len(ids), np.int64)
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            many[bare] = self.spelt_many[-1 - ids[bare]]
            wide = np.repeat(np.cumsum(many) - many, many)
            spread = np.repeat(ids, many)
            q = np.flatnonzero(spread < 0)
            spread[q] = self.spelt_ids[-1 - spread[q], q - wide[q]]
            ids = spread
        at = np.concatenate(([0], np.cumsum(many, dtype=np.int64)))[np.concatenate(([0], stop))]
        cuts = at[np.concatenate(([0], ends))] if len(ends) else at[:1]
        return [ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


@lru_cache(2)
def sampler(path: str, alpha: float) -> Sampler:
    return Sampler(path, alpha)


def encode_documents(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text. doc_id, ids array<int>; the sample is seeded by doc_id."""
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", F.xxhash64("doc_id").alias("key"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = sampler(model, alpha).encode([t or "" for t in b.column(2).to_pylist()], b.column(1).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids -> doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sampler(model, ALPHA)
            texts = [None if x is None else s.decode(x).decode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


DIGEST = "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean"


def digest_partition(model: str, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(model, alpha)
        low, high = min(s.byte), max(s.byte)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.bool_()]
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            rows = []
            for d, t, ids in zip(b.column(0).to_pylist(), texts, s.encode(texts, b.column(1).to_numpy(), seed)):
                raw, back = t.encode("utf-8", "surrogatepass"), s.decode(ids.tolist())
                rows.append((d, len(raw), len(ids), int(((ids >= low) & (ids <= high)).sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), raw == back))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("key"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(digest_partition(default_model(), ALPHA, SEED), DIGEST)


QUERIES = {"op9_sampled_pieces": op9_sampled_pieces}
ORACLES: dict[str, str] = {}
