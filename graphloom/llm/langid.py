"""Language ID: an interpolated Kneser-Ney character model per language, in sorted hash arrays.

Texts are read in lower case; all that isn't a letter is a space, and runs of spaces are one. Letters beyond 12 bits share 1,024 classes. The model of order ``ORDER``
is stored for all languages together: each n-gram that any language has seen, under a 64-bit hash, with its final interpolated log probability in each
language, and each context with its backoff weights. The hashes are sorted and indexed by their top bits, so a lookup is one or two probes of an array,
a batch of characters at a time.

The language is that of the lowest cross-entropy per character. Its score is the calibrated posterior: softmax over -T x cross-entropy, where T gives the
smallest log loss on documents that the counts haven't seen. ``rejected``: no letter, a score below ``MIN_SCORE``, or a
cross-entropy above ``SLACK`` times the worst of the calibration documents' 99.9 % - text of no language that was learned.

Discounts are (n1 + 1/2) / (n1 + 2 n2 + 1) of the numbers n1, n2 of n-grams seen once and twice, kept within ``DISCOUNTS``: an order all of whose n-grams are frequent, as
unigrams are in much text, still backs off, so each probability is above 0 and each entropy finite. A text is summed up by itself: its result doesn't depend on its batch.

The model is fitted on a bounded sample of labelled rows: about ``TRAIN_DOCS`` whole documents of each language, chosen by a hash of doc_id, a
fifth of them for calibration. Of an order at most ``MAX_GRAMS`` n-grams a language are stored, so what is broadcast is bounded: about 30 bytes an n-gram at
four languages. The rest (those that occur least) counts for discounts and lower orders all the same, and its mass goes to the backoff, so probabilities still add up to 1. On
the tables here no language comes near that number. Counts are summed by task before they are shuffled.

Defined results: a null text, or one without a letter, is ``und`` with score 0. A label that is null teaches nothing. Without any labelled document all
are ``und``. A null doc_id counts as the empty text for the held-out rule. Equal rows get equal results. Further columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import small_batches, table

ORDER = 4
TRAIN_DOCS = 8192
MAX_GRAMS = 1 << 18
DISCOUNTS = (0.05, 0.95)
MIN_SCORE = 0.5
SLACK = 1.5
UND = "und"
VOCABULARY = 512  # characters that the uniform model below the unigrams spreads over
_BITS = 12
_SPACE = 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def classes() -> np.ndarray:
    """Of each code point: its class, a space if it isn't a letter."""
    t = np.full(0x110000, _SPACE, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            t[c] = c if c < 0xC00 else 0xC00 + c % 1024
    return t


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the texts in a row, each begun with ORDER - 1 spaces; where each text's own begin; how many letters it has."""
    joint = ("\n" * (ORDER - 1)).join(["", *[t.lower() for t in texts]])
    raw = classes()[np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), np.uint32)]
    # lengths after lower(), which may change them
    n = np.array([len(t.lower()) for t in texts], np.int64)
    starts = np.cumsum(n + ORDER - 1) - n
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != _SPACE) | (raw[:-1] != _SPACE)
    pad = (starts[:, None] - np.arange(1, ORDER)).ravel()
    keep[pad] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    letters = np.concatenate(([0], np.cumsum(raw != _SPACE)))
    return raw[keep], at[starts], letters[starts + n] - letters[starts]


def grams(s: np.ndarray) -> np.ndarray:
    """The n-gram of order ORDER that ends at each place (0 before the first whole one), as one integer; its last k classes are the lowest 12 k bits."""
    g = np.zeros(len(s), np.uint64)
    for k in range(ORDER):
        g[ORDER - 1 :] |= s[ORDER - 1 - k : len(s) - k].astype(np.uint64) << np.uint64(_BITS * k)
    return g


def low(g: np.ndarray, k: int) -> np.ndarray:
    return g & np.uint64((1 << _BITS * k) - 1)


class Table:
    """Rows of values under sorted hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = keys.astype(np.uint64) * _ODD
        order = np.argsort(h)
        self.h, self.values = h[order], np.ascontiguousarray(values[order], np.float32)
        self.shift = np.uint64(64 - max(4, len(h).bit_length() + 1))
        self.first = np.searchsorted(self.h >> self.shift, np.arange((1 << int(64 - self.shift)) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for none."""
        h = keys * _ODD
        b = (h >> self.shift).astype(np.int64)
        at, end = self.first[b], self.first[b + 1]
        row = np.full(len(h), -1, np.int32)
        todo = np.flatnonzero(at < end)
        at = at[todo]
        while len(todo):
            hit = self.h[at] == h[todo]
            row[todo[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end[todo])
            todo, at = todo[go], at[go]
        return row


class Model:
    def __init__(self, langs: list[str], probabilities: list[Table], backoffs: list[Table]):
        self.langs, self.p, self.b = langs, probabilities, backoffs  # by order, from ORDER down to 1
        self.temperature, self.worst = 20.0, math.inf

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character of each text in each language; number of letters."""
        s, starts, letters = symbols(texts)
        g = grams(s)
        total = np.zeros((len(s), len(self.langs)), np.float32)
        todo = np.arange(len(s))
        for i, k in enumerate(range(ORDER, 0, -1)):
            keys = low(g[todo], k)
            row = self.p[i].find(keys)
            hit = row >= 0
            total[todo[hit]] += self.p[i].values[row[hit]]
            todo, keys = todo[~hit], keys[~hit]
            ctx = self.b[i].find(keys >> np.uint64(_BITS))
            has = ctx >= 0
            total[todo[has]] += self.b[i].values[ctx[has]]
        total[todo] -= math.log(VOCABULARY)
        ends = np.append(starts[1:] - (ORDER - 1), len(s))
        total = np.concatenate((total.astype(np.float64), np.zeros((1, len(self.langs)))))
        sums = np.add.reduceat(total, np.stack([starts, ends], 1).ravel(), 0)[::2] * (ends > starts)[:, None]
        return -sums / np.maximum(1, ends - starts)[:, None], letters


def discount(n: np.ndarray) -> float:
    n1, n2 = int((n == 1).sum()), int((n == 2).sum())
    return min(max((n1 + 0.5) / (n1 + 2 * n2 + 1), DISCOUNTS[0]), DISCOUNTS[1])


def _stored(keys: np.ndarray, n: np.ndarray, most: int, suffixes: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Places of the n-grams to store: of those whose suffix is stored, the most frequent."""
    at = np.flatnonzero(np.isin(suffixes, below))
    return at if len(at) <= most else np.sort(at[np.lexsort((keys[at], -n[at]))[:most]])


def kneser_ney(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], max_grams: int = MAX_GRAMS) -> Model:
    """counts: n-grams of order ORDER and how often each language has them.

    Of each order all n-grams of any language get their final probability in every language, so scoring adds up no mixtures.
    """
    # by language and order: n-grams, their counts (below the highest order: of distinct n-grams that end with them)
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for keys, n in counts:
        own = [(keys, n.astype(float))]
        for k in range(ORDER - 1, 0, -1):
            u, c = np.unique(low(own[-1][0], k), return_counts=True)
            own.append((u, c.astype(float)))
        levels.append(own[::-1])  # order 1 first
    tables_p, tables_b = [], []
    below_keys, below = np.zeros(1, np.uint64), np.full((1, len(langs)), 1 / VOCABULARY)
    for k in range(1, ORDER + 1):
        kept = [_stored(*own[k - 1], max_grams, low(own[k - 1][0], k - 1), below_keys) for own in levels]
        u = np.unique(np.concatenate([own[k - 1][0][i] for own, i in zip(levels, kept)])) if langs else np.zeros(0, np.uint64)
        contexts = np.unique(u >> np.uint64(_BITS))
        p, gamma = np.zeros((len(u), len(langs))), np.ones((len(contexts), len(langs)))
        for j, (own, i) in enumerate(zip(levels, kept)):
            keys, n = own[k - 1]
            d = discount(n)
            # of each context: all that follows it, also what isn't stored, whose mass the backoff gets
            c = np.searchsorted(contexts, keys >> np.uint64(_BITS))
            has = contexts[np.minimum(c, len(contexts) - 1)] == keys >> np.uint64(_BITS)
            total = np.bincount(c[has], n[has], len(contexts))
            stored = np.bincount(c[i], n[i] - d, len(contexts))
            seen = total > 0
            gamma[seen, j] = 1 - stored[seen] / total[seen]
            p[np.searchsorted(u, keys[i]), j] = (n[i] - d) / total[c[i]]
        lower = below[np.searchsorted(below_keys, low(u, k - 1))]
        p += gamma[np.searchsorted(contexts, u >> np.uint64(_BITS))] * lower
        if not (np.isfinite(np.log(p)).all() and np.isfinite(np.log(gamma)).all()):
            raise ArithmeticError(f"a probability of order {k} is 0")
        tables_p.append(Table(u, np.log(p)))
        tables_b.append(Table(contexts, np.log(gamma)))
        below_keys, below = u, p
    return Model(langs, tables_p[::-1], tables_b[::-1])


def count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (lang, text): sums of n-grams by language in this task."""
    held: dict[str, list] = {}
    for b in batches:
        by: dict[str, list[str]] = {}
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).append(t)
        for lang, texts in by.items():
            s, starts, _ = symbols(texts)
            own = np.ones(len(s), bool)
            own[(starts[:, None] - np.arange(1, ORDER)).ravel()] = False
            u, n = np.unique(grams(s)[own], return_counts=True)
            parts = held.setdefault(lang, [])
            parts.append((u, n))
            if len(parts) > 16:
                held[lang] = [_added(parts)]
    for lang, parts in held.items():
        u, n = _added(parts)
        for i in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u[i : i + 50_000])), pa.array(u[i : i + 50_000].astype(np.int64)), pa.array(n[i : i + 50_000].astype(np.int64))], ["lang", "gram", "n"])


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    u, i = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return u, np.bincount(i, np.concatenate([x[1] for x in parts])).astype(np.int64)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, max_grams: int = MAX_GRAMS) -> Model:
    """docs: doc_id, lang, text. Learns from rows with a label that aren't held out."""
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(many)
    if not langs:
        return kneser_ney([], [])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in many.items() for x in (k, int(1_000_003 * min(1.0, train_docs / n)) + 1)]), F.col("lang"))
    picked = rows.where(draw < share).select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(5)) == 0).alias("calibrates"))
    if any(n < 20 for n in many.values()):  # too few to set some aside: all are counted
        counted, other = picked, picked
    else:
        counted, other = picked.where("NOT calibrates"), picked.where("calibrates")
    sums = counted.select("lang", "text").mapInArrow(count_partition, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    t = sums.toArrow()
    lang, gram, n = t["lang"].to_numpy(), t["gram"].to_numpy(), t["n"].to_numpy()
    counts = []
    for x in langs:
        own = lang == x
        g, k = gram[own].astype(np.uint64), n[own]
        order = np.argsort(g)
        counts.append((g[order], k[order]))
    model = kneser_ney(counts, langs, max_grams)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    c = other.select("lang", "text").mapInArrow(_entropy_partition(shared), "lang string, letters long, ce array<double>").where("letters > 0").toArrow()
    if len(c):
        ce = np.array(c["ce"].to_pylist())
        truth = np.searchsorted(langs, c["lang"].to_pylist())
        model.worst = float(np.quantile(ce.min(1), 0.999)) * SLACK

        def loss(temperature: float) -> float:
            z = -temperature * (ce - ce.min(1, keepdims=True))
            return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean())

        model.temperature = min((1.0, 2.0, 4.0, 8.0, 12.0, 16.0, 24.0, 32.0), key=loss)
    return model


def _entropy_partition(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ce, letters = shared.value.entropies(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(letters), pa.array(list(ce), pa.list_(pa.float64()))], ["lang", "letters", "ce"])

    return run


PREDICTED = "lang_pred string, score double, cross_entropy double, rejected boolean"


def predict_texts(model: Model, texts: list[str | None]) -> list[tuple]:
    out: list[tuple] = [(UND, 0.0, None, True)] * len(texts)
    has = [i for i, t in enumerate(texts) if t]
    if not has or not model.langs:
        return out
    ce, letters = model.entropies([texts[i] for i in has])
    best = ce.argmin(1)
    least = ce[np.arange(len(ce)), best]
    score = 1 / np.exp(-model.temperature * (ce - least[:, None])).sum(1)
    for j, i in enumerate(has):
        if letters[j]:
            out[i] = (model.langs[best[j]], float(score[j]), float(least[j]), bool(score[j] < MIN_SCORE or least[j] > model.worst))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, which must have text, and those of PREDICTED, which take the place of columns with their names."""
    docs = docs.drop(*[x.split()[0] for x in PREDICTED.split(", ")])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PREDICTED.split(", ")]
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        for b in batches:
            rows = predict_texts(shared.value, b.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], [*b.schema.names, *names])

    schema = T.StructType(list(docs.schema.fields))
    for x in PREDICTED.split(", "):
        schema = schema.add(*x.split())
    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and PREDICTED; of a text only its result leaves the Python worker."""
    d = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = predict_texts(shared.value, b.column(2).to_pylist())
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "held_out", *[x.split()[0] for x in PREDICTED.split(", ")]])

    return d.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, {PREDICTED}")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return scored(docs, fit(docs))


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
