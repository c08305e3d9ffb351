"""Packing: vector bin packing of tokenized examples into sequences under limits on tokens, segments and loss-bearing tokens.

``Packer`` opens one sequence at a time and places the example whose vector of sizes has the largest dot product with the room left (each
dimension as a share of its limit) among those that fit; what room remains is filled with a piece cut from the example with the largest
product. Loss counts twice in the product, as tokens and as loss, so it is placed before prompts, which can always fill what room is left beside it. An example
longer than half a sequence is held as parts of its prompt and of its response, each of which an empty sequence can take. The last examples of a task are cut into sequences of 2^k
tokens, which need no padding.

Which tokens bear loss is a column (``loss_from``: so many ids before them don't). Without it, as in the query and the pipeline, an example is taken as a prompt and a
response of equal length: ids from the place floor(n / 2) on bear loss, of n with the closing id. A sequence has at most ``MAX_LOSS`` of them.

``tokenize`` and packing run in one pass over the scan's partitions: no text or token is shuffled, and a task holds ``BUFFER`` examples or ``HOLD`` ids at
most, besides the one it reads. A task's sequences have ids of their own (its partition, then a counter), so a task that is run again gives the same rows.

Defined results: a null text counts as empty, an empty text is the closing id alone; equal rows are examples of their own; a null doc_id is kept; further
columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, table

MAX_TOKENS = 4096
MAX_SEGMENTS = 256
MAX_LOSS = 2560
END_ID = 2
#: Examples that a task holds to choose from.
BUFFER = 512
#: Ids of which a task places some as soon as it holds them.
HOLD = 1 << 20
#: Words whose ids are kept; two generations, so the older half goes when the younger is full.
CACHE = 500_000
#: Words of letters that are encoded as one text, at most.
JOINED = 1024


class Words:
    """Ids of texts, as little-endian uint32 bytes, word by word with a bounded cache.

    Spaces and newlines never are within a token of this tokenizer nor within anything it normalises, and it has no upper case, so ids of a text are those of its parts.
    A tokenizer that encodes any of ``PROBES`` otherwise than whole is refused.

    A batch is split, looked up and put together by Arrow's kernels; Python sees each distinct word of a batch once, without case and marks.
    """

    PROBES = (
        "Hello World hello", "ÉCOLE Naïve été", "a-b, c.d! (x) [y] {z}\nnew  line\tTab \n\n end", "don't DON'T o'clock", "<s> </s> [INST] ok", "日本語 テスト Ω ß ſ İ é", "x=1;y_2 #tag @me $5 % ^ & * ~ `q` \"r\"",
        "  two  spaces", "1,234.56 --- ... !!", "Word.Word,word. A.B.", "\u00a0nbsp\u2009thin 🙂🙂x", "",
    )

    LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
    MARKS = "!#$%&()*+,-./:;=?@[\\]^_`{}~\""  # apostrophes and what begins a special token are not among them
    #: A word of Latin letters, then marks, is two token groups, and lower case is that of its letters.
    SIMPLE = rf"\A(?P<core>[{LETTERS}]+)(?P<marks>[{''.join(chr(92) + c for c in MARKS)}]*)\z"
    #: What follows each of the words of letters that are encoded as one text.
    DIGIT = "0"

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok, self.cache = Tokenizer.from_file(path), cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.digit = self.tok.encode(self.DIGIT, add_special_tokens=False).ids
        for t in self.PROBES:
            if self.ids([t])[0] != array("I", self.tok.encode(t, add_special_tokens=False).ids).tobytes():
                raise ValueError(f"{path} encodes {t!r} otherwise than word by word")

    def _apart(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encode(words, add_special_tokens=False)] if words else []

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded as one text in which DIGIT follows each: its id ends a word, and where it is found more often, or is none of its own, words are encoded apart."""
        (e,) = self.encode([f" {self.DIGIT} ".join([*words, ""])], add_special_tokens=False)
        ids = array("I", e.ids)
        ends = np.flatnonzero(np.frombuffer(ids, np.uint32) == self.digit[0]).tolist() if len(self.digit) == 1 else []
        if len(ends) != len(words):
            return self._apart(words)
        data = ids.tobytes()
        return [data[4 * a : 4 * z] for a, z in zip([0, *(z + 1 for z in ends)], ends)]

    def _resolve(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words that aren't cached."""
        letters, others = [], []
        for w in words:
            (letters if w.isalpha() else others).append(w)
        out = dict(zip(others, self._apart(others)))
        for i in range(0, len(letters), JOINED):
            some = letters[i : i + JOINED]
            out.update(zip(some, self._together(some)))
        return out

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        young, old = self.young, self.old
        young[""] = b""
        out = list(map(young.get, words))
        fresh = [i for i, x in enumerate(out) if x is None]
        for i in fresh:
            out[i] = old.get(words[i])
        found = self._resolve([words[i] for i in fresh if out[i] is None])
        for i in fresh:
            if out[i] is None:
                out[i] = found[words[i]]
            young[words[i]] = out[i]
        if len(young) > self.cache:
            self.old, self.young = young, {}
        return out

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; a null text counts as empty."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        split = parts.flatten().dictionary_encode()
        simple = pc.extract_regex(split.dictionary, self.SIMPLE)
        core = pc.coalesce(pc.utf8_lower(pc.struct_field(simple, "core")), split.dictionary)
        marks = pc.fill_null(pc.struct_field(simple, "marks"), "")
        both = pa.concat_arrays([core, marks]).dictionary_encode()
        known = pa.array(self._look_up(both.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(both.indices)
        whole = pc.binary_join_element_wise(known[: len(core)], known[len(core) :], pa.scalar(b"", pa.large_binary()))
        placed = whole.take(split.indices)  # its values are the ids of all texts, one after another
        places = np.frombuffer(placed.buffers()[1], np.int64, len(placed) + 1, 8 * placed.offset)
        bounds = places[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)])].tolist()
        data = memoryview(placed.buffers()[2] or b"")
        return [bytes(data[a:z]) for a, z in zip(bounds, bounds[1:])]


@lru_cache(1)
def words(path: str) -> Words:
    return Words(path)


class Packer:
    """put() examples, then finish(); both yield pieces (key, start, length, sequence, offset, ids bytes, tokens of the example, tokens that bear loss)."""

    def __init__(self, first: int, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, buffer: int = BUFFER, hold: int = HOLD):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.max, self.sequence, self.buffer, self.hold, self.held = max_tokens, first, buffer, hold, 0
        self.items: list[list] = []  # [key, ids, start, end, loss_from] of what is not placed yet; ids of the example from loss_from on bear loss

    def put(self, key, ids: bytes, loss_from: int = 0) -> Iterator[tuple]:
        n = len(ids) // 4
        loss_from = min(max(loss_from, 0), n)
        cuts = [0, n] if n <= self.max // 2 else [*range(0, loss_from, self.max), *range(loss_from, n, int(min(self.limits[[0, 2]]))), n]
        self.items += [[key, ids, a, z, loss_from] for a, z in zip(cuts, cuts[1:])]
        self.held += n
        if len(self.items) >= self.buffer or self.held > self.hold:
            yield from self._fill(self.buffer // 2, self.hold // 2)

    def _sizes(self) -> np.ndarray:
        n = np.array([x[2:] for x in self.items], float).reshape(-1, 3)
        return np.stack([n[:, 1] - n[:, 0], np.ones(len(n)), np.maximum(0, n[:, 1] - np.maximum(n[:, 0], n[:, 2]))], 1)

    def _fill(self, keep: int, hold: int) -> Iterator[tuple]:
        """Whole sequences, as long as the tokens at hand fill one and more than keep examples, or more than hold tokens, wait."""
        sizes, limits = self._sizes(), self.limits
        alive = np.ones(len(self.items), bool)
        many = len(self.items)
        while (many > keep or self.held > hold) and self.held >= self.max:
            room, offset = limits.copy(), 0
            while room[0] >= 1 and room[1] >= 1:
                weight = room / (limits * limits)
                fits = alive & (sizes <= room).all(1)
                if fits.any() and (room[1] > 1 or sizes[fits, 0].max() >= room[0]):
                    i = int(np.where(fits, sizes @ weight, -1).argmax())
                    n = int(sizes[i, 0])
                else:  # the last room takes a piece of one that doesn't fit
                    able = alive if room[2] >= 1 else alive & (sizes[:, 0] > sizes[:, 2])
                    if not able.any():
                        break
                    i = int(np.where(able, np.minimum(sizes, limits) @ weight, -1).argmax())
                    n = int(min(sizes[i, 0], room[0], room[2] + sizes[i, 0] - sizes[i, 2]))
                item = self.items[i]
                loss = n - min(n, max(0, item[4] - item[2]))
                yield (item[0], item[2], n, self.sequence, offset, item[1], len(item[1]) // 4, loss)
                offset += n
                room -= (n, 1, loss)
                item[2] += n
                self.held -= n
                sizes[i] -= (n, 0, loss)
                if sizes[i, 0] <= 0:
                    alive[i] = False
                    many -= 1
            self.sequence += 1
        self.items = [x for x, a in zip(self.items, alive) if a]

    def finish(self) -> Iterator[tuple]:
        yield from self._fill(0, 0)
        left = self.held
        size, offset, segments = 0, 0, 0
        most = 1 << int(min(self.max, self.limits[2])).bit_length() - 1  # so many tokens are within each limit
        for key, ids, start, end, loss_from in self.items:
            while start < end:
                if offset == size or segments == self.limits[1]:
                    self.sequence += bool(size)
                    size, offset, segments = min(1 << left.bit_length() - 1, most), 0, 0
                k = min(end - start, size - offset)
                yield (key, start, k, self.sequence, offset, ids, len(ids) // 4, k - min(k, max(0, loss_from - start)))
                start, offset, left, segments = start + k, offset + k, left - k, segments + 1
        self.items, self.held = [], 0


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_partition(path: str, limits: dict):
    """For mapInArrow over (doc_id, text, loss_from)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        packer = Packer(TaskContext.get().partitionId() << 32, **limits)
        end = np.array([END_ID], "<u4").tobytes()

        def out(pieces) -> pa.RecordBatch:
            rows = [(k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)]), total, q, o, loss) for k, s, n, q, o, ids, total, loss in pieces]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(8)], [x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            keys, loss = b.column(0).to_pylist(), b.column(2).to_pylist()
            yield out([p for key, ids, at in zip(keys, w.ids(b.column(1)), loss) for p in packer.put(key, ids + end, len(ids) // 4 + 1 >> 1 if at is None else at)])
        yield out(list(packer.finish()))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, loss_from: Column | None = None, **limits: int) -> DataFrame:
    """PIECES of each document: its tokenizer ids and the closing id, cut and placed. loss_from: so many ids of a row bear no loss; where it is null, the first half doesn't."""
    small_batches(docs.sparkSession)
    at = F.lit(None) if loss_from is None else loss_from
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), at.cast("long").alias("loss_from")).mapInArrow(pack_partition(tokenizer, limits), PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
