"""Media, suffix dedup, packing, pieces: exact round trips and brute force."""

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import mpeg, packing, pieces, repeats

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "é" * 937, "z" * 936 + "é", "\x00\x00", "long " * 40_000]


@pytest.mark.parametrize("text", TEXTS)
def test_media_round_trip(text):
    n, data = mpeg.padded(text)
    p = mpeg.probe(mpeg.encode(data))
    assert p.payload == data and len(data) % 64 == 0 and len(data) >= max(64, n) and p.crc_bad == 0 and p.crc_checked == p.frames + 1
    assert p.table == "Xing" and p.table_ok and p.skipped == 0 and p.samples == 1152 * p.frames
    assert len(p.offsets) == p.frames == -(-len(data) // mpeg.FULL)


def test_media_resync_tags_and_damage():
    media = mpeg.encode(bytes(range(1, 200)) * 40)
    clean = mpeg.probe(media)
    junk = mpeg.probe(b"\xff\xfa junk \xff" + media[media.index(b"\xff\xfa") :] + b"TAG" + bytes(125))
    assert junk.frames == clean.frames and junk.skipped == 9
    broken = bytearray(media)
    broken[int(clean.offsets[2]) + 7] ^= 1  # side information
    assert mpeg.probe(bytes(broken)).crc_bad == 1
    lost = bytearray(media)
    lost[int(clean.offsets[2])] = 0  # a sync byte
    p = mpeg.probe(bytes(lost))
    assert p.frames == clean.frames - 1 and p.skipped == mpeg.SIZES[14] and not p.table_ok
    for junk in (b"", b"\xff", b"ID3", b"no audio at all", bytes(500)):
        assert mpeg.probe(junk).frames == 0
    assert mpeg.crc16(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0xAEE7  # CRC-16/CMS
    h = mpeg.header(bytes((0xFF, 0xF3, 0x90, 0xC4)))  # MPEG-2 Layer III, 80 kbit/s, 22.05 kHz
    assert (h.version, h.layer, h.rate, h.size, h.samples) == (2, 3, 22050, 261, 576)


def test_media_columns(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab")), (2, None)], "k int, data binary")
    r = {x.k: x for x in df.select("k", mpeg.probe_media(mpeg.encode_bytes(F.col("data"))).alias("p"), mpeg.probe_media(F.col("data")).alias("q")).collect()}
    assert bytes(r[1].p.payload) == b"ab" and bytes(r[2].p.payload) == b"" and r[2].q.frames is None and r[1].q.frames == 0
    assert r[1].p.duration_us == 24_000 and len(r[1].p.seek_offsets) == 1


def brute_repeats(rows):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in order:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - repeats.LENGTH + 1):
            w = b[s : s + repeats.LENGTH]
            if w in seen:
                cover[s : s + repeats.LENGTH] = b"\x01" * repeats.LENGTH
            else:
                seen[w] = 1
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[d] = (len(b), sum(cover), sum(1 for x in bytes(cover).split(b"\0") if x), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 9)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared = [para(40) for _ in range(6)]
    rows = [(None, shared[0]), (0, ""), (1, None), (2, "ab" * 400), (3, "ab" * 300 + para(9)), (4, "x" * 99), (5, "x" * 100), (6, "x" * 101)]
    for i in range(7, 40):
        parts = [rng.choice(shared) if rng.random() < 0.5 else para(rng.randint(1, 60)) for _ in range(rng.randint(1, 5))]
        rows.append((i, "\n".join(parts)))
    return rows + [(50, rows[20][1]), (51, rows[20][1][30:]), (52, "q" + rows[20][1])]


@pytest.mark.parametrize(("hot", "loose"), [(repeats.HOT, repeats.LOOSE), (1, 2), (repeats.HOT, 1), (2, 3)])
def test_suffix_dedup_against_all_windows(spark, hot, loose):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("sha", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup_bytes(df, hot=hot, loose=loose).collect()}
    assert got == brute_repeats(rows)


def test_suffix_dedup_repeated_rows_and_empty(spark):
    t = "some passage that is long enough to be found again, as it has far more than one hundred bytes in all of it, yes"
    df = spark.createDataFrame([(1, t), (1, t), (1, t + "!"), (2, t)], "doc_id long, text string")
    r = repeats.dedup_bytes(df).collect()
    assert sorted((x.doc_id, x.n_removed) for x in r)[-1] == (2, len(t)) and sum(x.n_removed == 0 for x in r if x.doc_id == 1) in (1, 2)
    assert repeats.dedup_bytes(df.limit(0)).count() == 0


def test_long_text_in_parts(monkeypatch):
    t = [bytes(random.Random(4).choices(b"abcdefgh", k=9000))]
    whole = repeats.sample_texts(t)
    monkeypatch.setattr(repeats, "BLOCK", 1500)
    parts = repeats.sample_texts(t)
    key = lambda x: {(int(p), int(h), int(c)) for p, h, c in zip(x[1], x[2], x[3])}
    assert key(whole) == key(parts)


def test_hot_passage_sends_one_row_to_its_bucket():
    """A passage that all documents of a task hold, each in other surroundings: its bucket gets a row that says so, the rest is spread."""
    import pyarrow as pa

    rng = random.Random(5)
    passage, n, buckets = bytes(rng.choices(b"abcdefgh", k=140)), 2000, 64
    texts = [(b"%07d " % i + passage).decode() for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(texts)], ["doc", "sha", "text"])
    sent, opened = collections.Counter(), collections.Counter()
    for out in repeats.sample_partition(buckets)([batch]):
        for bucket, payload in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            r = repeats._rows(payload, repeats._ROW)
            sent[bucket] += len(r)
            opened.update(r["h"][np.isin(r["kind"], (repeats.OPEN, repeats.TOLD))].tolist())
    assert sum(sent.values()) >= n and max(opened.values()) < repeats.LOOSE
    assert max(sent.values()) < 4 * sum(sent.values()) / buckets


def test_cover_sample_is_in_every_window():
    b = np.frombuffer(bytes([repeats.PAD]) * 100 + bytes(random.Random(2).choices(b"ab", k=3000)) + bytes([repeats.PAD]) * 100, np.uint8)
    at = repeats.sampled(b, repeats.hashes(b))
    for s in range(100, 3000 + 100 - repeats.LENGTH + 1):
        assert ((at >= s) & (at <= s + repeats.SPAN)).any()


def check_pieces(rows, texts, tok, limits=(4096, 256)):
    seqs, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    tokens = padding = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= limits[0] and len(s) <= limits[1]
        tokens += at
        padding += 0 if at & (at - 1) == 0 else limits[0] - at
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        at = 0
        for start, n, crc, total in sorted(docs[d]):
            assert start == at and total == len(ids) // 4 and crc == zlib.crc32(ids[4 * start : 4 * (start + n)])
            at += n
        assert at == len(ids) // 4
    return padding / max(1, tokens)


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    al = "aAéÉßſKİΣσς'stredm1٣½ \n\t\x1c.,<|endoftext|>ªµ☃🙂!&"
    texts = {i: "".join(rng.choice(al) for _ in range(rng.randint(0, 300))) for i in range(120)}
    texts |= {200: None, 201: "", 202: "word " * 9000, 203: "it's <|endoftext|>don't"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack_documents(df.repartition(2), packing.default_tokenizer()).collect()
    assert check_pieces(rows, texts, Tokenizer.from_file(packing.default_tokenizer())) < 0.01
    assert packing.pack_documents(df.limit(0), packing.default_tokenizer()).count() == 0
    # a column says what bears loss; 'word ' * 9000 is loss throughout, so its sequences are short of other tokens
    r = packing.pack_documents(df.withColumn("prompt", F.lit(0)), packing.default_tokenizer(), F.col("prompt")).collect()
    assert all(x.loss_tokens == x.length for x in r)
    with pytest.raises(ValueError):
        packing.Words.PROBES, old = (*packing.Words.PROBES, "a b"), packing.Words.PROBES
        w = packing.words(packing.default_tokenizer())
        try:
            w.__class__._resolve, keep = (lambda self, words: {x: b"" for x in words}), w.__class__._resolve
            packing.Words(packing.default_tokenizer())
        finally:
            packing.Words._resolve, packing.Words.PROBES = keep, old


def test_packing_query_limits(spark, tmp_path):
    """All three limits, by brute force on the query's rows; the loss limit binds."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["word", "a", "paragraph", "é"]) for _ in range(rng.choice([3, 200, 900, 6000]))) for i in range(150)} | {500: None, 501: ""}
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op7_packing(spark, str(tmp_path)).collect()
    assert check_pieces(rows, texts, Tokenizer.from_file(packing.default_tokenizer())) < 0.01
    loss = collections.Counter()
    for r in rows:
        own = r.length - min(r.length, max(0, r.doc_tokens // 2 - r.start))
        assert r.loss_tokens == own
        loss[r.sequence_id] += own
    assert max(loss.values()) == packing.MAX_LOSS < packing.MAX_TOKENS


def test_words_are_asked_together():
    """New words of letters go to the tokenizer as one text, none a second time for its case or marks; ids are the tokenizer's, whatever ends a word."""
    w = packing.Words(packing.default_tokenizer())
    encode, asked = w.encode, []
    w.encode = lambda texts, **k: asked.extend(texts) or encode(texts, **k)
    want = lambda t: np.array(w.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abdeghinorstué") for _ in range(9)) for _ in range(3000)})
    texts = [" ".join(names), "\n".join(x.title() + rng.choice(["", ",", ".", "!!"]) for x in names)]
    assert w.ids(texts[:1]) == [want(texts[0])] and len(asked) < 10
    before = len(asked)
    assert w.ids(texts[1:]) == [want(texts[1])] and len(asked) < before + 10
    for digit in ("the", names[0]):  # found in the text as a word; several ids
        w.young, w.old, w.DIGIT, w.digit = {}, {}, digit, w.tok.encode(digit, add_special_tokens=False).ids
        assert w.ids(["the", "of the, and other words"]) == [want("the"), want("of the, and other words")]


def test_words_of_arrow_columns():
    """Nulls, slices, either width of offsets, no rows, and a cache that turns over."""
    import pyarrow as pa

    w = packing.Words(packing.default_tokenizer(), cache=50)
    rng = random.Random(6)
    al = "aAéÉßſKİΣσς'str0½ \n\t,.<|endoftext|>ª☃!&\x00\u0301\u1100\u1161日가 \u00a0_"
    for k in range(300):
        texts = [rng.choice([None, "", "".join(rng.choice(al) for _ in range(90)), " ".join(rng.choice(["don't", "0", "WORD!!", "|", "ΑΣ", "e\u0301"]) for _ in range(30))]) for _ in range(k % 7)]
        column = pa.array(["x", *texts, "y"], [pa.string(), pa.large_string()][k % 2])[1 : 1 + len(texts)]
        assert w.ids(column) == [np.array(w.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packer_limits():
    p = packing.Packer(0, max_tokens=64, max_segments=3, max_loss=40, buffer=16)
    rng, out, size = random.Random(1), [], {}
    for k in range(200):
        n = rng.randint(1, 150)
        size[k] = (n, rng.randint(0, n))
        out += p.put(k, struct.pack(f"<{n}I", *range(n)), size[k][1])
    out += p.finish()
    by, total = collections.defaultdict(list), collections.Counter()
    for k, start, n, seq, _, _, _, loss in out:
        assert loss == n - min(n, max(0, size[k][1] - start))
        by[seq].append((n, n - min(n, max(0, size[k][1] - start))))
        total[k] += n
    assert total == {k: n for k, (n, _) in size.items()}
    assert all(sum(n for n, _ in s) <= 64 and len(s) <= 3 and sum(loss for _, loss in s) <= 40 for s in by.values())


@pytest.fixture(scope="module")
def sampler():
    return pieces.Sampler(pieces.default_model())


def paths(s, chunk):
    lattice = s.lattice(chunk)

    def go(j):
        if not j:
            yield 0.0, ()
            return
        for w, i, k in lattice[j - 1]:
            for a, p in go(i):
                yield a + w, p + k

    x = list(go(len(chunk)))
    z = sum(math.exp(a) for a, _ in x)
    return {p: math.exp(a) / z for a, p in x}


@pytest.mark.parametrize("chunk", [" then", "  the", "é▁x"])
def test_sampled_frequencies(sampler, chunk):
    want, n = paths(sampler, chunk), 40_000
    got = collections.Counter(tuple(x.tolist()) for x in sampler.encode([chunk] * n, np.arange(n)))
    assert set(got) <= set(want) and max(abs(want[p] - got[p] / n) for p in want) < 0.015


def test_pieces_lossless_and_reproducible(sampler, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ▁\n\x00é日🙂.\uffff\ud800t") for _ in range(rng.randint(0, 120))) for _ in range(400)] + ["x" * 5000, "", "\n\n", "   "]
    keys = np.arange(len(texts))
    ids = sampler.encode(texts, keys)
    assert all(sampler.decode(i.tolist()) == t.encode("utf-8", "surrogatepass") for i, t in zip(ids, texts))
    other = pieces.Sampler(pieces.default_model(), max_nodes=15_000)
    monkeypatch.setattr(pieces, "WIDTHS", (8,))  # longer chunks go the other way
    again = [other.encode([t], np.array([k]))[0] for t, k in zip(texts, keys)]
    assert sum(len(a) == len(b) and (a == b).all() for a, b in zip(ids, again)) >= len(texts) - 2


def test_pieces_columns(spark):
    df = spark.createDataFrame([(1, "Hello  wörld\n▁"), (1, "Hello  wörld\n▁"), (2, None), (None, "a")], "doc_id long, text string")
    e = pieces.encode_documents(df, pieces.default_model())
    rows = e.collect()
    assert len({tuple(r.ids) for r in rows if r.doc_id == 1}) == 1
    back = [(r.doc_id, r.text) for r in pieces.decode_documents(e, pieces.default_model()).collect()]
    assert sorted(back, key=str) == sorted([(1, "Hello  wörld\n▁"), (1, "Hello  wörld\n▁"), (2, ""), (None, "a")], key=str)
