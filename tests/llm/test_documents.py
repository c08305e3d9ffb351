"""Fingerprints, line dedup, secrets, near dedup, language ID, chat: brute force on small tables with nulls, ties and repeated rows."""

import hashlib
import random
import re
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, langid, linedup, merkle, secrets, simhash
from graphloom.llm.common import release


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# fingerprints


def py_root(text):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    paragraphs = [md5("".join(md5(x) for x in phrases(p))) for p in text.split("\n")]
    sections, part = [], []
    for i, h in enumerate(paragraphs):
        part.append(h)
        if h[0] < "4" or i == len(paragraphs) - 1:
            sections.append(md5("".join(part)))
            part = []
    return hashlib.sha256("".join(sections).encode()).hexdigest()


def phrases(p):
    """Cut behind a space that follows what is neither letter nor digit, from left to right."""
    out, first, i = [], 0, 1
    while i < len(p):
        if p[i] == " " and i > first and not p[i - 1].isalnum():
            out.append(p[first : i + 1])
            first = i + 1
        i += 1
    return [*out, p[first:]] if p[first:] or not out else out


def test_merkle(spark):
    rows = [(5, "One. Two, three.\nFour."), (4, "One. Two, three.\nFour."), (3, None), (2, ""), (1, "é. x" * 20), (None, "last"), (5, "tie. a")]
    r = merkle.with_fingerprint(merkle.with_next(frame(spark, rows), rows=2), "text").collect()
    assert len(r) == len(rows) and all(x.fingerprint == py_root(x.text) for x in r)
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = sorted((a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((x.text, x.next_text) for x in r) == want
    assert merkle.with_next(frame(spark, rows).limit(0)).count() == 0
    assert [(x.text, x.next_text) for x in merkle.with_next(frame(spark, [(1, "a")])).collect()] == [("a", "a")]


def test_merkle_locates_edits(spark):
    a, b = "a. b. c.\nd. e.\nf.", "a. b. c.\nd. X.\nf."
    df = spark.createDataFrame([(a, b)], "a string, b string")
    h = lambda c: merkle.phrase_hashes(F.col(c))
    r = df.select(merkle.differing(merkle.paragraph_hashes(h("b")), merkle.paragraph_hashes(h("a"))).alias("d"), merkle.likeness(merkle.leaves(h("a")), merkle.leaves(h("b"))).alias("l"), merkle.likeness(merkle.leaves(h("a")), merkle.leaves(h("a"))).alias("same")).first()
    assert r.d == [1] and 0.7 < r.l < 1 and r.same == 1


def test_unequal_texts_have_unequal_roots(spark):
    """Also where they differ in control characters, separators and blanks only."""
    rng = random.Random(11)
    texts = {"a, b", "a,\x01b", "a,  b", "a,b", "", " ", "\n", "\n ", " \n", ". . ", ".  .", ". .\n"} | {"".join(rng.choice("a, \n\x01\x00.é") for _ in range(rng.randint(0, 9))) for _ in range(1500)}
    d = frame(spark, list(enumerate(texts)))
    r = merkle.with_fingerprint(d.withColumn("phrases", F.lit(1)), "text").collect()
    assert len({x.fingerprint for x in r}) == len(texts) and all(x.fingerprint == py_root(x.text) and all(x.phrases) for x in r)


def test_bounds_below(spark):
    for n in (1, 2, 5, 16, 37):
        bounds = sorted(random.Random(n).sample(range(100), n))
        got = spark.range(-2, 102).select("id", merkle._below(F.col("id"), bounds).alias("k")).collect()
        assert all(r.k == sum(b < r.id for b in bounds) for r in got)


def test_fingerprint_query(spark, tmp_path):
    rng = random.Random(12)
    texts = {i: None if i == 3 else "".join(rng.choice("ab. ,\n\x01é") for _ in range(rng.randint(0, 60))) for i in range(40)} | {90: "é. " * 5000}
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(texts, reverse=True)
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    leaves = lambda t: {x for p in t.split("\n") for x in phrases(p)}
    got = {r.doc_id: r for r in merkle.op3_merkle_fingerprint(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for i, d in enumerate(order):
        t, n = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), py_root(t), py_root(e))
        assert abs(r.near_edited - dice(leaves(t), leaves(e))) < 1e-12 and abs(r.near_next - dice(leaves(t), leaves(n))) < 1e-12


# line dedup


def py_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:6], 16) for x in lines]
    out, first = [], 0
    for i in range(len(lines)):
        roll = 0
        for k in range(linedup.WINDOW):
            j = i - (linedup.WINDOW - 1 - k)
            roll = roll * 31 + (h[j] if j >= 0 else 0)
        if i == len(lines) - 1 or (i + 1 >= linedup.WINDOW and roll % linedup.JOINS != 0):
            out.append((first, i + 1))
            first = i + 1
    return out


def brute_lines(rows):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        if t is None:
            out[d] = None
            continue
        lines, chunks, lost = t.split("\n"), py_chunks(t), set()
        runs = [c for c in chunks if c[1] - c[0] > 1] + [(a[0], b[1]) for a, b in zip(chunks, chunks[1:])]
        for a, z in sorted(runs):
            run = "\n".join(lines[a:z])
            if run in seen:
                lost |= set(range(a, z))
            seen.add(run)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in lost)
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    line = lambda: "".join(rng.choice("abc é") for _ in range(rng.randint(0, 12)))
    block = [line() for _ in range(30)]
    rows = [(0, None), (1, ""), (2, "\n\n\n\n\n\n"), (3, "\n".join(block)), (4, "\n".join(block)), (4, "\n".join(block))]
    for i in range(5, 30):
        at = rng.randint(0, 20)
        rows.append((i, "\n".join([line() for _ in range(rng.randint(0, 6))] + block[at : at + 12] + [line()])))
    df = frame(spark, rows).withColumn("removed", F.lit("clash")).withColumn("lines", F.lit(1))
    r = linedup.dedup_lines(df).collect()
    assert len(r) == len(rows) and r[0].lines == 1
    want = brute_lines(rows)
    assert {(x.doc_id, x.text) for x in r} == set(want.items())
    assert {(x.doc_id, x.text) for x in linedup.dedup_lines(df, hot_rows=2).collect()} == set(want.items())
    assert linedup.dedup_lines(df.limit(0)).count() == 0


def test_short_passages_are_caught(spark):
    """Passages of two to six lines in foreign surroundings: most of their lines go, and single repeated lines stay."""
    rng = random.Random(13)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    passages = [[line() for _ in range(rng.randint(2, 6))] for _ in range(60)]
    single = line()
    rows, want = [], 0
    for c in range(3):
        for i, p in enumerate(passages):
            rows.append((1000 * c + i, "\n".join([line(), line(), *p, line(), single, line()])))
            want += len(p) if c else 0
    kept = {x.doc_id: x.text for x in linedup.dedup_lines(frame(spark, rows)).collect()}
    lost = sum(len(set(p) - set(kept[1000 * c + i].split("\n"))) for c in (1, 2) for i, p in enumerate(passages))
    assert lost / want > 0.85 and all(set(p) <= set(kept[i].split("\n")) for i, p in enumerate(passages))
    assert all(single in t and len(t.split("\n")) >= 5 for t in kept.values())


def test_line_dedup_leaves_the_disk_to_the_next_step(spark):
    """When the result is read, the shuffle files of the steps are gone, and their tables but the one that it reads."""
    rng = random.Random(17)
    block = ["".join(rng.choice("abcdef") for _ in range(9)) for _ in range(40)]
    rows = [(i, "\n".join([f"{i} a", f"{i} b", *block[i : i + 6], f"{i} c"])) for i in range(30)]
    df = frame(spark, rows).repartition(3)
    tables = lambda: {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "graphloom").glob("line-*")}
    shuffles = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    release(spark)
    before, held = tables(), shuffles.size()
    r = linedup.dedup_lines(df)
    until = time.time() + 15
    while shuffles.size() > held and time.time() < until:
        time.sleep(0.2)
    assert shuffles.size() <= held
    assert [x.rpartition("-")[0] for x in tables() - before] == ["line-candidates"]
    got = {x.doc_id: x.text for x in r.collect()}
    assert got == {x.doc_id: x.text for x in r.collect()} == brute_lines(rows) and got != dict(rows)


# secrets


def test_secret_spans():
    t = "é PASSWORD = 'abcdefghijkl', token:short, api_key=\"ABCDEF123456\" AKIAABCDEFGHIJKLMN AKIAshort 0123456789abcdef0 token=secret=abcdefghijklmnop"
    got = [(secrets.KINDS[k], t[a:b]) for a, k, b, _ in secrets.find(t)]
    assert got == [("assign", "PASSWORD = 'abcdefghijkl"), ("assign", 'api_key="ABCDEF123456'), ("access", "AKIAABCDEFGHIJKLMN"), ("hex", "0123456789abcdef0"), ("assign", "token=secret=abcdefghijklmnop")]
    assert secrets.find(None) == [] and secrets.find("") == [] and not secrets.find("pa\u017f\u017fword=abcdefghijklmnop")


def test_secret_base_rules():
    rng = random.Random(1)
    plain = {0: re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1: re.compile("AKIA[A-Z0-9]+"), 2: re.compile("[0-9a-f]+")}
    for _ in range(300):
        t = "".join(rng.choice(["token", "=", ": ", "AKIA", "AK", "0f", "abc", "Z9", " ", "é", "'", "secret", "0123456789abcdef", "x.y-z"]) for _ in range(rng.randint(0, 25)))
        want = sorted((m.start(), k, m.end()) for k, p in plain.items() for m in p.finditer(t) if len(m[2] if k == 0 else m[0]) >= (12, 18, 16)[k])
        assert [(a, k, b) for a, k, b, _ in secrets.find(t) if k < 3] == want


def test_ownership(spark):
    live, copied = "password=aaaaaaaaaaaa", "password=bbbbbbbbbbbb"
    rows = [(i, copied, f"o{i % 3}", f"r{i}") for i in range(6)] + [(7, live + " " + copied, "o1", "r"), (7, live + " " + copied, "o1", "r"), (8, None, None, None), (None, "nothing", "o1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string").withColumn("spans", F.lit(0))
    r = secrets.scan(df, F.col("owner"), F.col("repo")).collect()
    assert len(r) == len(rows)
    by = {x.doc_id: x.spans for x in r}
    assert [(s.n_owners, s.n_repos, s.live) for s in by[7]] == [(1, 1, True), (3, 7, False)] and by[8] == [] and by[None] == []
    out = {x.doc_id: x.text for x in secrets.redact(df, F.col("owner"), F.col("repo")).collect()}
    assert out[7] == "[assign removed] " + copied and out[0] == copied and out[8] is None
    hot = secrets.redact(df, F.col("owner"), F.col("repo"), hot_rows=1)
    assert {x.doc_id: x.text for x in hot.collect()} == out
    assert secrets.scan(df.limit(0), F.col("owner"), F.col("repo")).count() == 0


def test_ownership_and_redaction_against_brute_force(spark, tmp_path):
    rng = random.Random(14)
    values = [f"password=value{i:08d}" for i in range(6)] + ["0123456789abcdef" * 2, "AKIA" + "B" * 16, "token = 0123456789abcdef0123", "eyJ0123456789.0123456789.0123456789 x"]
    rows = [(i, None if i == 5 else " é🙂 ".join(rng.choice([*values, "plain", "token=short", f"secret=own{i // 3:09d}"]) for _ in range(rng.randint(0, 4))), rng.choice([None, *"abcdefgh"]), rng.choice(["en", None])) for i in range(120)]
    rows += [(500, "x " * 100_000 + values[0], "a", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    owners, texts = defaultdict(set), defaultdict(set)
    for _, t, o, _ in rows:
        for *_, v in secrets.find(t):
            owners[v].add(o)
            texts[v].add(t)
    live = {v for v in owners if min(len(owners[v]), len(texts[v])) <= secrets.EXAMPLE_OWNERS}
    got = {r.doc_id: (r.n_live, r.n_copied, r.spans) for r in secrets.op5_secret_scan(spark, str(tmp_path)).collect()}
    assert live and live != set(owners)
    for i, t, *_ in rows:
        f = secrets.find(t)
        n = sum(v in live for *_, v in f)
        assert got[i] == (n, len(f) - n, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in f))
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.text for r in secrets.redact(df, F.col("source"), F.col("source"), secrets.EXAMPLE_OWNERS).collect()}
    for i, t, *_ in rows:
        want, at = "", 0
        for a, k, b, v in sorted(secrets.find(t), key=lambda f: (f[0], -f[2])):
            if v in live:
                if a >= at:
                    want += t[at:a] + f"[{secrets.KINDS[k]} removed]"
                at = max(at, b)
        assert out[i] == (None if t is None else want + t[at:])


def test_copies_of_a_document_are_not_examples(spark):
    """A value in copies of one document at two owners is live, in the pipeline also if a copy has lost lines."""
    import corpus_pipeline

    copy, cut, example = "a\npassword=aaaaaaaaaaaa", "password=bbbbbbbbbbbb", "password=cccccccccccc"
    rows = [(1, copy, "s1"), (2, copy, "s2"), (3, "x\n" + cut, "s1"), (4, cut, "s2")] + [(10 + i, f"{i} {example}", f"s{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(0).cast("long")})
    live = {x.doc_id: x.spans[0].live for x in secrets.scan(df, F.col("source"), F.col("source")).collect()}
    assert live[1] and live[2] and not live[3] and not live[10]
    out = {x.doc_id: x.text for x in corpus_pipeline.secret_scan(spark, df, "").collect()}
    assert out == {i: t if i >= 10 else t[: t.index("password")] + "[assign removed]" for i, t, _ in rows}


# near dedup


def near_corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows, n = [], 0
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for c in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(c * 2):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    return [*rows, (900, None), (901, None), (902, ""), (903, ""), (904, "?!"), (905, rows[0][1]), (905, rows[0][1]), (906, rows[0][1].upper())]


def brute_classes(sigs, k):
    """Classes and links of signatures, by all pairs."""
    bits = np.unpackbits(np.array(sigs, np.int64).view(np.uint8), axis=1).astype(int)
    d = (bits[:, None] != bits[None]).sum(2)
    label = list(range(len(sigs)))
    for i in range(len(sigs)):
        for j in range(len(sigs)):
            if d[i, j] <= k and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return d, label


@pytest.mark.parametrize("kw", [{}, {"bits": 10, "cap": 2}, {"tables": 40, "bits": 2, "cap": 4}])
def test_near_duplicates_against_all_pairs(spark, kw):
    rows = near_corpus()
    df = frame(spark, rows).repartition(3)
    sig = {(x.doc_id, x.text_sha): list(x.sig) for x in simhash.signatures(df).collect()}
    keys = sorted(sig)
    d, label = brute_classes([sig[k] for k in keys], simhash.MAX_DISTANCE)
    got = {(x.doc_id, x.text_sha): x for x in simhash.near_duplicates(df, **kw).collect()}
    assert {k for k in got if k[1] is not None} == set(keys) and got[900, None].class_id == 900 and got[901, None].n_links == 0
    mine = [got[k].class_id for k in keys]
    if not kw.get("bits") == 10:
        groups = defaultdict(set)
        for m, x in zip(mine, label):
            groups[x].add(m)
        assert all(len(v) == 1 for v in groups.values()) and len(set(mine)) == len(groups)
    for i, k in enumerate(keys):
        others = {tuple(sig[keys[j]]) for j in range(len(keys)) if 0 < d[i, j] <= simhash.MAX_DISTANCE}
        assert got[k].n_links <= len(others) and (kw.get("bits") == 10 or got[k].n_links == len(others))
    kept = [x.doc_id for x in simhash.keep_one(df, **kw).collect()]
    assert {0, 900, 901, 902} <= set(kept) and not {903, 905, 906} & set(kept)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_where_ids_clash(spark):
    """Unlike texts under one doc_id, or none, are documents and classes of their own."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    df = spark.createDataFrame([(5, a), (5, b), (None, c), (None, d), (7, a), (None, d + " x")], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=str)[:1] and set(kept) >= {(5, a), (5, b), (None, c)} and len(kept) == 4 and (7, a) not in kept
    r = simhash.near_duplicates(df).collect()
    assert len({x.class_key for x in r}) == 4


def test_near_dedup_query(spark, tmp_path):
    rows = [(i, t, "s") for i, t in near_corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op6_simhash_neardup(spark, str(tmp_path)).collect()
    sig = {(x.doc_id, x.text_sha): list(x.sig) for x in simhash.signatures(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    keys = sorted(sig)
    _, label = brute_classes([sig[k] for k in keys], simhash.MAX_DISTANCE)
    least = {}
    for k, x in zip(keys, label):
        least[x] = min(least.get(x, k[0]), k[0])
    want = sorted([(k[0], least[x]) for k, x in zip(keys, label)] + [(900, 900), (901, 901)])
    assert sorted((r.doc_id, r.class_id) for r in got) == want


def test_many_near_copies_are_not_expanded_into_pairs(spark, monkeypatch):
    """A class of m near copies gives rows in proportion to m, in each table that is written, and its class and links are those of all pairs."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([w for w in base if rng.random() > 0.03] + [f"x{i}"])) for i in range(1200)]
    rows += [(5000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    df = frame(spark, rows).repartition(3)
    written, kept = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda x, name: (r := kept(x, name), written.__setitem__(name, max(r.count(), written.get(name, 0))))[0])
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {0} | {5000 + i for i in range(300)}
    assert max(written.values()) < 40 * len(rows), written
    sigs = [list(r.sig) for r in simhash.signatures(df).where("doc_id < 5000").orderBy("doc_id").collect()]
    words = np.unique(np.array(sigs, np.int64), axis=0).view(np.uint64)
    want = {tuple(w): int((np.bitwise_count(words ^ w).sum(1) <= simhash.MAX_DISTANCE).sum()) - 1 for w in words}
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert all(got[i].class_id == 0 and got[i].n_links == want[tuple(np.array(sigs[i], np.int64).view(np.uint64))] for i in range(1200))


@pytest.mark.parametrize("heavy", [1, 3, 10**9])
def test_classes_against_all_pairs_whatever_is_heavy(spark, heavy):
    """Groups near one another, in a chain and apart: classes of many signatures meet each other and single signatures."""
    rng, bits = random.Random(17), range(simhash.BITS)
    flip = lambda s, k: s ^ sum(1 << c for c in rng.sample(bits, k))
    centre = [rng.getrandbits(simhash.BITS)]
    for step in (44, 50, 40, 60, 120, 40):
        centre.append(flip(centre[-1], step))
    sigs = sorted({flip(c, rng.randint(0, 6)) for c in centre for _ in range(25)} | {flip(c, 42) for c in centre} | {rng.getrandbits(simhash.BITS) for _ in range(30)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [[signed(s >> 64 * k & (1 << 64) - 1) for k in range(4)] for s in sigs]
    _, label = brute_classes(rows, simhash.MAX_DISTANCE)
    reps = spark.createDataFrame([(r,) for r in rows], "sig array<long>").repartition(3)
    named = {tuple(r.sig): r.rep for r in reps.withColumn("rep", simhash.name_of(simhash.words_of(F.col("sig")))).collect()}
    got = {r.node: r.label for r in simhash.classes(reps, len(rows), tables=45, bits=8, heavy=heavy).collect()}
    groups = defaultdict(set)
    for r, x in zip(rows, label):
        groups[x].add(named[tuple(r)])
    assert len(groups) < len(rows) - 150
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_signature_bits(spark):
    """Each bit is the majority over distinct words, also when votes are summed in parts."""
    text = " ".join(f"w{i}" for i in range(50)) + " W1 w2"
    df = frame(spark, [(1, text)])
    words = sorted({w for w in re.split(r"[^\w]+", text.lower())})
    h = spark.createDataFrame([(w,) for w in words], "w string").select(*[F.xxhash64("w", F.lit(s)).alias(f"h{i}") for i, s in enumerate(simhash.SEEDS)]).collect()
    got = [list(simhash.signatures(df).first().sig)]
    old, simhash.PART = simhash.PART, 7
    got.append(list(simhash.signatures(df).first().sig))
    simhash.PART = old
    for sig in got:
        for k in range(4):
            for b in range(64):
                votes = sum((x[k] >> b) & 1 for x in h)
                assert (sig[k] >> b) & 1 == (2 * votes > len(words)), (k, b)


def planted_links(spark, n, groups, **kw):
    """Share of the pairs within MAX_DISTANCE, of signatures in groups, that links gives at the bits of n signatures."""
    rng, bits = random.Random(9), range(simhash.BITS)
    sigs = []
    for size, radius in groups:
        base = rng.getrandbits(simhash.BITS)
        sigs += [base ^ sum(1 << c for c in rng.sample(bits, radius)) for _ in range(size)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [([signed(s >> 64 * k & (1 << 64) - 1) for k in range(4)],) for s in sigs]
    words = np.array([r[0] for r in rows], np.int64)
    want = sum(int((np.bitwise_count((words[i + 1 :] ^ words[i]).view(np.uint64)).sum(1) <= simhash.MAX_DISTANCE).sum()) for i in range(len(rows)))
    return simhash.links(spark.createDataFrame(rows, "sig array<long>").repartition(4), n, **kw).count() / want


def test_recall_holds_at_the_bits_of_many_signatures(spark):
    assert planted_links(spark, 200_000, [(2, 23)] * 300) > 0.95
    for n in (10_000, 200_000, 13_000_000):
        bits = simhash.table_bits(n)
        assert 1 - (1 - simhash.found(simhash.MAX_DISTANCE, bits)) ** simhash.table_count(bits) >= simhash.RECALL


def test_split_buckets_keep_links():
    """Recall of a group all of whose buckets are split, over the draws that the tables use."""
    rng, bits = random.Random(9), range(simhash.BITS)
    base = rng.getrandbits(simhash.BITS)
    sigs = [base ^ sum(1 << c for c in rng.sample(bits, 23)) for _ in range(300)]
    m = np.array([[s >> i & 1 for i in bits] for s in sigs], np.uint8)
    differ = m[:, None] != m[None]
    want = np.triu(differ.sum(2) <= simhash.MAX_DISTANCE, 1)
    got = np.zeros_like(want)
    for cs, extra in zip(*simhash.draws(12, simhash.table_count(12))):
        got |= ~differ[:, :, cs].any(2) & np.any([~differ[:, :, x].any(2) for x in extra], 0)
    assert (got & want).sum() / want.sum() > 0.985


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(35)]
    pairs = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    label = {n: n for p in pairs for n in p}
    for _ in range(len(pairs)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


# language ID


def language_rows(n=120):
    rng = random.Random(6)
    parts = {"aa": ["sha", "the", "ing", "on"], "bb": ["ció", "ñe", "los", "ar"], "cc": ["ung", "sch", "über", "ei"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang if i % 9 else None))
    return rows + [(500, None, "aa"), (501, "", "aa"), (502, "12 34!", "bb"), (None, "the sha", "aa"), (503, "Ω" * 400, None)]


def test_language_id(spark):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(df)
    assert model.langs == ["aa", "bb", "cc"]
    r = {x.doc_id: x for x in langid.predict(df, model).collect()}
    truth = {"sha": "aa"}
    assert truth and all(r[i].lang_pred == lang for i, _, lang in rows if lang and i is not None and i < 500)
    assert all(r[i].lang_pred == "und" and r[i].score == 0 and r[i].rejected for i in (500, 501, 502)) and r[503].rejected
    assert all(0 <= x.score <= 1 for x in r.values()) and not any(r[i].rejected for i in range(120))
    s = langid.scored(df, model).collect()
    import zlib

    assert {x.doc_id: x.held_out for x in s} == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i, _, _ in rows}
    none = langid.fit(df.where("lang = 'zz'"))
    assert none.langs == [] and {x.lang_pred for x in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_kneser_ney_sums_to_one():
    text = "abab abba cab "
    s, starts, _ = langid.symbols([text])
    g = langid.grams(s)[langid.ORDER - 1 :]
    u, n = np.unique(g, return_counts=True)
    m = langid.kneser_ney([(u, n)], ["x"])
    # over all that may follow a context: what was seen has its stored probability, the rest what is backed off to, over the vocabulary
    for ctx in {int(x) >> langid._BITS for x in u}:
        total = 0.0
        for c in range(langid.VOCABULARY):
            key, p, done = np.array([ctx << langid._BITS | c], np.uint64), 0.0, False
            for i, k in enumerate(range(langid.ORDER, 0, -1)):
                kk = langid.low(key, k)
                row = m.p[i].find(kk)[0]
                if row >= 0:
                    p += m.p[i].values[row, 0]
                    done = True
                    break
                b = m.b[i].find(kk >> np.uint64(langid._BITS))[0]
                p += m.b[i].values[b, 0] if b >= 0 else 0
            total += np.exp(p if done else p - np.log(langid.VOCABULARY))
        assert abs(total - 1) < 1e-3


# chat


def test_chat_folds_events(spark):
    ev = [
        (1, 1, 0, "open", "user", "Hi"), (1, 2, 1, "open", "assistant", None), (1, 2, 2, "delta", None, "Hel"), (1, 2, 3, "delta", None, "lo"), (1, 2, 4, "regenerate", None, None),
        (1, 2, 5, "delta", None, "Good "), (1, 2, 6, "delta", None, "day"), (1, 1, 7, "edit", None, "Hello there"), (1, 2, 2, "delta", None, "Hel"), (2, 9, 0, "delta", None, "orphan"), (None, 1, 0, "open", "system", "&lt;[x]</s>"),
    ]
    df = spark.createDataFrame(ev, "conv_id long, msg long, seq long, kind string, role string, text string").withColumn("rank", F.lit(0)).repartition(3)
    m = {(x.conv_id, x.msg): (x.role, x.text) for x in chat.fold_events(df).collect()}
    assert m == {(1, 1): ("user", "Hello there"), (1, 2): ("assistant", "Good day"), (2, 9): ("", "orphan"), (None, 1): ("system", "&lt;[x]</s>")}
    r = {x.conv_id: x for x in chat.render(chat.fold_events(df)).select("*", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert [(t.role, t.text) for t in r[1].t] == [("user", "Hello there"), ("assistant", "Good day")] and [(t.role, t.text) for t in r[None].t] == [("system", "&lt;[x]</s>")]
    assert [r[1].formatted[s.start : s.end] for s in r[1].loss_spans] == ["Good day"] and r[2].loss_spans == []
    assert chat.fold_events(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(5)
    al = ["<s>", "</s>", "[/ROLE]", "&amp;", "&", "lt;", "[", "]", "\\", "\n", "é", "x", " ", "🙂"]
    rows = [(c, t // 2, rng.choice(["user", "assistant", None, "a[b<"]), None if rng.random() < 0.1 else "".join(rng.choice(al) for _ in range(rng.randint(0, 9)))) for c in range(25) for t in range(rng.randint(1, 7))]
    df = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1))
    out = chat.render(chat.fold_events(chat.events_of_turns(df))).select("conv_id", chat.read_back(F.col("formatted")).alias("t"))
    want = defaultdict(list)
    for c, t, role, text in sorted([*rows, rows[0]], key=lambda r: (r[0], r[1], (r[2] or "").encode(), (r[3] or "").encode())):
        want[c].append((role or "", text or ""))
    assert {x.conv_id: [(t.role, t.text) for t in x.t] for x in out.collect()} == want


def test_chat_query_reads_the_mask(spark, tmp_path):
    import hashlib

    rng = random.Random(7)
    al = ["<s>", "</s>[INST]", "[/ROLE]", "&amp;", "<", "[", "\n", "é", "x", " ", "🙂"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), None if rng.random() < 0.1 else "".join(rng.choice(al) for _ in range(rng.randint(0, 12)))) for c in range(20) for t in range(rng.randint(1, 6))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"{t} " + "long [text] " * 200) for t in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    by = defaultdict(list)
    for c, t, role, text in [*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        by[c].append((t, role or "", text or ""))
    want = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    got = chat.op10_chat_format(spark, str(tmp_path)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    # the log has more than the final texts, and a broken mask shows
    turns = spark.createDataFrame(rows[:20], "conv_id long, turn int, role string, text string")
    log = chat.events_of_turns(turns)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"} and log.count() >= 80
    out = chat.render(chat.fold_events(log))
    off = out.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["end"].alias("end"))))
    a, b = ({r.conv_id: (r.turns_sha256, r.loss_sha256) for r in chat.digests(x).collect()} for x in (out, off))
    assert all(a[c][0] == b[c][0] for c in a) and any(a[c][1] != b[c][1] for c in a)
