"""The pipeline and each stage against brute force, on documents with nulls, empty texts, copies, clashing columns and no rows."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphloom.llm import langid, secrets, simhash
from test_documents import brute_classes, brute_lines

PARTS = {"aa": ["sha", "the", "ing", "on"], "bb": ["ció", "ñe", "los", "ar"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(21)
    docs = []
    passage = [prose(rng, "aa", 15) for _ in range(4)]
    for i in range(160):
        lang = rng.choice("ab") * 2
        lines = [prose(rng, lang, 12) for _ in range(rng.randint(2, 6))]
        if i % 8 == 0 and lang == "aa":
            lines[1:1] = passage
        if i % 10 == 3:
            lines.append(f"password=owner{i:08d}")
        if i % 5 == 1:
            lines.append("token: commonexample0")
        docs.append((i, "\n".join(lines), lang, f"s{i % 7}", 0))
    docs += [(200 + i, docs[i][1], docs[i][2], "copy", 0) for i in range(10)]
    docs += [(300 + i, docs[20 + i][1].replace("the", "xyz", 1), docs[20 + i][2], "near", 0) for i in range(5)]
    docs += [(400, None, "aa", "s", 0), (401, "", "aa", "s", 0), (402, "12 ?!", None, "s", 0), (403, "ΩΨΞ ΦΠΛ " * 80, None, "s", 0), (404, "Ω" * 30, None, None, 0)]
    return docs


def near(spark, docs):
    """Ids that stay of near copies, by all pairs of signatures."""
    sig = {(x.doc_id, x.text_sha): list(x.sig) for x in simhash.signatures(docs).collect()}
    keys = sorted(sig)
    _, label = brute_classes([sig[k] for k in keys], simhash.MAX_DISTANCE)
    first = {}
    for k, x in zip(keys, label):
        first.setdefault(x, k)
    return {k[0] for k in first.values()}


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        was, now = ({r.doc_id: r.text for r in x.collect()} for x in (before, docs))
        kept[name] = now
        if name == "language_id":
            # documents of no letters and of an unknown language go, all others stay as they are
            assert was.keys() - now.keys() == {400, 401, 402, 403, 404} and all(now[i] == was[i] for i in now)
        elif name == "line_dedup":
            assert now == brute_lines(list(was.items())) and now != was
        elif name == "near_dedup":
            assert set(now) == near(spark, before) and all(now[i] == was[i] for i in now) and len(now) < len(was)
        else:
            hidden = {i for i in now if now[i] != was[i]}
            assert hidden == {i for i in was if re.search("password=owner", was[i])} and hidden
            assert all("[assign removed]" in now[i] and "owner" not in now[i] for i in hidden) and any("commonexample0" in t for t in now.values())
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or name in ("language_id",)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(kept["secret_scan"])
    assert all(sum(p.length for p in pieces if p.doc_id == i) == next(p.doc_tokens for p in pieces if p.doc_id == i) for i in list(kept["secret_scan"])[:20])


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_nulls_and_more_columns(spark, stage):
    docs = spark.createDataFrame(corpus()[-25:], SCHEMA).withColumns({c: F.lit("clash") for c in ("removed", "lines", "spans", "score", "rejected", "lang_pred", "sig", "class_id", "text_sha", "live", "loss_from")})
    assert stage(spark, docs.limit(0), "").count() == 0
    more = docs.unionByName(docs.limit(3)).unionByName(docs.where("doc_id = 300").withColumn("doc_id", F.lit(None).cast("long")))
    out = stage(spark, more, "")
    assert out.count() > 0 and (out.columns == docs.columns or "sequence_id" in out.columns)


def test_near_dedup_counts_no_links(spark, monkeypatch):
    """Near copies of one text leave one, and neither their pairs are written nor their links counted."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([w for w in base if rng.random() > 0.03] + [f"x{i}"]), "aa", "s", 0) for i in range(400)]
    written, kept = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda x, name: (r := kept(x, name), written.__setitem__(name, r.count()))[0])
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert [r.doc_id for r in out.collect()] == [0]
    assert max(written.values()) < 40 * len(rows) and not {"simhash-members", "simhash-degree"} & set(written), written


def test_entry_has_the_pipeline():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "secret_scan", "packing"]
    assert langid.MIN_SCORE and secrets.EXAMPLE_OWNERS
