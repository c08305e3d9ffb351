"""Line dedup: content-defined chunks of lines, removed where they repeat.

DataFrame functions only. A rolling hash over the hashes of the last ``WINDOW`` lines ends a chunk unless it is 0 modulo ``JOINS``, so a line
put in or taken out moves only the boundaries beside it, and passages of a few lines have boundaries of their own. What is looked up is each run of two neighbouring chunks, and
each chunk of two lines or more: so each has two lines at least, and runs that overlap find a passage also where its first or last chunk holds foreign lines. A run that occurs before (smaller
doc_id, then text hash, then place in the document) anywhere in the corpus is removed; runs count as equal if their bytes are, and are judged on the input, not on what is left.
The first occurrence stays, and so does a single repeated line between lines that don't repeat.

Runs are counted by a 128-bit hash (partial sums before the shuffle); only runs whose hash occurs again are read once more, and are grouped by
their very text, so a hash collision removes nothing. Hashes that more than 1 in ``HOT_SHARE`` of all runs have are few by that (at most HOT_SHARE), are broadcast, and
their runs are spread over ``SALTS`` copies of the first occurrence, so a run that a third of all documents hold comes together in no task. Texts are
shuffled twice, by document: for the bytes of the runs and for the result. Shuffle files go when the table of their step is written, so at most
one of the two is on the disk at a time.

Defined results: a null text is one document without lines and stays null; an empty text stays empty. Rows of equal doc_id and text are one document and get the same result;
rows of equal doc_id and other texts are documents of their own. A text all of whose lines go becomes empty. Further columns are ignored by ``repeats`` and kept by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, release, table

WINDOW = 2
JOINS = 16
HOT_SHARE, SALTS = 10_000, 64
#: Rows of one hash that a task takes at least, whatever the share.
HOT_ROWS = 100_000


def line_hashes(lines: Column) -> Column:
    """24 bits of each line's MD5."""
    return F.transform(lines, lambda x: F.conv(F.substr(F.md5(x), F.lit(1), F.lit(6)), 16, 10).cast("long"))


def chunk_ends(h: Column) -> Column:
    """Places (from 1) of each chunk's last line."""
    n = F.size(h)

    def rolling(i: Column) -> Column:
        total = F.lit(0).cast("long")
        for k in range(WINDOW):
            total = total * 31 + F.coalesce(F.get(h, i - (WINDOW - k)), F.lit(0))
        return total

    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ((i >= WINDOW) & (rolling(i) % JOINS != 0)))


def _runs(docs: DataFrame) -> DataFrame:
    """lines and runs: array<struct<first, n>> (line places from 1) of what is looked up."""
    d = docs.withColumn("lines", F.split("text", "\n"))
    d = d.withColumn("h", line_hashes(F.col("lines")))
    d = d.withColumn("ends", chunk_ends(F.col("h")))
    before = lambda j: F.when(j <= 0, 0).otherwise(F.element_at("ends", F.greatest(j, F.lit(1))))
    run = lambda e, j: F.struct((before(j) + 1).alias("first"), (e - before(j)).alias("n"))
    chunks = F.filter(F.transform("ends", run), lambda c: c["n"] > 1)
    pairs = F.transform(F.slice("ends", F.lit(2), F.size("ends")), lambda e, j: run(e, j))  # from the chunk before
    return d.withColumn("runs", F.concat(chunks, pairs)).drop("h", "ends")


def _text(lines: Column, c: Column) -> Column:
    return F.array_join(F.slice(lines, c["first"], c["n"]), "\n")


def _key(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text").where("text IS NOT NULL").withColumn("text_sha", F.xxhash64("text"))


def repeats(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, text_sha, removed: array<struct<first, n>> of the runs that go (they may overlap); documents that lose none are left out."""
    d = _runs(_key(docs))
    hashed = F.transform("runs", lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n"), F.unhex(F.md5(_text(F.col("lines"), c))).alias("key")))
    hashes = materialize(d.select("doc_id", "text_sha", hashed.alias("runs")), "line-runs")  # a filter here would be pushed down with the whole expression in it
    # equal rows are one document
    rows = hashes.distinct().select("doc_id", "text_sha", F.explode("runs").alias("c")).select("doc_id", "text_sha", "c.*")
    again = materialize(rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "line-again")
    release(docs.sparkSession, rounds=2)
    most = max(hot_rows, (again.agg(F.sum("times")).first()[0] or 0) // HOT_SHARE)
    hot = again.where(F.col("times") > most).select("key")  # at most HOT_SHARE keys
    cold = again.where(F.col("times") <= most).select("key")
    rest = rows.join(F.broadcast(hot), "key", "left_anti").join(cold, "key", "left_semi").withColumn("hot", F.lit(False))
    seen = rest.unionByName(rows.join(F.broadcast(hot), "key", "left_semi").withColumn("hot", F.lit(True)))
    seen = seen.groupBy("doc_id", "text_sha").agg(F.collect_list(F.struct("first", "n", "hot")).alias("again"))
    # the candidates' texts, then their bytes
    texts = _key(docs)
    c = texts.join(seen, texts.doc_id.eqNullSafe(seen.doc_id) & (texts.text_sha == seen.text_sha)).select(texts.doc_id, texts.text_sha, F.split("text", "\n").alias("lines"), "again")
    # lines stands outside the lambda as well, else the optimizer moves the split into it
    one = lambda a: F.struct(a["first"].alias("first"), a["n"].alias("n"), a["hot"].alias("hot"), _text(F.col("lines"), a).alias("chunk"))
    c = c.select("doc_id", "text_sha", F.explode(F.transform(F.when(F.size("lines") > 0, F.col("again")), one)).alias("c")).select("doc_id", "text_sha", "c.*")
    c = materialize(c.distinct(), "line-candidates")
    discard(hashes, again)
    release(docs.sparkSession, rounds=2)
    first = c.groupBy("chunk").agg(F.min(F.struct("doc_id", "text_sha", "first")).alias("origin"), F.max("hot").alias("hot"))
    first = first.select("chunk", "origin", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    c = c.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "text_sha"), F.lit(SALTS)).cast("int")).otherwise(0))
    later = c.join(first, ["chunk", "salt"]).where(~F.struct("doc_id", "text_sha", "first").eqNullSafe(F.col("origin")))
    return later.groupBy("doc_id", "text_sha").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("removed"))


def gone(removed: Column) -> Column:
    """Places of the lines that removed runs cover, each once."""
    return F.array_distinct(F.flatten(F.transform(removed, lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1))))


def _kept(lines: Column, removed: Column) -> Column:
    """The text without the removed lines."""
    return F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), gone(removed)), lambda i: F.get(lines, i - 1)), "\n")


def dedup_lines(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with text replaced, and removed: array<struct<first, n>> of the runs that went (null: none), which takes the place of a column of that name."""
    docs = docs.drop("removed")
    r = repeats(docs, hot_rows).select(F.col("doc_id").alias("_gl_id"), F.col("text_sha").alias("_gl_sha"), "removed")
    j = docs.join(r, F.col("doc_id").eqNullSafe(F.col("_gl_id")) & (F.xxhash64("text") == F.col("_gl_sha")), "left").drop("_gl_id", "_gl_sha")
    j = j.withColumn("_gl_lines", F.when(F.col("removed").isNotNull(), F.split("text", "\n")))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(_kept(F.col("_gl_lines"), F.col("removed")))
    return j.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], "removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    before = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    r = dedup_lines(before)
    lost = F.coalesce(F.size(gone(F.col("removed"))), F.lit(0))
    return r.select(
        "doc_id", "n_chars", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_runs_removed"), lost.cast("long").alias("n_lines_removed"),
        F.char_length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"),
    )


_ROLL = "0"
for _k in range(WINDOW):
    _ROLL = f"({_ROLL}) * 31 + coalesce(h[i - {WINDOW - 1 - _k}], 0)"

ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, lines, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 6) AS BIGINT)) AS h FROM d),
e AS (SELECT doc_id, lines, [0] || list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR (i >= {WINDOW} AND ({_ROLL}) % {JOINS} <> 0)) AS ends FROM h),
j AS (SELECT doc_id, lines, ends, unnest(range(1, len(ends))) AS j FROM e),
k AS (
  SELECT doc_id, lines, ends[j] + 1 AS first, ends[j + 1] AS last FROM j WHERE ends[j + 1] > ends[j] + 1
  UNION ALL SELECT doc_id, lines, ends[j - 1] + 1, ends[j + 1] FROM j WHERE j > 1
),
t AS (SELECT doc_id, first, last, list_aggregate(lines[first:last], 'string_agg', chr(10)) AS run FROM k),
g AS (SELECT doc_id, first, last FROM t QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, first) > 1),
r AS (SELECT doc_id, count(*) AS n_runs_removed FROM g GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM g),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
o AS (SELECT l.doc_id, count(x.i) AS lost, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL), '') AS kept FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id)
SELECT doc_id, length(text) AS n_chars, coalesce(n_runs_removed, 0) AS n_runs_removed, coalesce(lost, 0) AS n_lines_removed,
  length(kept) AS n_chars_kept, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN o USING (doc_id) LEFT JOIN r USING (doc_id)
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": ORACLE}
