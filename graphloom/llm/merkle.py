"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

DataFrame functions only. Paragraphs are the lines of a text; a phrase ends behind a space that follows a character that is neither letter nor digit, and keeps both, so the
phrases of a paragraph joined are the paragraph, whatever characters it has; an empty paragraph is one empty phrase. A
section ends behind a paragraph whose hash begins with 0 to 3, so that an edit moves no boundary but those beside it. A node's hash is that
of its children's hashes. Equal roots mean equal texts; where roots differ, ``differing`` descends to the sections and paragraphs that do.

Likeness is the Dice coefficient of the sets of the tree's leaves, the phrase hashes: 1 for equal texts, 0 where no phrase is shared.

Defined results: a null text counts as empty, and an empty text is one empty paragraph. The next document is found by descending doc_id, a null one last; rows with
equal doc_id follow by text; equal rows are documents of their own. With one row, a document is its own next. Further columns are ignored.

The next document's text is brought by one shuffle: rows are put into ranges of doc_id of about ``ROWS`` rows, a range's first row is copied to the range above it,
and within a range the next row is the one behind. The bounds of ranges are at most ``MAX_RANGES``, so what the driver holds is bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table, text_or_empty

ROWS = 2000
MAX_RANGES = 10_000
#: Phrases, in a syntax that Java and RE2 read alike.
PHRASE = r"(?s).*?[^\p{L}\p{N}] |.+"


def phrases(paragraph: Column) -> Column:
    """array<string> of the phrases of a paragraph; joined, they are the paragraph."""
    return F.when(paragraph == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(paragraph, F.lit(PHRASE), F.lit(0)))


def phrase_hashes(text: Column) -> Column:
    """array<array<string>>: of each paragraph of a text, its phrases' hashes."""
    return F.transform(F.split(text, "\n"), lambda p: F.transform(phrases(p), lambda x: F.md5(x)))


def leaves(hashes: Column) -> Column:
    """Distinct leaves of a tree, from phrase_hashes."""
    return F.array_distinct(F.flatten(hashes))


def paragraph_hashes(hashes: Column) -> Column:
    return F.transform(hashes, lambda p: F.md5(F.array_join(p, "")))


def section_ends(hashes: Column) -> Column:
    """Places (from 1) of the last paragraph of each section."""
    n = F.size(hashes)
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.substr(F.element_at(hashes, i), F.lit(1), F.lit(1)) < "4"))


def section_hashes(paragraphs: Column, ends: Column) -> Column:
    return F.transform(
        ends,
        lambda e, j: F.md5(F.array_join(F.slice(paragraphs, F.when(j == 0, 1).otherwise(F.element_at(ends, F.greatest(j, F.lit(1))) + 1), e - F.when(j == 0, 0).otherwise(F.element_at(ends, F.greatest(j, F.lit(1))))), "")),
    )


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def differing(a: Column, b: Column) -> Column:
    """Places of the hashes of a that b lacks: what an edit from b to a touched, at any level of the tree."""
    return F.filter(F.transform(a, lambda x, i: F.when(~F.array_contains(b, x), i)), lambda i: i.isNotNull())


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) * F.lit(2.0) / (F.size(a) + F.size(b))


def with_fingerprint(df: DataFrame, text: str, name: str = "") -> DataFrame:
    """Adds {name}phrases, {name}paragraphs, {name}ends, {name}sections and {name}fingerprint."""
    df = df.withColumn(f"{name}phrases", phrase_hashes(F.col(text)))
    df = df.withColumn(f"{name}paragraphs", paragraph_hashes(F.col(f"{name}phrases")))
    df = df.withColumn(f"{name}ends", section_ends(F.col(f"{name}paragraphs")))
    df = df.withColumn(f"{name}sections", section_hashes(F.col(f"{name}paragraphs"), F.col(f"{name}ends")))
    return df.withColumn(f"{name}fingerprint", root(F.col(f"{name}sections")))


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by descending doc_id; behind the last stands the first."""
    d = docs.select("doc_id", text_or_empty().alias("text"))
    ids = docs.select("doc_id")
    n = ids.count()
    if not n:
        return d.withColumn("next_text", F.col("text"))
    ranges = max(1, min(MAX_RANGES, n // rows))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * MAX_RANGES)).first()[0] if ranges > 1 else []
    bounds = sorted(set(bounds or []))
    # the range of a row: how many bounds lie below its doc_id, found by halving
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_below(F.col("doc_id"), bounds))
    d = d.withColumn("part", part)
    tops = [r for r in d.groupBy("part").agg(F.max("doc_id").alias("top")).collect()]  # one row a range
    tops.sort(key=lambda r: r["part"])
    # a range's first row is its largest doc_id, then by text the smallest: it also stands behind the last row of the range above
    above = {r["part"]: tops[(i + 1) % len(tops)]["part"] for i, r in enumerate(tops)}
    known = dict((r["part"], r["top"]) for r in tops)
    first = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(known[p]).cast("long").alias("top"), F.lit(above[p]).alias("above")) for p in known])))
    heads = d.join(F.broadcast(first), "part").where(F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("part", "above", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("above").alias("part"), F.lit(1).alias("ghost"))
    both = d.withColumn("ghost", F.lit(0)).unionByName(heads)
    w = Window.partitionBy("part").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    return both.withColumn("next_text", F.lead("text").over(w)).where("ghost = 0").select("doc_id", "text", "next_text")


def _below(c: Column, bounds: list[int]) -> Column:
    """How many bounds lie below c: first the block of bounds, then its own, so a row is held against about 2 sqrt(n) of them and the plan has them as two arrays."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lits = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at = F.size(F.filter(lits([x[-1] for x in blocks]), lambda v: v < c))  # whole blocks below c
    own = F.size(F.filter(F.coalesce(F.get(F.array(*map(lits, blocks)), at), F.array().cast("array<bigint>")), lambda v: v < c))
    return (at * step + own).cast("int") if len(bounds) % step == 0 else F.least(at * step + own, F.lit(len(bounds))).cast("int")


def op3_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    d = d.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half)))
    d = with_fingerprint(with_fingerprint(d, "text"), "edited", "edited_")
    d = d.withColumn("l", leaves(F.col("phrases")))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("l"), leaves(F.col("edited_phrases"))).alias("near_edited"), likeness(F.col("l"), leaves(phrase_hashes(F.col("next_text")))).alias("near_next"),
        F.size("sections").cast("long").alias("n_sections"), F.size(differing(F.col("edited_sections"), F.col("sections"))).cast("long").alias("n_sections_edited"),
    )


def _sql_tree(text: str, name: str) -> str:
    """CTEs {name}p to {name}l: phrase and paragraph hashes, section hashes and leaves of a column of table d."""
    pattern = PHRASE.replace("'", "''")
    return f"""
{name}h AS (SELECT doc_id, list_transform(string_split({text}, chr(10)), lambda p: list_transform(CASE WHEN p = '' THEN [''] ELSE regexp_extract_all(p, '{pattern}') END, lambda x: md5(x))) AS hs FROM d),
{name}p AS (SELECT doc_id, hs, list_transform(hs, lambda h: md5(list_aggregate(h, 'string_agg', ''))) AS ps FROM {name}h),
{name}e AS (SELECT doc_id, ps, list_filter(range(1, len(ps) + 1), lambda i: i = len(ps) OR ps[i][1] < '4') AS es FROM {name}p),
{name}s AS (SELECT doc_id, list_transform(range(1, len(es) + 1), lambda j: md5(list_aggregate(ps[(CASE WHEN j = 1 THEN 0 ELSE es[j - 1] END) + 1 : es[j]], 'string_agg', ''))) AS ss FROM {name}e),
{name}l AS (SELECT doc_id, list_distinct(flatten(hs)) AS ls FROM {name}h)"""


ORACLE = f"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS next_text, length(coalesce(text, '')) AS n_chars
  FROM documents WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text)
), d AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM n),
{_sql_tree("text", "a")},
{_sql_tree("edited", "b")},
{_sql_tree("next_text", "c")}
SELECT d.doc_id, d.n_chars, sha256(d.edited) AS edited_sha256,
  sha256(list_aggregate(asx.ss, 'string_agg', '')) AS fingerprint, sha256(list_aggregate(bsx.ss, 'string_agg', '')) AS edited_fingerprint,
  len(list_intersect(al.ls, bl.ls)) * 2.0::DOUBLE / (len(al.ls) + len(bl.ls)) AS near_edited,
  len(list_intersect(al.ls, cl.ls)) * 2.0::DOUBLE / (len(al.ls) + len(cl.ls)) AS near_next,
  len(asx.ss) AS n_sections, len(list_filter(bsx.ss, lambda x: NOT list_contains(asx.ss, x))) AS n_sections_edited
FROM d JOIN "as" AS asx USING (doc_id) JOIN bs AS bsx USING (doc_id) JOIN al USING (doc_id) JOIN bl USING (doc_id) JOIN cl USING (doc_id)
""".replace("\nas AS", '\n"as" AS')

QUERIES = {"op3_merkle_fingerprint": op3_merkle_fingerprint}
ORACLES = {"op3_merkle_fingerprint": ORACLE}
