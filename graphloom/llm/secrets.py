"""Secret scans with corpus-wide ownership frequency.

``spans`` finds candidates in each text; ``ownership`` counts, for each candidate value, the distinct repositories and owners that hold it;
``scan`` joins both: a value that few owners or few distinct texts hold looks live, one that many of both hold is a copied example. A document that is copied
to other owners as it is stays one text.

Kinds: assign, access and hex as the base rules have them, then those that this method adds: jwt (three base64url parts), pem (a private key
block), vendor (ghp_, xox., sk_live_ and similar prefixes). A span is a match, in code points, its end exclusive; spans of one kind don't
overlap, those of different kinds may. The value that is hashed is group 2 of an assignment, else the match.

Defined results: a null text counts as empty and has no spans; a null owner or repository counts as one owner or repository of its own; equal rows count once in the
frequencies and give equal result rows; further columns are ignored.

Frequencies are exact. (value, owner, repository) is made distinct with map-side combining before it is shuffled, so a value that a third of
all rows hold shrinks to its owners first. Counts go back to documents by a join on the value; values that more than 1 in ``HOT_SHARE`` of all spans have (at most HOT_SHARE values)
are broadcast, so their spans come together in no task. Texts are never shuffled by ``scan``.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches, table

KINDS = ("assign", "access", "hex", "jwt", "pem", "vendor")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]+-----END (?:[A-Z]+ )*PRIVATE KEY-----")
VENDOR = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})")
WORDS = ("passw", "secret", "token", "api")
#: A value that at most so many owners, or so many distinct texts, hold looks live.
MAX_OWNERS = 1
#: The same for the query and the pipeline, where a copy of a document may have lost lines and be another text: an example has more owners and texts than a few copies have.
EXAMPLE_OWNERS = 5
HOT_SHARE = 10_000
#: Spans of one value that a task takes at least, whatever the share.
HOT_ROWS = 100_000


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) of each span, sorted."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 3, m.end(), m[0]) for m in JWT.finditer(text)]
    if "PRIVATE KEY" in text:
        out += [(m.start(), 4, m.end(), m[0]) for m in PEM.finditer(text)]
    if any(w in text for w in ("gh", "xox", "k_live_", "AIza")):
        out += [(m.start(), 5, m.end(), m[0]) for m in VENDOR.finditer(text)]
    return sorted(out)


SPANS = "array<struct<kind:string,start:long,stop:long,value_sha256:string>>"


def _spans_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"kind": KINDS[k], "start": a, "stop": b, "value_sha256": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for a, k, b, v in find(t)])


def spans_of(text: Column) -> Column:
    """array<struct<kind, start, stop, value_sha256>> of a column of texts."""
    return F.pandas_udf(_spans_batch, SPANS)(text)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_sha256, text_sha, owner, repo) rows, repeated as they may be -> value_sha256, n_owners, n_repos, n_texts, n_spans."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    d = candidates.select("value_sha256", key("owner").alias("owner"), key("repo").alias("repo")).distinct()
    owners = d.select("value_sha256", "owner").distinct().groupBy("value_sha256").agg(F.count("*").alias("n_owners"))
    repos = d.select("value_sha256", "repo").distinct().groupBy("value_sha256").agg(F.count("*").alias("n_repos"))
    texts = candidates.select("value_sha256", "text_sha").distinct().groupBy("value_sha256").agg(F.count("*").alias("n_texts"))
    spans = candidates.groupBy("value_sha256").agg(F.count("*").alias("n_spans"))
    return owners.join(repos, "value_sha256").join(texts, "value_sha256").join(spans, "value_sha256")


def scan(docs: DataFrame, owner: Column, repo: Column, max_owners: int = MAX_OWNERS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, text_sha (of the text; with doc_id the key of a row), spans array<struct<kind,start,stop,value_sha256,n_owners,n_repos,live>>."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", F.xxhash64("text").alias("text_sha"), owner.alias("owner"), repo.alias("repo"), spans_of(F.col("text")).alias("spans"))
    found = materialize(found, "secret-spans")  # texts are scanned once; no text is in it
    each = found.select("doc_id", "text_sha", "owner", "repo", F.explode("spans").alias("s")).select("doc_id", "text_sha", "owner", "repo", "s.*")
    counts = materialize(ownership(each), "secret-counts")
    most = max(hot_rows, (counts.agg(F.sum("n_spans")).first()[0] or 0) // HOT_SHARE)
    hot, cold = counts.where(F.col("n_spans") > most), counts.where(F.col("n_spans") <= most)
    # the count of each value goes back to its documents; equal rows come together by their key
    one = each.select("doc_id", "text_sha", "kind", "start", "stop", "value_sha256").distinct()
    one = one.join(F.broadcast(hot.select("value_sha256")), "value_sha256", "left_anti").join(cold, "value_sha256").unionByName(one.join(F.broadcast(hot), "value_sha256"))
    per_doc = one.groupBy("doc_id", "text_sha").agg(
        F.sort_array(F.collect_list(F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("place"), "kind", "stop", "value_sha256", "n_owners", "n_repos", "n_texts"))).alias("judged")
    )
    base = found.select("doc_id", "text_sha", "spans")
    r = base.join(per_doc, base.doc_id.eqNullSafe(per_doc.doc_id) & (base.text_sha == per_doc.text_sha), "left").select(base.doc_id, base.text_sha, "judged")
    judged = F.transform("judged", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value_sha256"].alias("value_sha256"), s["n_owners"].alias("n_owners"), s["n_repos"].alias("n_repos"), (F.least(s["n_owners"], s["n_texts"]) <= max_owners).alias("live")))
    r = r.select("doc_id", "text_sha", judged.alias("spans"))
    return r.withColumn("spans", F.coalesce("spans", F.from_json(F.lit("[]"), r.schema["spans"].dataType)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: Column, live: Column) -> Column:
    """text without the spans of live, array<struct<start, stop, kind>>."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    part = lambda a, s: F.concat(F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit(" removed]"))

    def step(a: Column, s: Column) -> Column:
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(part(a, s)))).otherwise(a["parts"]).alias("parts"))

    longest_first = F.array_sort(live, lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(y["stop"] - x["stop"])).cast("int"))
    return F.aggregate(longest_first, zero, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, (a["at"] + 1).cast("int"))))


def redact(docs: DataFrame, owner: Column, repo: Column, max_owners: int = MAX_OWNERS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with the spans that look live replaced by [kind removed]; overlapping spans go together, under the name of the first."""
    r = scan(docs, owner, repo, max_owners, hot_rows)
    live = r.select("doc_id", "text_sha", F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))).alias("live"))
    live = live.where(F.size("live") > 0).distinct().select(F.col("doc_id").alias("_gl_id"), F.col("text_sha").alias("_gl_sha"), F.col("live").alias("_gl_live"))
    j = docs.join(live, F.col("doc_id").eqNullSafe(F.col("_gl_id")) & (F.xxhash64("text") == F.col("_gl_sha")), "left")
    text = F.when(F.col("_gl_live").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("_gl_live")))
    return j.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the source; repository: the documents of one language in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    r = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"), EXAMPLE_OWNERS)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return r.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        live.alias("n_live"), (F.size("spans") - live).cast("long").alias("n_copied"),
    )


def _sql_spans() -> str:
    """The spans of each kind: what a pattern matches, placed by the lengths of what stands between the matches."""
    fold = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    assign = "(" + "|".join(map(fold, ("password", "passwd", "secret", "token", "api_?key"))) + ASSIGN.pattern[ASSIGN.pattern.index(")") :]
    kinds = [(assign, 2, 12), (ACCESS.pattern, 0, 18), (HEX.pattern, 0, 16), (JWT.pattern, 0, 1), (PEM.pattern, 0, 1), (VENDOR.pattern, 0, 1)]
    one = []
    for k, (pattern, group, least) in enumerate(kinds):
        q = "'" + pattern.replace("'", "''") + "'"
        one.append(f"SELECT doc_id, text, source, {k} AS k, '{KINDS[k]}' AS kind, {least} AS least, regexp_extract_all(text, {q}, 0) AS ms, regexp_extract_all(text, {q}, {group}) AS vs, string_split_regex(text, {q}) AS ps FROM d")
    return " UNION ALL ".join(one)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
f AS ({_sql_spans()}),
u AS (SELECT doc_id, text, source, k, kind, least, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1 : len(ms)]) AS p, unnest(range(1, len(ms) + 1)) AS i FROM f),
w AS (SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS stop FROM u),
s AS (SELECT doc_id, text, source, k, kind, v, stop - length(m) AS start, stop FROM w WHERE length(v) >= least),
n AS (SELECT v, least(count(DISTINCT coalesce('=' || source, 'null')), count(DISTINCT text)) > {EXAMPLE_OWNERS} AS copied FROM s GROUP BY v),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans,
  count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied FROM s JOIN n USING (v) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES = {"op5_secret_scan": ORACLE}
