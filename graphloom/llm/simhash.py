"""SimHash near-dedup with random bit sampling.

DataFrame functions only. A text's features are its distinct words (lower case; if it has none, the text itself); its signature has 256 bits, each the majority over the
features' hash bits. Two texts are linked if their signatures differ in at most ``MAX_DISTANCE`` bits.

Candidates come from tables: each groups signatures by ``bits`` sampled coordinates (more bits for more signatures, so that the buckets of
unlike texts stay small), and there are as many as keep the recall (``table_count``), worked through in passes of at most ``PASS``, so the disk holds one pass. A bucket of more than ``CAP`` signatures is split by additional sampled bits in ``DRAWS`` draws; what is still larger then is
dense, and is compared exactly, block against block, so no task holds it whole. Each candidate pair is verified on all 256 bits. Equal signatures are one
representative, so copies are never expanded into pairs. Classes are the connected components of the links.

Many near copies of one text share nearly every bucket, and their pairs grow as the square of their number; so classes don't come from all pairs. First each signature is
linked with one leader of its bucket, in half the tables of a pass. Of classes that have more than ``HEAVY`` signatures by then, no two signatures of the same class are candidates:
they meet the others of their bucket only, in all tables and unsplit. Other signatures meet as above. What is found is put into the classes whenever it is more than the
signatures. The links of a signature are counted within its class, which has them all, once for each pair rather than once a table: that alone is quadratic in the size of
a class, and ``keep_one`` goes without it.

Recall: a pair that differs in d of 256 bits shares a bucket of one table with probability C(256 - d, bits) / C(256, bits), and if that is split, one of its cells with
1 - (1 - C(256 - bits - d, 6) / C(256 - bits, 6))^8; each table draws its own additional bits. With p the product, it is a candidate with probability 1 - (1 - p)^tables or more. Tables are so many that this is at least ``RECALL`` for d = ``MAX_DISTANCE`` whatever the bits. Tests measure it against all pairs.

Votes are summed in 16-bit lanes, 4 to a long, over parts of at most 60,000 features, then over the parts, so texts of any length are exact.

Defined results: a null text has no signature, is linked to nothing and is a class of its own (by doc_id); empty texts are equal texts. Rows of equal doc_id and text are
one document; other texts under one doc_id are documents of their own with that id. A null doc_id is kept and never is the id of a class with another one. Where ids clash, or are
null, class_id doesn't tell classes apart: class_key does, a number of the class alone (null for a null text). Further
columns are ignored.

Representatives are named by 64 bits of a hash of their signature; at 10^8 of them two share a name with a probability of 3 in 10,000, and would be one class.
"""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialize, release, table

BITS, LANES = 256, 4
MAX_DISTANCE = 46
RECALL = 0.98
PASS = 20
CAP, EXTRA, DRAWS = 1000, 6, 8
HEAVY = 32
PART = 60_000
SEEDS = (11, 23, 37, 53)
LANE = 0x0001000100010001


def features(text: Column) -> Column:
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    return F.when(F.size(words) > 0, words).otherwise(F.array(text))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha, sig: array of 4 longs, for each distinct (doc_id, text) whose text isn't null.

    Sums of packed votes are taken by documents' rows before the shuffle; what is shuffled is 64 longs a document, not its words.
    """
    d = docs.where("text IS NOT NULL").select("doc_id", "text").withColumn("text_sha", F.xxhash64("text"))
    d = d.select("doc_id", "text_sha", F.posexplode(features(F.col("text"))).alias("i", "w"))
    d = d.select("doc_id", "text_sha", F.floor(F.col("i") / PART).alias("part"), *[F.xxhash64("w", F.lit(s)).alias(f"h{k}") for k, s in enumerate(SEEDS)])
    sums = [F.sum(F.shiftrightunsigned(f"h{k}", b).bitwiseAND(F.lit(LANE))).alias(f"v{k}_{b}") for k in range(len(SEEDS)) for b in range(16)]
    g = d.groupBy("doc_id", "text_sha", "part").agg(F.count("*").alias("n"), *sums)
    packed = F.array(*[f"v{k}_{b}" for k in range(len(SEEDS)) for b in range(16)])
    # equal rows double every vote and the count alike, so the majority is the same
    g = g.groupBy("doc_id", "text_sha").agg(F.sum("n").alias("n"), F.collect_list(packed).alias("parts"))

    def word(k: int) -> Column:
        """64 bits: bit b + 16 * lane is set if more than half of the features have it."""

        def bit(p: Column) -> Column:  # p: 0..63
            at, lane = p % 16 + k * 16, F.floor(p / 16).cast("int")
            votes = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftrightunsigned", F.get(x, at), lane * 16).bitwiseAND(F.lit(0xFFFF)))
            return F.when(votes * 2 > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("long"), p)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(bit(p)))

    return g.select("doc_id", "text_sha", F.array(*[word(k) for k in range(len(SEEDS))]).alias("sig"))


def table_bits(n: int) -> int:
    """Sampled bits a table: unlike texts agree on a bit with a probability of 0.55 to 0.6, so buckets stay near constant as n grows. With one bit fewer, a pair at
    MAX_DISTANCE needs a fifth fewer tables and a row meets nearly twice as many candidates; at about 90 candidates a row both cost the same, which is 14 bits at 200,000."""
    return max(10, min(40, round(14 + 1.25 * math.log2(max(1, n) / 200_000))))


def found(d: int, bits: int) -> float:
    """Probability that a table of sampled bits makes candidates of two signatures that differ in d bits, also if it splits their bucket."""
    rest = BITS - bits
    split = 1 - (1 - math.comb(rest - d, EXTRA) / math.comb(rest, EXTRA)) ** DRAWS
    return math.comb(BITS - d, bits) / math.comb(BITS, bits) * split


def table_count(bits: int, max_distance: int = MAX_DISTANCE) -> int:
    """Tables that find a pair at max_distance with a probability of RECALL or more; nearer pairs are found more often."""
    p = found(max_distance, bits)
    return 1 if p >= RECALL else math.ceil(math.log(1 - RECALL) / math.log1p(-p))


def draws(bits: int, tables: int) -> tuple[list[list[int]], list[list[list[int]]]]:
    """Sampled coordinates of each table, and of each table the draws that split its large buckets, from the other coordinates."""
    rng = random.Random(2024)
    coordinates = [rng.sample(range(BITS), bits) for _ in range(tables)]
    return coordinates, [[rng.sample(sorted({*range(BITS)} - {*cs}), EXTRA) for _ in range(DRAWS)] for cs in coordinates]


def _masks(coordinates: list[int]) -> list[int]:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(1 << c % 64 for c in coordinates if c // 64 == k)) for k in range(4)]


def mask_rows(coordinates: list[list[int]], name: str) -> list[Column]:
    """Of each set of sampled coordinates: its number, and the mask of each of a signature's longs."""
    return [F.struct(F.lit(t).alias(name), *[F.lit(m).cast("long").alias(f"m{k}") for k, m in enumerate(_masks(cs))]) for t, cs in enumerate(coordinates)]


def masks(coordinates: list[list[int]], name: str) -> Column:
    return F.explode(F.array(*mask_rows(coordinates, name))).alias("m")


WORDS = ["s0", "s1", "s2", "s3"]


def words_of(sig: Column) -> list[Column]:
    return [F.get(sig, F.lit(k)).alias(w) for k, w in enumerate(WORDS)]


def name_of(words: list[Column]) -> Column:
    """64 bits that name a representative; all 256 are compared."""
    return F.xxhash64(*words)


def sampled(*salt: Column) -> Column:
    """One long for the sampled bits of s0..s3 under the masks m, and the salt; equal bits give equal values, and candidates are verified anyway."""
    return F.xxhash64(*[F.col(w).bitwiseAND(F.col(f"m.m{k}")) for k, w in enumerate(WORDS)], *salt)


def _pairs(cells: DataFrame, max_distance: int, coordinates: list[list[int]]) -> DataFrame:
    """Verified pairs within cells: rows (cell, t, split, flags, s0..s3).

    A pair is given by the first table in which it shares a bucket that wasn't split, and only if there is none by each cell that it shares. So a link isn't
    shuffled once a table; flags has a bit for each table in which a row's bucket was split. Both sides of the join keep the same columns, so one exchange serves both.
    """
    side = lambda x: cells.select("cell", *[F.col(c).alias(f"{x}_{c}") for c in ("t", "split", "flags", *WORDS)])
    x = [F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}")) for w in WORDS]
    d = sum((F.bit_count(v) for v in x[1:]), F.bit_count(x[0]))
    same = (F.col("a_t") == F.col("b_t")) & (F.col("a_split") == F.col("b_split"))
    a, b = name_of([F.col(f"a_{w}") for w in WORDS]), name_of([F.col(f"b_{w}") for w in WORDS])
    flags = F.col("a_flags").bitwiseOR(F.col("b_flags"))
    near = side("a").hint("merge").join(side("b"), "cell").where((d <= max_distance) & same & (a < b))
    near = near.select(F.col("a_t").alias("t"), F.col("a_split").alias("split"), flags.alias("flags"), a.alias("a"), b.alias("b"), *[v.alias(f"x{k}") for k, v in enumerate(x)])

    # a lambda, not an expression for each table: the code of the join stays small enough to be compiled, and it ends at the first table found
    def given(m: Column) -> Column:
        differ = [F.col(f"x{k}").bitwiseAND(m[f"m{k}"]) for k in range(4)]
        unsplit = F.col("flags").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), m["t"])) == 0
        return (F.col("split") | (m["t"] < F.col("t"))) & (differ[0].bitwiseOR(differ[1]).bitwiseOR(differ[2]).bitwiseOR(differ[3]) == 0) & unsplit

    return near.where(~F.exists(F.array(*mask_rows(coordinates, "t")), given)).select("a", "b")


def distance(x: str, y: str) -> Column:
    """Bits in which the signatures of the words with these prefixes differ."""
    v = [F.bit_count(F.col(f"{x}_{w}").bitwiseXOR(F.col(f"{y}_{w}"))) for w in WORDS]
    return sum(v[1:], v[0])


def _as(of: DataFrame, x: str, *more: str) -> DataFrame:
    return of.select(*more, *[F.col(w).alias(f"{x}_{w}") for w in WORDS])


def _name(x: str) -> Column:
    return name_of([F.col(f"{x}_{w}") for w in WORDS])


def _cells(of: DataFrame, coordinates: list[list[int]], *more: str) -> DataFrame:
    r = of.select(*more, *WORDS, masks(coordinates, "t"))
    return r.select(sampled(F.col("m.t")).alias("cell"), *more, *WORDS)


def _stars(nodes: DataFrame, coordinates: list[list[int]], max_distance: int) -> DataFrame:
    """Links of each signature with the leader of its bucket of each table, where within max_distance; leaders are drawn by hash, another one in each table."""
    first = Window.partitionBy("cell").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = _cells(nodes, coordinates).withColumn("order", F.xxhash64("cell", *WORDS))
    r = r.select(*[F.first(w).over(first).alias(f"a_{w}") for w in WORDS], *[F.col(w).alias(f"b_{w}") for w in WORDS])
    d = distance("a", "b")
    return r.where((d <= max_distance) & (d > 0)).select(_name("a").alias("a"), _name("b").alias("b")).distinct()


def _across(heavy: DataFrame, rest: DataFrame, coordinates: list[list[int]], max_distance: int) -> DataFrame:
    """Pairs of a class and a signature of another class, or of rest, that is within max_distance of one of its signatures in the same bucket. heavy: label, s0..s3.

    In each bucket the signatures of rest, and those of the smaller of two classes, go to each (larger) class; no class meets itself.
    """
    held = _cells(heavy, coordinates, "label")
    groups = materialize(held.groupBy("cell", "label").agg(F.count("*").alias("size")), "simhash-groups")
    into = groups.select("cell", F.col("label").alias("into"), F.col("size").alias("into_size"))
    larger = groups.join(into, "cell").where(F.struct("size", "label") < F.struct(F.col("into_size"), F.col("into"))).select("cell", "label", "into")
    come = _cells(rest, coordinates).join(into.drop("into_size").hint("shuffle_hash"), "cell")  # not sorted
    come = _as(come, "b", "cell", "into").unionByName(_as(held.join(larger, ["cell", "label"]), "b", "cell", "into"))
    near = _as(held.withColumnRenamed("label", "into"), "a", "cell", "into").hint("merge").join(come, ["cell", "into"]).where(distance("a", "b") <= max_distance)
    return near.select(F.col("into").alias("a"), _name("b").alias("b")).distinct()


def classes(reps: DataFrame, n: int, max_distance: int = MAX_DISTANCE, tables: int | None = None, cap: int = CAP, bits: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """node, label: of each representative that is linked with another one the smallest of its class, both by name_of their signatures. reps: sig."""
    m = bits or table_bits(n)
    tables = tables or table_count(m, max_distance)
    coordinates, extra = draws(m, tables)
    size = math.ceil(tables / math.ceil(tables / PASS))
    nodes = reps.select(*words_of(F.col("sig")))
    found, gained = [_stars(nodes, coordinates[: math.ceil(size / 2)], max_distance)], n + 1
    for i in range(0, tables, size):
        if gained > n:
            labels = _folded(found)
            members, rest = _parted(nodes, labels, heavy)
            found, gained = [labels.select(F.col("node").alias("a"), F.col("label").alias("b"))], 0
        part = coordinates[i : i + size]
        found.append(materialize(_pass(rest, part, extra[i : i + size], max_distance, cap), "simhash-pass"))
        release(reps.sparkSession)  # the shuffle files of one pass go before the next
        gained += found[-1].count()
        if not members.isEmpty():
            found.append(materialize(_across(members, rest, part, max_distance), "simhash-across"))
            release(reps.sparkSession)
    return _folded(found)


def _folded(found: list[DataFrame]) -> DataFrame:
    labels = components(materialize(functools.reduce(DataFrame.unionByName, found), "simhash-found"))
    release(labels.sparkSession)
    return labels


def _parted(nodes: DataFrame, labels: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of classes of more than heavy, with their label, and the others."""
    wide = labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") > heavy).select("label")
    named = nodes.withColumn("node", name_of([F.col(w) for w in WORDS]))
    members = materialize(named.join(labels.join(wide, "label"), "node").select("label", *WORDS), "simhash-heavy")
    return members, nodes if members.isEmpty() else materialize(nodes.join(members, WORDS, "left_anti"), "simhash-rest")


def _within(reps: DataFrame, labels: DataFrame, max_distance: int, cap: int) -> DataFrame:
    """Ordered pairs a, b of unequal representatives of one class within max_distance: all pairs of a class are compared, by blocks of about cap. reps: sig."""
    size = labels.groupBy("label").agg(F.ceil(F.count("*") / cap).cast("long").alias("blocks"))
    r = reps.select(*words_of(F.col("sig"))).withColumn("node", name_of([F.col(w) for w in WORDS]))
    r = materialize(r.join(labels.join(size, "label"), "node").select("label", "blocks", F.pmod("node", "blocks").alias("block"), *WORDS), "simhash-members")
    a = _as(r.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))), "a", "label", "block")
    d = distance("a", "b")
    near = a.hint("merge").join(_as(r, "b", "label", "block"), ["label", "block"]).where((d <= max_distance) & (d > 0))
    return near.select(_name("a").alias("a"), _name("b").alias("b"))


def links(reps: DataFrame, n: int, max_distance: int = MAX_DISTANCE, tables: int | None = None, cap: int = CAP, bits: int | None = None) -> DataFrame:
    """Pairs a < b of representatives (by name_of their signatures) within max_distance, of the same class. reps: sig."""
    return _within(reps, classes(reps, n, max_distance, tables, cap, bits), max_distance, cap).where("a < b")


def _pass(nodes: DataFrame, coordinates: list[list[int]], extra: list[list[list[int]]], max_distance: int, cap: int) -> DataFrame:
    """Distinct pairs of the tables of one pass. extra: of each table the draws that split its large buckets. nodes: s0..s3."""
    keyed = nodes.withColumn("flags", F.lit(0).cast("long"))
    out = ["cell", "t", "split", "flags", *WORDS]

    def rows(of: DataFrame) -> DataFrame:
        r = of.select("flags", *WORDS, masks(coordinates, "t"))
        return r.select(sampled(F.col("m.t")).alias("cell"), F.col("m.t").alias("t"), F.lit(False).alias("split"), "flags", *WORDS)

    big = materialize(rows(keyed).groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > cap).select("cell"), "simhash-big")
    release(nodes.sparkSession)
    if big.isEmpty():
        return _pairs(rows(keyed), max_distance, coordinates)  # each pair once
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t"))
    large = materialize(rows(keyed).join(big, "cell"), "simhash-large")
    flags = large.groupBy(*WORDS).agg(F.bit_or(own).alias("own"))
    flagged = materialize(keyed.drop("flags").join(flags, WORDS, "left").select(F.coalesce("own", F.lit(0).cast("long")).alias("flags"), *WORDS), "simhash-flags")
    small = rows(flagged).where(F.col("flags").bitwiseAND(own) == 0)
    drawn = large.drop("flags").join(flags.withColumnRenamed("own", "flags"), WORDS)
    each = F.array(*[F.array(*mask_rows(x, "draw")) for x in extra])
    drawn = drawn.select("cell", "t", "flags", *WORDS, F.explode(F.get(each, F.col("t"))).alias("m"))
    drawn = drawn.select(sampled(F.col("cell"), F.col("m.draw")).alias("cell"), "t", F.lit(True).alias("split"), "flags", *WORDS)
    dense = materialize(drawn.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > cap), "simhash-dense")
    # a dense cell's rows fall into blocks; the cell of blocks i <= j has both, so each pair meets once or more
    held = drawn.join(dense, "cell").withColumn("blocks", F.ceil(F.col("size") / cap).cast("long"))
    held = held.withColumn("block", F.pmod(name_of([F.col(w) for w in WORDS]), F.col("blocks")))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = held.withColumn("cell", F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")))
    cells = small.select(out).unionByName(drawn.join(dense, "cell", "left_anti").select(out)).unionByName(held.select(out))
    return _pairs(cells, max_distance, coordinates).distinct()


def components(pairs: DataFrame, jumps: int = 3) -> DataFrame:
    """node, label: the smallest node of its connected component, for every node in pairs (a, b).

    Each round maps a node to the smallest of itself and its neighbours, that one to its own, a few times over, then puts labels in the place of nodes; edges within a label go, so dense
    groups are gone after a round. Each round ends in tables in the shared folder.
    """
    edges = pairs.select("a", "b")
    labels = None
    while True:
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("up")), "components-up")
        if up.isEmpty():
            return labels if labels is not None else up.select("node", F.col("up").alias("label"))
        for _ in range(jumps):
            step = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = up.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
        up = materialize(up, "components-up")
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            labels = materialize(labels.join(up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "components-labels")
        edges = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("la")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("lb")), "b")
        edges = materialize(edges.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "components-edges")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, tables: int | None = None, cap: int = CAP, bits: int | None = None, heavy: int = HEAVY, counted: bool = True) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, text_sha (null for a null text), class_id (the smallest doc_id of the class), n_links (other signatures
    within max_distance; only if counted), n_copies (documents with the same signature, itself included), class_key (of the class alone)."""
    spark = docs.sparkSession
    sigs = materialize(signatures(docs), "simhash-signatures")
    release(spark)
    reps = materialize(sigs.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).withColumn("rep", name_of(words_of(F.col("sig")))), "simhash-reps")
    labels = classes(reps.select("sig"), reps.count(), max_distance, tables, cap, bits, heavy)
    r = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    columns = ["class_id", "n_links", "n_copies", "class_key"]
    if counted:
        degree = materialize(_within(reps, labels, max_distance, cap).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links")), "simhash-degree")
        r = r.join(degree, "rep", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    else:
        columns.remove("n_links")
    least = r.groupBy("label").agg(F.min("first").alias("class_id"))
    r = r.join(least, "label").withColumnsRenamed({"copies": "n_copies", "label": "class_key"}).select("sig", *columns)
    out = sigs.join(r, "sig").select("doc_id", "text_sha", *columns)
    void = {"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), "n_copies": F.lit(1).cast("long"), "class_key": F.lit(None).cast("long")}
    return out.unionByName(docs.where("text IS NULL").select("doc_id").distinct().select("doc_id", F.lit(None).cast("long").alias("text_sha"), *[void[c].alias(c) for c in columns]))


def keep_one(docs: DataFrame, **limits: int) -> DataFrame:
    """The rows of docs whose document is the one of its class that stays: that with the smallest doc_id, then text hash. Null texts stay."""
    r = near_duplicates(docs, counted=False, **limits)
    chosen = r.where("text_sha IS NOT NULL").groupBy("class_key").agg(F.min(F.struct("doc_id", "text_sha")).alias("k")).select(F.col("k.doc_id").alias("_gl_id"), F.col("k.text_sha").alias("_gl_sha"))
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_gl_id")) & (F.xxhash64("text") == F.col("_gl_sha")) & F.col("text").isNotNull(), "left_semi")
    return kept.unionByName(docs.where("text IS NULL"))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_copies", "class_key")


QUERIES = {"op6_simhash_neardup": op6_simhash_neardup}
ORACLES: dict[str, str] = {}
