"""The driver's relational tables read as a call graph, and the same projections in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_symbols(spark: SparkSession, d: str) -> DataFrame:
    """A part is a method of the class of its type, in the file of its brand."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("sym_ord"), F.concat("p_brand", F.lit("."), "p_type", F.lit("."), "p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("qname"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("class_name"), F.col("p_type").alias("owner_class"), F.col("p_size").alias("complexity"),
    )


CALL_ORD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def part_calls(spark: SparkSession, d: str) -> DataFrame:
    """Each line of an order calls the part of the next, by a stub whose form depends on the line's number."""
    li = table(spark, d, "lineitem").select(*CALL_ORD, "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = li.withColumn("nxt", F.lead("l_partkey").over(w)).where("nxt IS NOT NULL")
    s = part_symbols(spark, d)
    a = s.select(F.col("sym_ord").alias("l_partkey"), F.col("qname").alias("caller_qname"), F.col("file_path").alias("caller_file"), F.col("class_name").alias("caller_class"))
    b = s.select(F.col("sym_ord").alias("nxt"), F.col("qname").alias("b_qname"), F.col("name").alias("b_name"), F.col("class_name").alias("b_class"))
    kind = F.col("l_linenumber") % 4
    stub = F.when(kind == 0, F.col("b_qname")).when(kind == 1, F.concat(F.lit("self."), "b_name")).when(kind == 2, F.concat("b_class", F.lit("."), "b_name")).otherwise(F.col("b_name"))
    j = li.join(a, "l_partkey").join(b, "nxt")
    return j.select(*CALL_ORD, "l_quantity", F.struct(*CALL_ORD).alias("edge_ord"), "caller_qname", "caller_file", "caller_class", stub.alias("stub"))


SQL_SYM = "sym AS (SELECT p_partkey AS sym_ord, p_brand || '.' || p_type || '.' || p_name || '_' || p_partkey AS qname, p_name AS name, p_brand AS file, p_type AS cls, p_size AS complexity FROM part)"
SQL_RAW = f"""{SQL_SYM},
li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem),
raw AS (SELECT li.*, a.qname AS caller_q, a.file AS caller_file, a.cls AS caller_cls,
  CASE l_linenumber % 4 WHEN 0 THEN b.qname WHEN 1 THEN 'self.' || b.name WHEN 2 THEN b.cls || '.' || b.name ELSE b.name END AS stub
  FROM li JOIN sym a ON a.sym_ord = l_partkey JOIN sym b ON b.sym_ord = nxt)"""
SQL_RES = f"""{SQL_RAW},
cand AS (SELECT name AS key, sym_ord, qname, file, cls FROM sym UNION ALL SELECT cls || '.' || name, sym_ord, qname, file, cls FROM sym),
k AS (SELECT key, count(*) AS n, arg_min(qname, sym_ord) AS q FROM cand GROUP BY key),
kf AS (SELECT key, file, count(*) AS n, arg_min(qname, sym_ord) AS q FROM cand GROUP BY key, file),
kc AS (SELECT key, cls, count(*) AS n, arg_min(qname, sym_ord) AS q FROM cand GROUP BY key, cls),
keyed AS (SELECT *, CASE WHEN contains(stub, '.') AND string_split(stub, '.')[-2] IN ('self', 'this') THEN caller_cls || '.' || string_split(stub, '.')[-1] END AS k1,
  CASE WHEN contains(stub, '.') THEN string_split(stub, '.')[-2] || '.' || string_split(stub, '.')[-1] END AS k2, string_split(stub, '.')[-1] AS k3 FROM raw),
res AS (SELECT keyed.*, CASE WHEN e.qname IS NOT NULL THEN e.qname WHEN s.n >= 1 THEN coalesce(sf.q, s.q) WHEN t.n = 1 THEN t.q WHEN t.n > 1 AND tf.n = 1 THEN tf.q WHEN t.n > 1 AND tc.n = 1 THEN tc.q WHEN t.n > 1 THEN t.q
    WHEN o.n = 1 THEN o.q WHEN o.n > 1 AND ofi.n = 1 THEN ofi.q WHEN o.n > 1 AND oc.n = 1 THEN oc.q END AS callee,
  CASE WHEN e.qname IS NOT NULL THEN 'exact' WHEN s.n >= 1 THEN 'self' WHEN t.n = 1 THEN 'two_part' WHEN t.n > 1 AND tf.n = 1 THEN 'two_part_file' WHEN t.n > 1 AND tc.n = 1 THEN 'two_part_class' WHEN t.n > 1 THEN 'two_part_first'
    WHEN o.n = 1 THEN 'simple' WHEN o.n > 1 AND ofi.n = 1 THEN 'simple_file' WHEN o.n > 1 AND oc.n = 1 THEN 'simple_class' END AS rule
  FROM keyed LEFT JOIN sym e ON e.qname = stub LEFT JOIN k s ON s.key = k1 LEFT JOIN kf sf ON sf.key = k1 AND sf.file = caller_file
  LEFT JOIN k t ON t.key = k2 LEFT JOIN kf tf ON tf.key = k2 AND tf.file = caller_file LEFT JOIN kc tc ON tc.key = k2 AND tc.cls = caller_cls
  LEFT JOIN k o ON o.key = k3 LEFT JOIN kf ofi ON ofi.key = k3 AND ofi.file = caller_file LEFT JOIN kc oc ON oc.key = k3 AND oc.cls = caller_cls),
edge AS (SELECT res.*, c.file AS callee_file, c.name AS callee_name FROM res JOIN sym c ON c.qname = res.callee)"""


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    """Files are event types; each event calls the next of its user. caller, callee, edge_ord (event_id), caller_file, callee_file."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type").withColumn("nxt", F.lead("event_type").over(w)).where("nxt IS NOT NULL")
    return e.select(F.col("event_type").alias("caller"), F.col("nxt").alias("callee"), F.col("event_id").alias("edge_ord"), F.col("event_type").alias("caller_file"), F.col("nxt").alias("callee_file"))


SQL_EVENT = "ev AS (SELECT event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), pairs AS (SELECT DISTINCT src, dst FROM ev WHERE dst IS NOT NULL AND src <> dst)"


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Region calls nation, customer, order, part. caller, callee, edge_ord; ordinals grow by level and key."""
    t = lambda n: table(spark, d, n)
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = t("nation").select(k("r", "n_regionkey").alias("caller"), k("n", "n_nationkey").alias("callee"), F.col("n_nationkey").cast("long").alias("edge_ord"))
    c = t("customer").select(k("n", "c_nationkey").alias("caller"), k("c", "c_custkey").alias("callee"), (F.col("c_custkey") + 10**9).alias("edge_ord"))
    o = t("orders").select(k("c", "o_custkey").alias("caller"), k("o", "o_orderkey").alias("callee"), (F.col("o_orderkey") + 10**11).alias("edge_ord"))
    p = t("lineitem").select(k("o", "l_orderkey").alias("caller"), k("p", "l_partkey").alias("callee"), (F.col("l_orderkey") * 10**8 + F.col("l_partkey") + 10**13).alias("edge_ord"))
    return n.unionByName(c).unionByName(o).unionByName(p)


def order_file(node: Column) -> Column:
    """The file of a node: its kind, but those of a nation and a part also by their number's parity."""
    kind, odd = F.substring(node, 1, 1), F.substring(node, 2, 20).try_cast("long") % 2
    return F.when(kind == "n", F.concat(F.lit("nation"), odd.cast("string"))).when((kind == "p") & (odd == 1), F.lit("parts")).when(kind.isin("o", "p"), F.lit("sales")).otherwise(kind)


SQL_ORDER = """e4 AS (SELECT 'r' || n_regionkey AS caller, 'n' || n_nationkey AS callee, CAST(n_nationkey AS BIGINT) AS ord FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey + 1000000000 FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey + 100000000000 FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, l_orderkey * 100000000 + l_partkey + 10000000000000 FROM lineitem),
adj AS (SELECT caller, callee, min(ord) AS ord FROM e4 GROUP BY caller, callee),
st AS (SELECT caller AS node, min(ord) AS rank FROM e4 WHERE caller NOT IN (SELECT callee FROM e4) GROUP BY caller)"""


def sql_walk(start: str = "st", adj: str = "adj", depth: int = 20, revisit: bool = False) -> str:
    """Recursive CTE walk, then ch (path, ords): what chains.paths gives."""
    again = "" if revisit else f"AND NOT list_contains(walk.path, {adj}.callee)"
    return f"""walk AS (SELECT [node] AS path, [rank] AS ords, node AS last FROM {start}
  UNION ALL SELECT list_append(path, {adj}.callee), list_append(ords, {adj}.ord), {adj}.callee FROM walk JOIN {adj} ON {adj}.caller = walk.last WHERE len(path) < {depth} {again}),
ch AS (SELECT path, ords FROM walk WHERE len(path) = {depth} OR last NOT IN (SELECT caller FROM {adj}))"""


SQL_FILE = "CASE substr(x, 1, 1) WHEN 'n' THEN 'nation' || (CAST(substr(x, 2) AS BIGINT) % 2) WHEN 'o' THEN 'sales' WHEN 'p' THEN CASE WHEN CAST(substr(x, 2) AS BIGINT) % 2 = 1 THEN 'parts' ELSE 'sales' END ELSE substr(x, 1, 1) END"


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """page_id and the relative source path that a page's URL stands for."""
    u = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    ext = F.element_at(F.array(*map(F.lit, PAGE_EXT)), (F.col("page_id") % len(PAGE_EXT) + 1).cast("int"))
    top = F.element_at(F.array(*map(F.lit, PAGE_TOP)), (F.col("page_id") % len(PAGE_TOP) + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(top, F.lit("/"), F.regexp_replace(F.rtrim(u, F.lit("/")), r"\.html$", ""), F.lit("."), ext).alias("path"))


PAGE_EXT = ("py", "js", "TS", "go", "rs", "txt", "h", "cpp", "java")
PAGE_TOP = ("src", "src2", "lib/node_modules", "tests", "build")
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
SQL_PAGE = f"""pg AS (SELECT page_id, {_LIST(PAGE_TOP)}[page_id % {len(PAGE_TOP)} + 1] || '/' || regexp_replace(rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), '\\.html$', '')
  || '.' || {_LIST(PAGE_EXT)}[page_id % {len(PAGE_EXT)} + 1] AS path FROM pages)"""


def geo_classes(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as classes; bases are parents, half by simple name and half dotted, and some aren't known."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("class_ord"), F.concat(F.lit("geo."), "r_name").alias("qname"), F.col("r_name").alias("name"), F.array(F.lit("Root")).alias("bases"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select((F.col("n_nationkey") + 1000).cast("long").alias("class_ord"), F.concat(F.lit("geo."), "n_name").alias("qname"), F.col("n_name").alias("name"), F.array(F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.concat(F.lit("geo."), "r_name"))).alias("bases"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select((F.col("c_custkey") + 100_000).alias("class_ord"), F.concat(F.lit("crm."), "c_name").alias("qname"), F.col("c_name").alias("name"), F.array(F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("geo."), "n_name"))).alias("bases"))
    return r.unionByName(n).unionByName(c)


SQL_GEO = """cl AS (SELECT CAST(r_regionkey AS BIGINT) AS ord, 'geo.' || r_name AS qname, r_name AS name, 'Root' AS base FROM region
  UNION ALL SELECT n_nationkey + 1000, 'geo.' || n_name, n_name, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE 'geo.' || r_name END FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey + 100000, 'crm.' || c_name, c_name, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'geo.' || n_name END FROM customer JOIN nation ON c_nationkey = n_nationkey),
keys AS (SELECT name AS k, qname, ord FROM cl UNION SELECT split_part(qname, '.', 2), qname, ord FROM cl),
rb AS (SELECT cl.qname, cl.base, coalesce((SELECT arg_min(k.qname, k.ord) FROM keys k WHERE k.k = cl.base), cl.base) AS parent FROM cl)"""
