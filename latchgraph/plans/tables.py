"""Queries that run the operators over the plain test tables, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, joins, sets, windows
from . import surrogate
from .surrogate import EDGES_SQL, NODES_SQL, PATHS_SQL, SCC_SQL, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


# graph operators


@query(f"WITH RECURSIVE {PATHS_SQL} SELECT node, root, len(chain) AS depth, array_to_string(list_append(chain, root), '>') AS path FROM paths")
def gr05_simple_paths(spark, d):
    p = surrogate.paths(spark, d)
    shown = F.concat_ws(">", F.transform("chain", lambda x: x["function_name"]), F.col("root").cast("string"))
    return p.select("node", "root", F.size("chain").cast("long").alias("depth"), shown.alias("path"))


@query(
    f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL},
hit AS (SELECT id FROM nodes WHERE status = 'KnownBlocking' UNION
  SELECT e.src FROM hit h JOIN edges e ON e.dst = h.id JOIN nodes n ON n.id = e.src WHERE NOT e.protected AND n.status <> 'KnownNonBlocking')
SELECT n.id, CASE WHEN n.status = 'Unknown' AND h.id IS NOT NULL THEN 'PropagatedBlocking' ELSE n.status END AS status FROM nodes n LEFT JOIN hit h ON h.id = n.id"""
)
def gr04_reachable(spark, d):
    return graph.reachable(surrogate.nodes(spark, d).select("id", "status"), surrogate.edges(spark, d)).select("id", "status")


@query(f"WITH RECURSIVE {SCC_SQL} SELECT id, scc, count(*) OVER (PARTITION BY scc) AS members FROM scc")
def gr01_scc(spark, d):
    scc = graph.strongly_connected(surrogate.nodes(spark, d), surrogate.edges(spark, d))
    sizes = scc.groupBy("scc").agg(F.count("*").alias("members"))
    return scc.join(sizes, "scc").select("id", "scc", "members")


@query(
    f"""WITH RECURSIVE {SCC_SQL} SELECT a.scc AS from_scc, b.scc AS to_scc, bool_and(e.protected) AS all_protected, count(*) AS n_edges
FROM edges e JOIN scc a ON a.id = e.src JOIN scc b ON b.id = e.dst WHERE a.scc <> b.scc GROUP BY 1, 2"""
)
def gr02_condense_bool_and(spark, d):
    edges = surrogate.edges(spark, d)
    return graph.condense(edges, graph.strongly_connected(surrogate.nodes(spark, d), edges))


@query(
    f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, up AS (SELECT src, dst FROM edges WHERE dst > src),
lv AS (SELECT id, 0 AS level FROM nodes UNION SELECT u.dst, l.level + 1 FROM lv l JOIN up u ON u.src = l.id)
SELECT id, max(level)::INT AS level FROM lv GROUP BY id"""
)
def gr03_topological_levels(spark, d):
    return graph.levels(surrogate.nodes(spark, d), surrogate.edges(spark, d).filter("dst > src"))


@query(
    f"""WITH RECURSIVE {PATHS_SQL}
SELECT p.node, p.root, len(p.chain) AS depth, array_to_string(list_append(p.chain, p.root), '>') AS path FROM paths p JOIN nodes n ON n.id = p.node
WHERE n.is_async AND n.is_first_party AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes c ON c.id = e.src WHERE e.dst = p.node AND NOT e.protected AND c.is_async AND c.is_first_party)"""
)
def gr10_entry_antijoin(spark, d):
    nodes, edges = surrogate.nodes(spark, d), surrogate.edges(spark, d)
    callers = nodes.filter("is_async and is_first_party").select(F.col("id").alias("src"))
    called = edges.filter("not protected").join(callers, "src", "left_semi").select(F.col("dst").alias("node"))
    entries = nodes.filter("is_async and is_first_party").select(F.col("id").alias("node"))
    return gr05_simple_paths(spark, d).join(entries, "node", "left_semi").join(called, "node", "left_anti")


@query(
    f"""WITH RECURSIVE {PATHS_SQL}, steps AS (SELECT node, root, chain, unnest(list_append(chain, root)) AS id, generate_subscripts(list_append(chain, root), 1) AS pos FROM paths)
SELECT s.node, s.root, array_to_string(s.chain, '>') AS path, string_agg(n.name, ' -> ' ORDER BY s.pos) AS shown FROM steps s JOIN nodes n ON n.id = s.id GROUP BY s.node, s.root, s.chain"""
)
def gr11_report_chain(spark, d):
    p = surrogate.paths(spark, d)
    p = p.select("node", "root", F.concat_ws(">", F.transform("chain", lambda x: x["function_name"])).alias("path"), F.concat(F.transform("chain", lambda x: x["id"]), F.array("root")).alias("ids"))
    steps = p.select("node", "root", "path", F.posexplode("ids").alias("pos", "id")).join(surrogate.nodes(spark, d).select("id", "name"), "id")
    listed = steps.groupBy("node", "root", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("all"))
    return listed.select("node", "root", "path", F.concat_ws(" -> ", F.transform("all", lambda x: x["name"])).alias("shown"))


@query(f"WITH RECURSIVE {PATHS_SQL} SELECT node, root, len(chain) AS depth, row_number() OVER (PARTITION BY node ORDER BY len(chain), root, array_to_string(chain, '>')) AS rank FROM paths")
def so03_reason_order(spark, d):
    p = surrogate.paths(spark, d).select("node", "root", F.size("chain").cast("long").alias("depth"), F.concat_ws(">", F.transform("chain", lambda x: x["function_name"])).alias("path"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("depth", "root", "path"))
    return p.withColumn("rank", rank.cast("long")).drop("path")


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT e.src, e.dst, n.is_async, n.is_first_party, m.status FROM edges e JOIN nodes n ON n.id = e.src JOIN nodes m ON m.id = e.dst WHERE NOT e.protected")
def jn15_edges_with_nodes(spark, d):
    nodes = surrogate.nodes(spark, d)
    callers = nodes.select(F.col("id").alias("src"), "is_async", "is_first_party")
    return surrogate.edges(spark, d).filter("not protected").join(callers, "src").join(nodes.select(F.col("id").alias("dst"), "status"), "dst").select("src", "dst", "is_async", "is_first_party", "status")


@query(f"WITH {EDGES_SQL} SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ',') AS targets FROM edges GROUP BY src")
def ag03_adjacency(spark, d):
    return surrogate.edges(spark, d).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("t")).select("src", F.concat_ws(",", F.col("t").cast("array<string>")).alias("targets"))


@query(f"WITH {EDGES_SQL} SELECT dst, count(*) AS incoming, count(*) FILTER (WHERE NOT protected) AS unprotected FROM edges GROUP BY dst")
def ag04_incoming(spark, d):
    return surrogate.edges(spark, d).groupBy("dst").agg(F.count("*").alias("incoming"), F.count_if(~F.col("protected")).alias("unprotected"))


@query(f"WITH RECURSIVE {SCC_SQL} SELECT b.scc, count(DISTINCT a.scc) AS degree FROM edges e JOIN scc a ON a.id = e.src JOIN scc b ON b.id = e.dst WHERE a.scc <> b.scc GROUP BY b.scc")
def ag05_component_degree(spark, d):
    return gr02_condense_bool_and(spark, d).groupBy(F.col("to_scc").alias("scc")).agg(F.count_distinct("from_scc").alias("degree"))


@query(f"WITH RECURSIVE {SCC_SQL} SELECT scc, array_to_string(list_sort(list(id)), ',') AS members FROM scc GROUP BY scc")
def ag06_component_members(spark, d):
    scc = graph.strongly_connected(surrogate.nodes(spark, d), surrogate.edges(spark, d))
    return scc.groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("m")).select("scc", F.concat_ws(",", F.col("m").cast("array<string>")).alias("members"))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT DISTINCT e.src, e.dst, CASE WHEN e.protected THEN 'protected' WHEN n.status = 'KnownBlocking' THEN 'blocking' ELSE 'open' END AS use FROM edges e JOIN nodes n ON n.id = e.dst")
def pf11_protected_edges(spark, d):
    targets = surrogate.nodes(spark, d).select(F.col("id").alias("dst"), "status")
    use = F.when(F.col("protected"), "protected").when(F.col("status") == graph.KNOWN, "blocking").otherwise("open")
    return surrogate.edges(spark, d).join(targets, "dst").select("src", "dst", use.alias("use")).distinct()


@query(
    f"""WITH RECURSIVE {PATHS_SQL}, kinds AS (SELECT node, root, chain,
  list_filter(list_transform(chain, lambda x: CASE WHEN x % 7 = 0 THEN 3 WHEN x % 11 = 0 THEN 4 ELSE 0 END), lambda k: k > 0) AS k FROM paths)
SELECT node, root, array_to_string(chain, '>') AS path, (CASE WHEN len(k) > 0 THEN k[1] WHEN len(chain) = 1 THEN 1 ELSE 2 END)::INT AS code FROM kinds"""
)
def pf12_code_case(spark, d):
    p = surrogate.paths(spark, d)
    kind = lambda x: F.when(x["id"] % 7 == 0, "PropertyAccess").when(x["id"] % 11 == 0, "ImplicitDunder").otherwise("DirectCall")
    chain = F.transform("chain", lambda x: F.struct(kind(x).alias("edge_kind")))
    return p.select("node", "root", F.concat_ws(">", F.transform("chain", lambda x: x["function_name"])).alias("path"), T.error_number(chain).cast("int").alias("code"))


# joins


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def jn12_semi_warning(spark, d):
    urgent = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def jn13_anti(spark, d):
    pending = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey", "c_nationkey").join(pending, "c_custkey", "left_anti")


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name, o.o_orderstatus FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 45")
def jn01_enclosing(spark, d):
    lines = read(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "o_orderstatus")


@query("SELECT s.s_suppkey, n.n_name, p.first_part FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN (SELECT p_brand, min(p_partkey) AS first_part FROM part GROUP BY p_brand) p ON p.p_brand = 'Brand#' || (s.s_suppkey % 40)::VARCHAR")
def jn02_definition_left(spark, d):
    first = windows.first_wins(read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("first_part")), ["brand"], ["first_part"])
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    suppliers = read(spark, d, "supplier").withColumn("brand", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 40).cast("string")))
    return suppliers.join(nations, "s_nationkey", "left").join(first, "brand", "left").select("s_suppkey", "n_name", "first_part")


@query(
    """SELECT page_id, name FROM (SELECT page_id, replace(replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', ''), 'blog.', '') AS name FROM pages) t
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(replace(replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', ''), 'blog.', ''), '.', 1) || '.example' AS prefix FROM pages WHERE page_id % 5 = 0) q WHERE t.name = q.prefix OR starts_with(t.name, q.prefix || '.'))"""
)
def jn04_module_prefix(spark, d):
    host = F.replace(F.replace(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("www."), F.lit("")), F.lit("blog."), F.lit(""))
    names = read(spark, d, "pages").select("page_id", host.alias("name"))
    prefixes = names.filter("page_id % 5 = 0").select(F.concat(F.substring_index("name", ".", 1), F.lit(".example")).alias("prefix"))
    return joins.module_prefix(names, "name", prefixes, "prefix")


@query("SELECT l_orderkey, min(p_name) AS alias FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name IN ('red ring', 'blue bolt', 'small widget', 'red bolt') GROUP BY l_orderkey")
def jn05_first_alias(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("alias"))
    aliases = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").select("l_orderkey", "alias")
    known = spark.createDataFrame([("red ring",), ("blue bolt",), ("small widget",), ("red bolt",)], "name string")
    return joins.first_match(aliases, ["l_orderkey"], "alias", known, "name")


@query("SELECT p_partkey, bool_or(n = p_name OR starts_with(p_type || '.' || p_name, n || '.')) AS seed FROM part, (VALUES ('red ring'), ('SMALL'), ('PROMO')) v(n) GROUP BY p_partkey")
def jn07_seed(spark, d):
    names = read(spark, d, "part").select("p_partkey", F.explode(F.array("p_name", F.concat_ws(".", "p_type", "p_name"))).alias("name"))
    prefixes = spark.createDataFrame([("red ring",), ("SMALL",), ("PROMO",)], "prefix string")
    hits = joins.module_prefix(names, "name", prefixes, "prefix").select("p_partkey").distinct().withColumn("seed", F.lit(True))
    return read(spark, d, "part").select("p_partkey").join(hits, "p_partkey", "left").select("p_partkey", F.coalesce("seed", F.lit(False)).alias("seed"))


@query(
    """SELECT e.event_id, EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'signup' AND r.user_id = e.user_id AND e.event_id >= r.event_id AND e.event_id + 5 <= r.event_id + 100) AS inside
FROM events e WHERE e.event_type = 'error'"""
)
def jn08_interval_containment(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "event_type")
    points = events.filter("event_type = 'error'").select("user_id", "event_id", (F.col("event_id") + 5).alias("stop"))
    ranges = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("r_start"), (F.col("event_id") + 100).alias("r_end"))
    return joins.contained(points, ranges, ["user_id"], ("event_id", "stop"), ("r_start", "r_end")).select("event_id", "inside")


@query(
    """SELECT o.o_orderkey, coalesce(CASE WHEN o.o_orderkey % 3 = 0 THEN 'configured' END, CASE WHEN c.c_acctbal < 0 THEN 'annotated' END, 'builtin') AS source
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"""
)
def jn09_wrapper_priority(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    configured = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("configured").alias("v"))
    negative = read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    annotated = orders.join(negative, "o_custkey", "left_semi").select("o_orderkey", F.lit("annotated").alias("v"))
    return joins.by_priority(orders, ["o_orderkey"], [(configured, "v"), (annotated, "v")], "source", F.lit("builtin")).select("o_orderkey", "source")


@query("SELECT o_orderkey, coalesce(a.status, o_orderstatus) AS status FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, 'R' AS status FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) a ON a.l_orderkey = o_orderkey")
def jn11_status_override(spark, d):
    override = read(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("R").alias("v")).distinct()
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return joins.by_priority(orders, ["o_orderkey"], [(override, "v")], "status", F.col("o_orderstatus")).select("o_orderkey", "status")


@query(
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'removed' WHEN a.h IS NULL THEN 'added' ELSE 'changed' END AS change FROM
(SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN
(SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) b ON a.doc_id = b.doc_id
WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h"""
)
def jn18_manifest_diff(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    before = docs.filter("doc_id % 7 != 0").select("doc_id", F.sha2("text", 256).alias("h"))
    after = docs.filter("doc_id % 11 != 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return joins.manifest_diff(before, after, "doc_id", "h")


@query(
    """SELECT d.doc_id, CASE WHEN m.doc_id IS NOT NULL THEN 'hit' ELSE 'miss' END AS cache FROM documents d
LEFT JOIN (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 0) m ON m.doc_id = d.doc_id AND m.h = sha256(CASE WHEN d.doc_id % 6 = 0 THEN d.text || ' ' ELSE d.text END)"""
)
def jn17_cache_hits(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    manifest = docs.filter("doc_id % 4 != 0").select("doc_id", F.sha2("text", 256).alias("h"))
    now = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("h"))
    hits, misses = joins.split_by(now, manifest, ["doc_id", "h"])
    return hits.select("doc_id", F.lit("hit").alias("cache")).union(misses.select("doc_id", F.lit("miss").alias("cache")))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, max(p.p_partkey) AS member FROM lineitem l JOIN part p ON p.p_brand = 'Brand#' || (l.l_suppkey % 25)::VARCHAR AND p.p_partkey < l.l_partkey GROUP BY 1, 2, 3")
def jn20_last_member(spark, d):
    """Of each line the last part of a brand before the line's own: an as-of join."""
    brand = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25).cast("string"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", brand.alias("p_brand")).distinct()
    parts = read(spark, d, "part").select("p_brand", "p_partkey")
    found = joins.last_before(lines, parts, ["p_brand"], "l_partkey", "p_partkey", "p_partkey", "member")
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("member").alias("member"))


@query(
    """SELECT DISTINCT e.user_id, e.event_type FROM events e WHERE EXISTS (SELECT 1 FROM events i WHERE i.user_id = e.user_id AND i.event_type = 'signup' AND i.value > 30)
AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.value > 60)"""
)
def jn21_imported_unshadowed(spark, d):
    events = read(spark, d, "events").select("user_id", "event_type", "value")
    imported = events.filter("event_type = 'signup' and value > 30").select("user_id")
    shadowed = events.filter("value > 60").select("user_id", "event_type")
    return events.select("user_id", "event_type").distinct().join(imported, "user_id", "left_semi").join(shadowed, ["user_id", "event_type"], "left_anti")


# windows


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) t WHERE r = 1")
def wn01_first_wins(spark, d):
    return windows.first_wins(read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) t WHERE r = 1")
def wn02_last_wins(spark, d):
    return windows.last_wins(read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS id FROM part")
def wn03_dense_ids(spark, d):
    return windows.dense_ids(read(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"])


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) t WHERE role = 'user' AND next <> 'user'")
def wn04_transition(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return windows.transitions(rows, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn")


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def wn05_adjacent_dedup(spark, d):
    return read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


@query(
    """SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role) t GROUP BY conv_id"""
)
def wn06_first_occurrences(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.concat_ws(",", F.array_distinct(F.transform("t", lambda x: x["role"]))).alias("roles"))


@query("SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def wn07_last_match(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    last = F.try_element_at(F.filter("t", lambda x: x["role"] == "assistant"), F.lit(-1))
    return turns.select("conv_id", last["turn"].alias("turn")).filter("turn is not null")


@query("SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def wn08_first_match(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.get(F.filter("t", lambda x: x["role"] == "user"), F.lit(0))["turn"].alias("turn")).filter("turn is not null")


# sets and aggregates


@query(
    """WITH b AS (SELECT p_brand AS name, min(p_size) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), r AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size = 7), a AS (SELECT p_brand AS name, max(p_size) AS v FROM part WHERE p_size BETWEEN 6 AND 12 GROUP BY 1)
SELECT name, v FROM a UNION ALL SELECT name, v FROM b WHERE name NOT IN (SELECT name FROM r) AND name NOT IN (SELECT name FROM a)"""
)
def st01_effective_db(spark, d):
    part = read(spark, d, "part").select(F.col("p_brand").alias("name"), "p_size", "p_partkey")
    builtin = part.filter("p_partkey % 2 = 0").groupBy("name").agg(F.min("p_size").alias("v"))
    removed = part.filter("p_size = 7").select("name").distinct()
    added = part.filter("p_size between 6 and 12").groupBy("name").agg(F.max("p_size").alias("v"))
    return sets.effective(builtin, removed, added, ["name"])


@query("SELECT DISTINCT p_type AS module FROM part UNION SELECT DISTINCT c_mktsegment FROM customer")
def st02_modules_union(spark, d):
    return read(spark, d, "part").select(F.col("p_type").alias("module")).union(read(spark, d, "customer").select("c_mktsegment")).distinct()


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def st03_edge_set(spark, d):
    return read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT l_orderkey AS k, 'line' AS source FROM lineitem WHERE l_quantity > 48 UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_totalprice > 450000")
def st05_warning_bag(spark, d):
    lines = read(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("source"))
    return lines.unionByName(read(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("source")))


@query("SELECT s_nationkey AS k, max(s_suppkey) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1 UNION ALL SELECT c_nationkey, max(c_custkey) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def st06_wrapper_upsert(spark, d):
    base = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_custkey").alias("v"))
    changes = read(spark, d, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_suppkey").alias("v"))
    return sets.upsert(base, changes, ["k"])


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def st07_difference(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return sets.difference(orders.select("k").distinct(), orders.filter("o_orderstatus = 'F'"), ["k"])


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_f, bool_or(o_orderstatus = 'P') AS any_p, count(*) AS n FROM orders GROUP BY o_custkey")
def ag12_predicates(spark, d):
    f, p = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(f).alias("all_f"), F.bool_or(p).alias("any_p"), F.count("*").alias("n"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS names FROM orders GROUP BY o_custkey")
def ag11_alias_set(spark, d):
    sets_ = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    return sets_.select("o_custkey", F.concat_ws("|", "s").alias("names"))


@query("SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O'")
def ag08_target_set(spark, d):
    return read(spark, d, "lineitem").filter("l_linestatus = 'O'").select("l_orderkey", "l_returnflag").distinct()


@query("SELECT max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END)::INT AS exit_code, count(*) AS n FROM labels")
def ag10_max_exit_code(spark, d):
    code = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return read(spark, d, "labels").agg(F.max(code).cast("int").alias("exit_code"), F.count("*").alias("n"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS newlines, length(text) AS characters FROM documents")
def ag13_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("newlines"), F.length("text").cast("long").alias("characters"))


# orders


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY quality ASC NULLS FIRST, doc_id) AS rank FROM documents LEFT JOIN labels USING (doc_id)")
def so02_nulls_first(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_first("quality"), "doc_id"))
    return rows.select("doc_id", rank.cast("long").alias("rank"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS id FROM lineitem")
def so06_edge_order(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return windows.dense_ids(read(spark, d, "lineitem").select(*order), order).select("l_orderkey", "l_linenumber", "l_partkey", "id")


# scalar functions


@query(
    """SELECT doc_id, (length(p) - length(replace(p, chr(10), '')) + 1)::INT AS line, (length(split_part(p, chr(10), -1)) + 1)::INT AS col
FROM (SELECT doc_id, left(text, (length(text) // 2)::BIGINT) AS p FROM documents) t"""
)
def sc11_offset_to_linecol(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.octet_length(F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))).alias("offset"))
    return docs.select("doc_id", T.line_of(F.col("content"), F.col("offset")).alias("line"), T.column_of(F.col("content"), F.col("offset")).alias("col"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^:]*)$', 1), '^main\\.', '') AS shown FROM pages")
def sc10_display_name(spark, d):
    return read(spark, d, "pages").select("page_id", T.display_name(F.col("url")).alias("shown"))


@query("SELECT page_id, CASE WHEN strpos(e, '(') > 0 THEN trim(split_part(e, '(', 1)) END AS callee FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE replace(url, '/', ' (') END AS e FROM pages) t")
def sc04_callee(spark, d):
    e = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.replace("url", F.lit("/"), F.lit(" (")))
    return read(spark, d, "pages").select("page_id", T.callee(e).alias("callee"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def sc01_sha256(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_type || '.' || p_name END AS qualified FROM part")
def sc02_qualify(spark, d):
    scope = F.when(F.col("p_partkey") % 4 != 0, F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", T.qualify(scope, F.col("p_name")).alias("qualified"))


@query("SELECT doc_id, trim(substr(text, 3, 12)) AS part FROM documents WHERE lang = 'en'")
def sc03_snippet(spark, d):
    docs = read(spark, d, "documents").filter("lang = 'en'")
    a, b = F.octet_length(F.left("text", F.lit(2))), F.octet_length(F.left("text", F.lit(14)))
    return docs.select("doc_id", T.snippet(F.encode("text", "UTF-8"), a, b).alias("part"))


@query(
    """SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'DunderMethod' WHEN p_type IN ('PROMO', 'LARGE') THEN 'Property' WHEN p_type = 'SMALL' THEN 'StaticMethod'
WHEN strpos(q, '.') > 0 AND a THEN 'AsyncMethod' WHEN strpos(q, '.') > 0 THEN 'Method' WHEN a THEN 'AsyncFunction' ELSE 'Function' END AS kind
FROM (SELECT *, p_partkey % 3 = 0 AS a, CASE WHEN p_size > 20 THEN p_type || '.' || p_name ELSE p_name END AS q FROM part) t"""
)
def pf08_kind_case(spark, d):
    name = F.when(F.col("p_name").startswith("red"), F.concat(F.lit("__"), "p_name", F.lit("__"))).otherwise(F.col("p_name"))
    qualified = F.when(F.col("p_size") > 20, F.concat_ws(".", "p_type", "p_name")).otherwise(F.col("p_name"))
    decorator = F.when(F.col("p_type").isin("PROMO", "LARGE"), "functools.property").when(F.col("p_type") == "SMALL", "staticmethod").otherwise("other")
    return read(spark, d, "part").select("p_partkey", T.callable_kind(name, qualified, F.col("p_partkey") % 3 == 0, F.array(decorator)).alias("kind"))


@query(
    """SELECT p_partkey, CASE WHEN k = 'Property' THEN 'PropertyAccess' WHEN dec THEN 'DecoratorCall' WHEN k = 'DunderMethod' THEN 'ImplicitDunder' WHEN strpos(e, '(') = 0 THEN NULL
WHEN starts_with(e, 'super().') THEN 'SuperCall' WHEN strpos(split_part(e, '(', 1), '.') > 0 THEN 'MethodCall' ELSE 'DirectCall' END AS kind FROM (
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Property' WHEN 1 THEN 'DunderMethod' ELSE 'Function' END AS k, p_size % 7 = 0 AS dec,
CASE p_partkey % 4 WHEN 0 THEN 'f' WHEN 1 THEN 'f(x)' WHEN 2 THEN 'a.f(x)' ELSE 'super().f(x)' END AS e FROM part) t"""
)
def pf10_edge_kind_case(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "Property").when(F.col("p_size") % 3 == 1, "DunderMethod").otherwise("Function")
    e = F.when(F.col("p_partkey") % 4 == 0, "f").when(F.col("p_partkey") % 4 == 1, "f(x)").when(F.col("p_partkey") % 4 == 2, "a.f(x)").otherwise("super().f(x)")
    return read(spark, d, "part").select("p_partkey", T.edge_kind(kind, F.col("p_size") % 7 == 0, e).alias("kind"))


@query("SELECT page_id, url, (path = 'en/1' OR starts_with(path, 'en/1/') OR ends_with(path, '.html') OR path = 'fr/2') AS excluded FROM (SELECT page_id, url, regexp_replace(split_part(url, '://', 2), '^[^/]*/', '') AS path FROM pages) t")
def pf01_exclude_globs(spark, d):
    path = F.regexp_replace(F.get(F.split("url", "://"), F.lit(1)), "^[^/]*/", "")
    return read(spark, d, "pages").select("page_id", "url", T.excluded(path, F.array(F.lit("en/1/**"), F.lit("**/.html"), F.lit("fr/2"))).alias("excluded"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' OR ends_with('x.' || c_mktsegment, '.BUILDING') THEN true ELSE false END AS hit FROM customer")
def pf09_decorator(spark, d):
    decorators = F.array(F.when(F.col("c_mktsegment") == "BUILDING", "x.BUILDING").when(F.col("c_mktsegment") == "MACHINERY", "BUILDING").otherwise("none"))
    return read(spark, d, "customer").select("c_custkey", T.is_decorated(decorators, "BUILDING").alias("hit"))


@query("SELECT c_custkey, substr(replace(c_name, '#', '/'), 10) AS rel FROM customer")
def sc12_relative_path(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.relative_path(F.replace("c_name", F.lit("#"), F.lit("\\")), F.lit("Customer")).alias("rel"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_type = 'SMALL' THEN p_name ELSE p_type || '.' || p_name END AS shown FROM part")
def sc13_party_name(spark, d):
    path = F.concat(F.when(F.col("p_type") == "SMALL", "pkg/main").otherwise(F.col("p_type")), F.lit(".py"))
    return read(spark, d, "part").select("p_partkey", T.party_name(path, F.col("p_name"), F.col("p_partkey") % 3 == 0).alias("shown"))


@query("SELECT p_partkey, trim(p_name) || '/' || p_type AS text FROM part")
def sc05_decorator_text(spark, d):
    return read(spark, d, "part").select("p_partkey", T.decorator_text(F.concat(F.lit(" @ "), "p_name", F.lit("/"), "p_type", F.lit(" "))).alias("text"))


@query("SELECT s_suppkey, replace(s_name, '#', '.') AS module FROM supplier")
def sc15_stub_stem(spark, d):
    """A stub's module is its file's name up to the last dot."""
    path = F.concat(F.lit("typings/v1.2/"), F.replace("s_name", F.lit("#"), F.lit(".")), F.lit(".pyi"))
    return read(spark, d, "supplier").select("s_suppkey", T.stem(path).alias("module"))


_KEY = "'root' || chr(92) || s_name || '/' || s_nationkey || ':' || s_suppkey"


@query(f"SELECT s_suppkey, 'root_' || s_name || '_' || s_nationkey || '_' || s_suppkey || '-' || left(sha256({_KEY}), 12) AS file FROM supplier")
def sc21_storage_key(spark, d):
    text = lambda c: F.col(c).cast("string")
    key = F.concat(F.lit("root\\"), "s_name", F.lit("/"), text("s_nationkey"), F.lit(":"), text("s_suppkey"))
    return read(spark, d, "supplier").select("s_suppkey", T.storage_key(key).alias("file"))


_MIXED = "(id * 7919) % 10007"  # edges of the graph lead up and down in the ids; along this order they make no circle


@query(
    f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, down AS (SELECT src, dst FROM edges WHERE {_MIXED.replace("id", "src")} < {_MIXED.replace("id", "dst")}),
below AS (SELECT src AS a, dst AS b FROM down UNION SELECT r.a, e.dst FROM below r JOIN down e ON e.src = r.b),
above AS (SELECT id AS v, id AS u FROM nodes UNION ALL SELECT b, a FROM below),
labels AS (SELECT v, max(u) AS m, [max(u)] AS label FROM above GROUP BY v
  UNION ALL SELECT l.v, n.u, list_append(l.label, n.u) FROM labels l, LATERAL (SELECT max(a.u) AS u FROM above a JOIN below b ON b.a = l.m AND b.b = a.u WHERE a.v = l.v) n WHERE l.m <> l.v)
SELECT v AS id, row_number() OVER (ORDER BY label) - 1 AS position FROM labels WHERE m = v"""
)
def so08_topological_order(spark, d):
    """Again and again the least part that is ready."""
    up = surrogate.edges(spark, d).filter(F.expr(_MIXED.replace("id", "src")) < F.expr(_MIXED.replace("id", "dst")))
    return graph.topological_order(surrogate.nodes(spark, d), up)


@query(
    f"""WITH RECURSIVE {NODES_SQL},
steps AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS dst, l_returnflag AS flag FROM lineitem),
edges AS (SELECT src, dst, bool_and(flag = 'A') AS protected FROM steps WHERE src <> dst GROUP BY src, dst),
usable AS (SELECT e.src, e.dst FROM edges e JOIN nodes n ON n.id = e.src WHERE NOT e.protected AND n.status <> 'KnownNonBlocking'),
away AS (SELECT id, 0 AS d FROM nodes WHERE status = 'KnownBlocking' UNION SELECT u.src, a.d + 1 FROM away a JOIN usable u ON u.dst = a.id WHERE a.d < 30),
near AS (SELECT id, min(d) AS d FROM away GROUP BY id),
best AS (SELECT id AS node, id AS root, []::BIGINT[] AS chain, 0 AS d FROM near WHERE d = 0 UNION ALL
  SELECT node, root, chain, d FROM (SELECT u.src AS node, b.root, list_prepend(u.src, b.chain) AS chain, n.d, row_number() OVER (PARTITION BY u.src ORDER BY b.root, list_prepend(u.src, b.chain)) AS r
    FROM best b JOIN usable u ON u.dst = b.node JOIN near n ON n.id = u.src AND n.d = b.d + 1) t WHERE r = 1)
SELECT node, root, d::BIGINT AS depth, array_to_string(list_append(chain, root), '>') AS path FROM best"""
)
def gr06_shortest_reasons(spark, d):
    """The first reason of every part, on all edges whatever their numbers."""
    edges = surrogate.edges(spark, d, banded=False)
    best = graph.shortest_paths(surrogate.nodes(spark, d), edges, F.struct(F.col("src").alias("id")))
    shown = F.concat_ws(">", F.transform("chain", lambda x: x["id"].cast("string")), F.col("root").cast("string"))
    return best.select("node", "root", F.size("chain").cast("long").alias("depth"), shown.alias("path"))


#: An argument list for every part: brackets, commas and quotes stand where the part's columns say.
_ARGUMENTS_SQL = """SELECT p_partkey, p_size, substr('([{', (p_size % 3 + 1)::INT, 1) || p_name || CASE WHEN p_size % 4 = 0 THEN ', ' ELSE substr(')]}', (p_partkey % 3 + 1)::INT, 1) || ' ,  ' END || 'f(' || p_type || ',' || p_brand || ')' ||
  CASE p_partkey % 5 WHEN 0 THEN ', "a,' || p_size || '"' WHEN 1 THEN ',,é=' || p_size WHEN 2 THEN ')' || ',x ' ELSE '' END AS args FROM part"""
_SCANNED_SQL = f"""lists AS ({_ARGUMENTS_SQL}),
characters AS (SELECT p_partkey, p_size, args, unnest(string_split(args, '')) AS c, generate_subscripts(string_split(args, ''), 1) AS i FROM lists),
steps AS (SELECT *, sum(CASE WHEN c IN ('(', '[', '{{') THEN 1 WHEN c IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS s FROM characters),
depths AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY p_partkey ORDER BY i)) AS depth FROM steps),
parts AS (SELECT *, count(*) FILTER (WHERE c = ',' AND depth = 0) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part, c = ',' AND depth = 0 AS cut FROM depths),
raws AS (SELECT p_partkey, p_size, part, string_agg(c, '' ORDER BY i) FILTER (WHERE NOT cut) AS raw, min(i) AS first, any_value(args) AS args FROM parts GROUP BY 1, 2, 3),
found AS (SELECT p_partkey, p_size, trim(raw) AS text, (strlen(left(args, (first - 1)::INT)) + strlen(raw) - strlen(ltrim(raw)))::BIGINT AS start FROM raws WHERE trim(coalesce(raw, '')) <> '')"""


def _argument_lists(spark, d):
    pick = lambda signs, n: F.substr(F.lit(signs), (n % 3 + 1).cast("int"), F.lit(1))
    size = F.col("p_size").cast("string")
    tail = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(', "a,'), size, F.lit('"'))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(",,é="), size)).when(F.col("p_partkey") % 5 == 2, F.lit("),x ")).otherwise("")
    middle = F.when(F.col("p_size") % 4 == 0, F.lit(", ")).otherwise(F.concat(pick(")]}", F.col("p_partkey")), F.lit(" ,  ")))
    args = F.concat(pick("([{", F.col("p_size")), "p_name", middle, F.lit("f("), "p_type", F.lit(","), "p_brand", F.lit(")"), tail)
    return read(spark, d, "part").select("p_partkey", "p_size", args.alias("args"))


@query(f"WITH {_SCANNED_SQL} SELECT p_partkey, trim(coalesce(raw, '')) AS text, part AS position FROM raws")
def sc06_split_arguments(spark, d):
    return _argument_lists(spark, d).select("p_partkey", F.posexplode(T.split_arguments(F.col("args"))).alias("position", "a")).select("p_partkey", F.col("a.text").alias("text"), F.col("position").cast("long").alias("position"))


@query(f"WITH {_SCANNED_SQL} SELECT p_partkey, text, start + p_size + 7 AS first, start + p_size + 7 + strlen(text) AS last FROM found")
def sc07_argument_ranges(spark, d):
    """Of calls that stand ``p_size`` and one bytes into their files."""
    calls = _argument_lists(spark, d).withColumn("call", F.concat(F.lit("rsult("), "args", F.lit(")")))
    ranges = T.argument_ranges(F.col("call"), F.col("p_size") + 1)
    return calls.select("p_partkey", F.explode(ranges).alias("a")).select("p_partkey", F.col("a.text").alias("text"), F.col("a.start").alias("first"), F.col("a.end").alias("last"))
