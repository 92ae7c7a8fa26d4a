"""A call graph over ``part`` and ``lineitem``, for running the graph operators on plain tables.

Nodes are parts; an edge leads from a part to the next one in an order when their numbers are close.
The band grows with the number of parts, which keeps the number of paths in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_size") <= 5, graph.KNOWN).when(F.col("p_size") == 50, graph.NEVER).otherwise(graph.OPEN)
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 3 == 0).alias("is_async"), (F.col("p_partkey") % 5 != 0).alias("is_first_party"), status.alias("status")
    )


def edges(spark: SparkSession, sf_dir: str, banded: bool = True) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    steps = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_returnflag").alias("flag"))
    near = steps.filter(F.col("src") != F.col("dst"))
    if banded:
        near = near.filter(F.abs(F.col("dst") - F.col("src")) <= read(spark, sf_dir, "part").count() / 100)
    return near.groupBy("src", "dst").agg(F.bool_and(F.col("flag") == "A").alias("protected"))


NODES_SQL = """nodes AS (SELECT p_partkey AS id, p_name AS name, p_partkey % 3 = 0 AS is_async, p_partkey % 5 <> 0 AS is_first_party,
  CASE WHEN p_size <= 5 THEN 'KnownBlocking' WHEN p_size = 50 THEN 'KnownNonBlocking' ELSE 'Unknown' END AS status FROM part)"""
EDGES_SQL = """edges AS (SELECT src, dst, bool_and(flag = 'A') AS protected FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS dst, l_returnflag AS flag FROM lineitem) t
  WHERE src <> dst AND abs(dst - src) <= (SELECT count(*) FROM part) / 100.0 GROUP BY src, dst)"""
PATHS_SQL = f"""{NODES_SQL}, {EDGES_SQL},
usable AS (SELECT e.src, e.dst FROM edges e JOIN nodes n ON n.id = e.src WHERE NOT e.protected AND n.status <> 'KnownNonBlocking'),
paths AS (
  SELECT u.src AS node, u.dst AS root, [u.src] AS chain FROM usable u JOIN nodes n ON n.id = u.dst WHERE n.status = 'KnownBlocking'
  UNION ALL
  SELECT u.src, p.root, list_prepend(u.src, p.chain) FROM paths p JOIN usable u ON u.dst = p.node WHERE NOT list_contains(p.chain, u.src))"""
SCC_SQL = f"""{NODES_SQL}, {EDGES_SQL},
reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b),
scc AS (SELECT n.id, least(n.id, coalesce(min(r.b), n.id)) AS scc FROM nodes n
  LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) r ON r.a = n.id GROUP BY n.id)"""


def paths(spark: SparkSession, sf_dir: str, **bounds) -> DataFrame:
    link = F.struct(F.col("src").cast("string").alias("function_name"), F.col("src").alias("id"))
    return graph.simple_paths(nodes(spark, sf_dir), edges(spark, sf_dir), link, F.col("src").cast("string"), **bounds).filter(F.size("chain") > 0)
