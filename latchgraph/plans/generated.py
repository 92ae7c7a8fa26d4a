"""The whole analysis over Python source generated from the tables.

Every part of the surrogate call graph becomes a function, every edge a call: awaited functions for asynchronous
parts, ``@blocking`` and ``@non_blocking`` for known ones, a call handed to a thread for protected edges; fifty parts
make a file, and calls between files go through imports.  The report must then agree with what SQL finds on
the graph itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import KNOWN, NEVER
from ..session import cut, ship
from ..sources.config import Config
from ..sources.facts import read_facts
from . import surrogate
from .analyze import analyze_facts
from .surrogate import PATHS_SQL

ROOT = "generated"
PER_FILE = 50


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as ``sources.files`` gives them."""
    file_of = lambda c: F.floor(F.col(c) / PER_FILE).cast("string")
    function = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    edges = surrogate.edges(spark, sf_dir)
    call = F.concat(function("dst"), F.lit("()"))
    line = F.concat(F.lit("    "), F.when(F.col("protected"), F.concat(F.lit("asyncio.to_thread(lambda: "), call, F.lit(")"))).otherwise(call), F.lit("\n"))
    bodies = edges.groupBy(F.col("src").alias("id")).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("dst", line.alias("line")))), lambda x: x["line"])).alias("body"))
    mark = F.when(F.col("status") == KNOWN, "@blocking\n").when(F.col("status") == NEVER, "@non_blocking\n").otherwise("")
    text = F.concat(mark, F.when(F.col("is_async"), "async def ").otherwise("def "), function("id"), F.lit("():\n"), F.coalesce("body", F.lit("")), F.lit("    return 1\n\n\n"))
    defined = surrogate.nodes(spark, sf_dir).join(bodies, "id", "left").groupBy(file_of("id").alias("file")).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("id", text.alias("text")))), lambda x: x["text"])).alias("text"))
    used = edges.select(file_of("src").alias("file"), file_of("dst").alias("other"), "dst").filter("file != other").distinct()
    imports = used.groupBy("file").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("dst", F.concat(F.lit("from m"), "other", F.lit(" import "), function("dst"), F.lit("\n")).alias("line")))), lambda x: x["line"])).alias("imports"))
    whole = F.concat(F.lit("import asyncio\nfrom latchgraph import blocking, non_blocking\n"), F.coalesce("imports", F.lit("")), F.lit("\n\n"), "text")
    files = defined.join(imports, "file", "left")
    return files.select(
        F.lit(ROOT).alias("project"), F.concat(F.lit("m"), "file", F.lit(".py")).alias("path"), F.concat(F.lit("m"), "file").alias("module"), F.lit(False).alias("is_package"), F.lit(False).alias("is_stub"), F.lit(True).alias("is_first_party"), F.encode(whole, "UTF-8").alias("content")
    )


def generated_project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, root, depth and code number of every diagnostic."""
    ship(spark)
    facts = cut(read_facts(source_files(spark, sf_dir)))
    found = analyze_facts(facts, [Config(root=ROOT)]).diagnostics
    number = lambda x: F.regexp_extract(x, "f([0-9]+)$", 1).cast("long")
    return found.select(number(F.col("chain")[0]["function"]).alias("node"), number(F.element_at("chain", -1)["function"]).alias("root"), (F.size("chain") - 1).cast("long").alias("depth"), F.substring("code", -1, 1).cast("int").alias("code"), F.concat_ws(">", F.transform("chain", lambda x: F.regexp_extract(x["function"], "f([0-9]+)$", 1))).alias("path"))


SQL = f"""WITH RECURSIVE {PATHS_SQL},
inner_ AS (SELECT e.src, e.dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE NOT e.protected AND a.is_async AND b.is_async AND a.status <> 'KnownNonBlocking'),
round_ AS (SELECT src AS a, dst AS b FROM inner_ UNION SELECT r.a, i.dst FROM round_ r JOIN inner_ i ON i.src = r.b),
silent AS (SELECT DISTINCT i.dst AS id FROM inner_ i WHERE i.src <> i.dst AND NOT EXISTS (SELECT 1 FROM round_ r WHERE r.a = i.dst AND r.b = i.src))
SELECT p.node, p.root, len(p.chain) AS depth, (CASE WHEN len(p.chain) = 1 THEN 1 ELSE 2 END)::INT AS code, array_to_string(list_append(p.chain, p.root), '>') AS path
FROM paths p JOIN nodes n ON n.id = p.node WHERE n.is_async AND p.node NOT IN (SELECT id FROM silent)"""
