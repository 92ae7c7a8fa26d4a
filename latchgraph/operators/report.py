"""Diagnostics and warnings from blocking paths, in total order."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EDGE_KINDS, callee, display_name, error_number
from ..names import ANNOTATIONS, PREFIX
from ..session import cut, small
from ..sources.builtin import rows
from ..sources.config import Config
from .callgraph import NO_THREADS, CallGraph
from .graph import NEVER, shortest_paths, simple_paths, strongly_connected

# fixed values: texts of diagnostics
DIRECT = "Direct blocking call to '%s' in async function '%s'"
TRANSITIVE = "Transitive blocking call reachable from async context"
PROPERTY = "Async function '%s' accesses blocking property '%s'"
DUNDER = "Async function '%s' calls blocking dunder method '%s'"
HELP = (
    "Wrap in `await asyncio.to_thread(...)` or use async alternative",
    "Wrap the blocking call in `await asyncio.to_thread(...)` or use async alternative",
    "Avoid blocking I/O in property getters used from async code",
    "Avoid blocking I/O in dunder methods invoked from async code",
)
ASYNC_HERE, FUNCTION_HERE, GETTER_HERE, DUNDER_HERE = "async function %s defined here", "%s defined here", "property getter defined here", "dunder method defined here"
CALL_HERE, STUB_HERE, ROOT_HERE = "blocking call: %s", "%s marked blocking with @blocking in stub", "blocking function %s defined here"
LOST_IMPORT, BROKEN = "Unresolvable import: %s", "Syntax error in %s"
NO_THREAD = "asyncio.to_thread is unavailable for configured python_version %s; executor protection was not applied"


def _linked(graph: CallGraph) -> tuple[DataFrame, Column]:
    """Edges with what a report shows of them, and the link made of it."""
    shown = graph.nodes.filter("is_first_party").select("project", F.col("id").alias("src"), F.col("display").alias("f_display"), F.col("path").alias("f_path"), F.col("line").alias("f_line"), F.col("column").alias("f_column"), "is_async")
    edges = graph.edges.join(shown, ["project", "src"])
    order = F.array_position(F.array(*[F.lit(k) for k in EDGE_KINDS]), F.col("edge_kind")).cast("int")
    link = F.struct(
        F.col("src").alias("function_name"), F.col("start").alias("call_start"), F.col("end").alias("call_end"), F.col("dst").alias("callee_name"), order.alias("edge_order"), "edge_kind", "is_async",
        F.col("f_display").alias("display"), F.col("f_path").alias("path"), F.col("f_line").alias("line"), F.col("f_column").alias("column"),
        F.col("path").alias("call_path"), F.col("line").alias("call_line"), F.col("column").alias("call_column"), "bare_column",
    )
    return edges, link


def reasons(graph: CallGraph, max_length: int | None = None, max_paths: int | None = None) -> DataFrame:
    """(project, node, root, chain) of all blocking paths; links carry what a report shows of them."""
    edges, link = _linked(graph)
    return simple_paths(graph.nodes.select("project", "id", "status"), edges, link, F.col("src"), ["project"], max_length, max_paths)


def shortest(graph: CallGraph) -> DataFrame:
    """The first of each node's reasons."""
    edges, link = _linked(graph)
    return shortest_paths(graph.nodes.select("project", "id", "status"), edges, link, ["project"])


def ranked(found: DataFrame) -> DataFrame:
    """Distinct reasons with their rank at each node: by chain length, root, chain."""
    rank = F.row_number().over(Window.partitionBy("project", "node").orderBy(F.size("chain"), "root", "chain"))
    return found.distinct().withColumn("rank", rank)


def suppressed(graph: CallGraph) -> DataFrame:
    """(project, node) called without protection by another async function.

    Callers that never block, callers inside the same cycle and the function itself do not count.
    """
    callers = graph.nodes.filter("is_async and is_first_party").select("project", F.col("id").alias("src"), F.col("status").alias("s"))
    between = graph.edges.filter("not protected and src != dst").select("project", "src", "dst").distinct()
    calls = between.join(callers.filter(F.col("s") != NEVER).drop("s"), ["project", "src"])
    inner = calls.join(callers.select("project", F.col("src").alias("dst")), ["project", "dst"], "left_semi")
    ids = inner.select("project", F.col("src").alias("id")).union(inner.select("project", F.col("dst").alias("id")))
    scc = strongly_connected(ids, inner, ["project"])
    calls = calls.join(scc.select("project", F.col("id").alias("src"), F.col("scc").alias("a")), ["project", "src"], "left").join(scc.select("project", F.col("id").alias("dst"), F.col("scc").alias("b")), ["project", "dst"], "left")
    return calls.filter("not (a <=> b) or a is null").select("project", F.col("dst").alias("node")).distinct()


def diagnostics(graph: CallGraph, found: DataFrame, configs: Sequence[Config]) -> DataFrame:
    spark = found.sparkSession
    settings = spark.createDataFrame([(c.root, c.severity, c.intervention_strategy) for c in configs], "project string, severity string, intervention_strategy string")
    entries = found.filter(F.size("chain") > 0).filter(F.col("chain")[0]["is_async"]).join(suppressed(graph), ["project", "node"], "left_anti")
    root = graph.nodes.select("project", F.col("id").alias("root"), F.struct("display", "path", "line", "column", "is_async", "is_first_party", "is_stub").alias("r"))
    d = entries.join(root, ["project", "root"]).join(small(settings, len(configs)), "project")
    chain = F.col("chain")
    d = d.withColumn("number", error_number(chain))
    special = F.array_position(F.transform(chain, lambda x: x["edge_kind"]), F.when(F.col("number") == 3, "PropertyAccess").when(F.col("number") == 4, "ImplicitDunder").otherwise("-"))
    boundary = F.filter(F.sequence(F.lit(1), F.size(chain)), lambda i: F.get(chain, i - 1)["is_async"] & ~F.coalesce(F.get(chain, i)["is_async"], F.lit(True)))
    position = F.when(special > 0, special.cast("int")).when(F.col("intervention_strategy") == "async-boundary", F.coalesce(F.get(boundary, F.lit(0)), F.lit(1))).otherwise(F.size(chain))
    d = d.withColumn("at", position).withColumn("link", F.get(chain, F.col("at") - 1)).withColumn("next", F.get(chain, F.col("at")))
    r, link, after = F.col("r"), F.col("link"), F.col("next")
    column = F.when(F.col("number") == 3, F.coalesce(link["bare_column"], link["call_column"])).otherwise(link["call_column"])
    shown_root = F.when(r["is_first_party"], r["display"]).otherwise(display_name(F.col("root")))
    head = F.get(chain, F.lit(0))
    subject = F.when(F.col("number") < 3, display_name(F.col("root"))).otherwise(display_name(link["callee_name"]))
    message = F.when(F.col("number") == 1, F.format_string(DIRECT, subject, display_name(head["function_name"]))).when(F.col("number") == 2, F.lit(TRANSITIVE)).when(F.col("number") == 3, F.format_string(PROPERTY, display_name(head["function_name"]), subject)).otherwise(F.format_string(DUNDER, display_name(head["function_name"]), subject))
    related = lambda p, l, c, m: F.struct(p.alias("file"), l.alias("line"), c.alias("column"), m.alias("message"))  # noqa: E731, E741
    none = F.filter(F.array(related(head["path"], head["line"], head["column"], F.lit(""))), lambda x: F.lit(False))
    on_the_way = F.transform(F.slice(chain, F.lit(2), F.size(chain)), lambda x: related(x["path"], x["line"], F.lit(1), F.format_string(FUNCTION_HERE, x["display"])))
    call = F.array(related(link["call_path"], link["call_line"], column, F.format_string(CALL_HERE, shown_root)))
    getter = lambda text: F.when(after.isNotNull(), F.array(related(after["path"], after["line"], after["column"], F.lit(text)))).when(r["is_first_party"], F.array(related(r["path"], r["line"], r["column"], F.lit(text)))).otherwise(none)
    middle = F.when(F.col("number") == 2, F.concat(on_the_way, call)).when(F.col("number") == 3, getter(GETTER_HERE)).when(F.col("number") == 4, getter(DUNDER_HERE)).otherwise(none)
    end = F.when(r["is_stub"], F.array(related(r["path"], r["line"], r["column"], F.format_string(STUB_HERE, F.col("root"))))).when(r["is_first_party"], F.array(related(r["path"], r["line"], r["column"], F.format_string(ROOT_HERE, display_name(F.col("root")))))).otherwise(none)
    start = F.array(related(head["path"], head["line"], head["column"], F.format_string(ASYNC_HERE, head["display"])))
    entry = lambda n, f, l, a, p: F.struct(n.alias("function"), f.alias("file"), l.alias("line"), a.alias("is_async"), p.alias("is_first_party"))  # noqa: E731, E741
    links = F.transform(chain, lambda x: entry(x["display"], x["path"], x["line"], x["is_async"], F.lit(True)))
    ours = r["is_first_party"]
    tail = F.array(entry(shown_root, F.when(ours, r["path"]), F.when(ours, r["line"]), F.when(ours, r["is_async"]).otherwise(False), ours))
    helps = F.get(F.array(*[F.lit(h) for h in HELP]), F.col("number") - 1)
    category = spark.createDataFrame([(n, c) for n, _, c in rows()], "root string, category string")
    out = d.join(F.broadcast(category), "root", "left").select(
        "project", F.concat(F.lit(PREFIX), F.lpad(F.col("number").cast("string"), 3, "0")).alias("code"), "severity", message.alias("message"),
        F.struct(link["call_path"].alias("file"), link["call_line"].alias("line"), column.alias("column")).alias("primary_location"),
        F.array_distinct(F.concat(start, middle, end)).alias("related_locations"), F.concat(links, tail).alias("chain"), helps.alias("help"), "intervention_strategy", "category",
    )
    return out.dropDuplicates()


ORDER = ["project", "primary_location.file", "primary_location.line", "primary_location.column", "code", "chain", "message"]


def ordered(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.orderBy(*ORDER)


def ordered_warnings(told: DataFrame) -> DataFrame:
    """By file, those without one first, then by message."""
    return told.orderBy("project", F.asc_nulls_first("file"), "message")


def warnings(facts: DataFrame, graph: CallGraph, configs: Sequence[Config]) -> DataFrame:
    """(project, file, message): syntax errors, imports that lead nowhere, threads a Python version lacks."""
    spark = facts.sparkSession
    broken = facts.filter("fact = 'syntax_error'").select("project", F.col("path").alias("file"), F.format_string(BROKEN, "path").alias("message"))
    old = spark.createDataFrame([(c.root, c.python_version) for c in configs if c.python_version in NO_THREADS], "project string, version string")
    refs = facts.filter("fact = 'reference' and kind = 'call'").select("project", "path", "target", callee(F.col("expression")).alias("local")).distinct()
    threads = refs.join(graph.targets.filter(F.array_contains("names", "asyncio.to_thread")), ["project", "target"]).join(small(old, len(configs)), "project")
    threads = threads.select("project", F.col("path").alias("file"), F.format_string(NO_THREAD, "version").alias("message")).distinct()
    # modules that are there: the project's own, the standard library's, those that tables and configuration name
    top = {n.split(".")[0] for n, _, _ in rows()} | set(sys.stdlib_module_names) | {ANNOTATIONS}
    general = spark.createDataFrame([(x,) for x in sorted(top)], "first string")
    named = {(c.root, x.split(".")[0]) for c in configs for x in [*[a[0] for a in c.added], *c.blocking_modules, *[w[0] for w in c.wrappers]]}
    named_frame = spark.createDataFrame(sorted(named), "project string, first string")
    modules = facts.select("project", F.substring_index("module", ".", 1).alias("first")).distinct()
    imports = facts.filter("fact = 'import' and kind = 'name' and level = 0 and name != '*'").select("project", "path", F.col("target").alias("base"), F.coalesce("expression", "name").alias("local"), F.substring_index("target", ".", 1).alias("first"))
    lost = imports.join(small(general, len(top)), "first", "left_anti").join(modules, ["project", "first"], "left_anti").join(named_frame, ["project", "first"], "left_anti")
    used = lost.join(refs.select("project", "path", "local").distinct(), ["project", "path", "local"], "left_semi")
    lost = used.select("project", F.col("path").alias("file"), F.format_string(LOST_IMPORT, "base").alias("message"))
    return cut(broken.unionByName(threads).unionByName(lost))
