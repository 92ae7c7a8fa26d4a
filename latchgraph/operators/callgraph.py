"""The call graph: nodes with statuses, edges with protection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dotted_prefixes, edge_kind, party_name, qualify, stem
from ..names import ANNOTATIONS
from ..session import cut, sized, small, written
from ..sources.builtin import implementation_aliases, rows
from ..sources.config import Config
from ..sources.facts import SPECIAL, special_methods
from . import flow, joins, resolve, sets
from .graph import KNOWN, NEVER, OPEN

NO_THREADS = ("3.7", "3.8")
ANNOTATION_NAMES = ("blocking", "non_blocking", "unblocker")


class CallGraph(NamedTuple):
    functions: DataFrame
    nodes: DataFrame  # project, id, status, kind, is_async, is_first_party, display, path, line, column, is_stub
    edges: DataFrame | None  # project, src, dst, kind, protected, in_executor, via and the call's place
    targets: DataFrame


def database(spark, configs: Sequence[Config]) -> tuple[DataFrame, DataFrame]:
    """(project, name, category) and (project, prefix) of every project: (built-in - removed) + added; bounded by configuration, and broadcast
    where that is small."""
    projects = spark.createDataFrame([(c.root,) for c in configs], "project string")
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("category")) for n, _, c in rows()])
    builtin = projects.select("project", F.inline(table))
    removed = spark.createDataFrame([(c.root, n) for c in configs for n in c.removed], "project string, name string")
    added = spark.createDataFrame([(c.root, n, k) for c in configs for n, _, k in c.added], "project string, name string, category string")
    entries = sets.effective(builtin, removed, added, ["project", "name"])
    other = spark.createDataFrame(implementation_aliases(), "alias string, name string")
    entries = entries.unionByName(entries.join(F.broadcast(other), "name").select("project", F.col("alias").alias("name"), "category"))
    prefixes = [(c.root, p) for c in configs for p in c.blocking_modules]
    modules = spark.createDataFrame(prefixes, "project string, prefix string").distinct()
    most = (len(rows()) + len(implementation_aliases())) * len(configs) + 2 * sum(len(c.added) for c in configs)
    return small(entries, most), small(modules, len(prefixes))


def methods(files: DataFrame, configs: Sequence[Config]) -> list[str] | None:
    """The special methods that operators may lead to an edge by; None if all may.

    They are those that stand in the sources (``content``) or in the table of blocking names.  A function, an import, a stub or an attribute of
    such a name would have it in its text, so operators that call others give no edge.  Where whole modules block, a base class from one
    has any method.
    """
    if any(c.blocking_modules for c in configs):
        return None
    found = special_methods(files)
    if found is None:
        return None
    named = [n for n, _, _ in rows()] + [x[0] for c in configs for x in c.added] + [n for pair in implementation_aliases() for n in pair]
    return sorted(found | {n.split(".")[-1] for n in named} & SPECIAL)


def annotations(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """(project, identity, absolute, is_stub, annotation, position, keyword) of annotated functions."""
    known = F.explode(F.array(*[F.struct(F.lit(f"{base}.{n}").alias("full"), F.lit(n).alias("annotation")) for base in (ANNOTATIONS, f"{ANNOTATIONS}.annotations", f"{ANNOTATIONS}._annotations") for n in ANNOTATION_NAMES]))
    spelled = facts.sparkSession.range(1).select(known.alias("k")).select("k.*")
    # names that are no annotation's go before references are joined
    meant = targets.select("project", "target", F.explode(F.concat("names", F.array("resolved"))).alias("full")).join(F.broadcast(spelled), "full").distinct()
    absolute = qualify(F.nullif(F.col("module"), F.lit("")), F.col("enclosing"))
    uses = facts.filter("fact = 'reference' and kind = 'decorator'").select("project", "target", F.concat_ws(":", "path", "enclosing").alias("identity"), absolute.alias("absolute"), "is_stub", "arguments")
    uses = uses.join(sized(cut(meant)), ["project", "target"])
    given = F.get(F.filter("arguments", lambda a: a["keyword"] == "callable_param"), F.lit(0))["text"]
    number = F.try_to_number(F.when(given.rlike("^[0-9]{1,9}$"), given), F.lit("999999999")).cast("int")
    word = F.nullif(F.regexp_extract(given, r"^[\"'](.*)[\"']$", 1), F.lit(""))
    return uses.select("project", "identity", "absolute", "is_stub", "annotation", F.when(word.isNull(), F.coalesce(number, F.lit(0))).alias("position"), word.alias("keyword")).distinct()


def _matching(names: DataFrame, entries: DataFrame, modules: DataFrame, stubs: DataFrame, calm: DataFrame) -> DataFrame:
    """The (project, name) pairs that block: in the table, under a blocking module, or marked in a stub, and not marked as calm."""
    exact = names.join(entries.select("project", "name"), ["project", "name"], "left_semi")
    under = joins.module_prefix(names, "name", modules, "prefix", ["project"])
    marked = names.join(stubs, ["project", "name"], "left_semi")
    return exact.union(under).union(marked).distinct().join(calm, ["project", "name"], "left_anti")


def _own(functions: DataFrame, marks: DataFrame, entries: DataFrame, modules: DataFrame) -> DataFrame:
    """The nodes of the project's functions: an annotation before the table, non_blocking before blocking."""
    party = functions.filter("not is_stub")
    own = marks.filter("not is_stub").groupBy("project", "identity").agg(F.bool_or(F.col("annotation") == "non_blocking").alias("calm"), F.bool_or(F.col("annotation") == "blocking").alias("bad"))
    asked = party.select("project", "identity", F.explode(F.array_distinct(F.array("qualified_name", "absolute", F.concat_ws(".", stem(F.col("path")), "qualified_name")))).alias("name"))
    exact = asked.join(entries.select("project", "name"), ["project", "name"], "left_semi")
    under = joins.module_prefix(asked, "name", modules, "prefix", ["project"])
    seeds = exact.unionByName(under).select("project", "identity").distinct().withColumn("seed", F.lit(True))
    status = F.when(F.col("calm"), NEVER).when(F.col("bad") | F.coalesce("seed", F.lit(False)), KNOWN).otherwise(OPEN)
    return party.join(own, ["project", "identity"], "left").join(seeds, ["project", "identity"], "left").select(
        "project", F.col("identity").alias("id"), status.alias("status"), "kind", "is_async", F.lit(True).alias("is_first_party"),
        party_name(F.col("path"), F.col("qualified_name"), F.col("is_async")).alias("display"), "path", "line", "column", F.lit(False).alias("is_stub"),
    )


#: Kinds of facts, columns and kinds of references that ``own_nodes`` reads.
OWN = ("function", "class", "alias", "import"), "project path fact module is_stub name qualified_name enclosing kind target is_async decorators bases arguments start end line column", ("decorator",)


def own_nodes(facts: DataFrame, configs: Sequence[Config]) -> DataFrame | None:
    """The nodes of the project's own functions, from the facts that ``OWN`` names.

    None if a decorator may be a variable of one of the project's modules: what comes into it is told by flows, so ``build`` has to be asked.
    """
    by = resolve.lookup(facts, handed=False)
    asked = facts.filter("fact = 'reference'").select("project", "target").distinct()
    targets = written(resolve.located(by.resolved.join(asked, ["project", "target"], "left_semi"), by))
    modules = facts.filter("fact = 'function'").select("project", "module").distinct()
    unknown = targets.filter("identity is null").join(by.classes.select("project", F.col("class").alias("resolved")), ["project", "resolved"], "left_anti")
    within = unknown.select("project", F.explode(F.concat(F.array(F.lit("")), dotted_prefixes(F.col("resolved")))).alias("module")).distinct()
    if within.join(modules, ["project", "module"], "left_semi").limit(1).count():
        return None
    entries, prefixes = database(facts.sparkSession, configs)
    return _own(by.functions, annotations(facts, targets), entries, prefixes)


def build(facts: DataFrame, configs: Sequence[Config], edges: bool = True) -> CallGraph:
    """The call graph; without ``edges`` all nodes alone, and None for the edges."""
    spark = facts.sparkSession
    by = resolve.lookup(facts)
    functions = sized(by.functions)
    targets = written(resolve.located(by.resolved, by))
    # what values that flow through calls resolve joins the references that one file resolves
    if more := flow.opened(facts, targets, by):
        facts = facts.unionByName(written(more.references))
        targets = written(targets.unionByName(more.targets))
    targets = sized(targets)
    marks = sized(written(annotations(facts, targets)))
    entries, modules = database(spark, configs)
    stub_marks = marks.filter("is_stub").select("project", F.col("absolute").alias("name"), "annotation")
    calm = stub_marks.filter("annotation = 'non_blocking'").select("project", "name")
    stub_blocking = stub_marks.filter("annotation = 'blocking'").select("project", "name")
    first = _own(functions, marks, entries, modules)

    # external nodes: of the names a target may have, the first that blocks
    names = targets.filter("identity is null").select("project", "target", F.explode("names").alias("name"))
    bad = sized(cut(_matching(names.select("project", "name"), entries, modules, stub_blocking, calm)))
    exact = bad.join(entries.select("project", "name").unionByName(stub_blocking), ["project", "name"], "left_semi").withColumn("exact", F.lit(True))
    chosen = names.join(bad, ["project", "name"], "left_semi").groupBy("project", "target").agg(F.min("name").alias("external"))
    chosen = sized(cut(chosen.join(exact.withColumnRenamed("name", "external"), ["project", "external"], "left").select("project", "target", "external", F.coalesce("exact", F.lit(False)).alias("exact"))))
    # targets that are nodes
    ours = targets.filter("identity is not null").select("project", "target", F.col("identity").alias("dst"), F.lit(True).alias("ours"), F.lit(False).alias("exact"), F.col("how").alias("dst_kind"))
    ends = ours.unionByName(chosen.select("project", "target", F.col("external").alias("dst"), F.lit(False).alias("ours"), "exact", F.lit("Function").alias("dst_kind")))
    ends = sized(ends)
    stub_places = functions.filter("is_stub").select("project", F.col("absolute").alias("id"), "path", "line", "column")
    last = Window.partitionBy("project", "id").orderBy("path", "line")
    stub_places = stub_places.join(stub_blocking.withColumnRenamed("name", "id"), ["project", "id"], "left_semi").withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    outside = chosen.select("project", F.col("external").alias("id")).distinct().join(stub_places, ["project", "id"], "left").select(
        "project", "id", F.lit(KNOWN).alias("status"), F.lit("Function").alias("kind"), F.lit(False).alias("is_async"), F.lit(False).alias("is_first_party"), F.col("id").alias("display"), "path", "line", "column", F.col("path").isNotNull().alias("is_stub"),
    )
    nodes = first.unionByName(outside)
    if not edges:
        return CallGraph(functions, nodes, None, targets)
    nodes = sized(written(nodes))

    # references inside functions, whose identity their place tells
    place = ["project", "src", "start", "end", "path", "line", "column"]
    refs = facts.filter("fact = 'reference' and enclosing is not null and not is_stub and target is not null").withColumn("src", F.concat_ws(":", "path", "enclosing"))

    # executor wrappers: configured, annotated, built-in
    threads = [(c.root, "asyncio.to_thread", 0, None) for c in configs if c.python_version not in NO_THREADS]
    loops = [(c.root, "asyncio.AbstractEventLoop.run_in_executor", 1, None) for c in configs]
    fixed = spark.createDataFrame(threads + loops + [(c.root, *w) for c in configs for w in c.wrappers], "project string, wrapper string, position int, keyword string")
    marked = marks.filter("annotation = 'unblocker'").select("project", F.col("absolute").alias("wrapper"), "position", "keyword")
    wrappers = sized(cut(sets.upsert(fixed, marked.dropDuplicates(["project", "wrapper"]), ["project", "wrapper"])))
    called = targets.select("project", "target", F.explode(F.array_distinct(F.array_compact(F.concat("names", F.array("absolute", "resolved"))))).alias("wrapper"))
    called = sized(written(called.join(wrappers, ["project", "wrapper"])))
    wrapping = written(refs.filter("kind = 'call'").select(*place, "target", "arguments").join(called, ["project", "target"]))
    handing = wrapping.select(*place, "wrapper", F.explode(F.filter("arguments", lambda a: a["position"].eqNullSafe(F.col("position")) & F.col("position").isNotNull() | (a["keyword"] == F.col("keyword")))).alias("argument"))
    handing = sized(written(handing.select(*place, "wrapper", F.col("argument.target").alias("target"), F.col("argument.start").alias("r_start"), F.col("argument.end").alias("r_end"))))
    wrapped = wrapping.select("project", "src", "start", "end").distinct()

    # edges
    plain = refs.select(*place, "bare_column", "target", "expression", F.col("kind").alias("use")).join(ends, ["project", "target"])
    kind = F.when(F.col("use") == "implicit", "ImplicitDunder").when((F.col("use") == "attribute") & (F.col("dst_kind") != "Property"), F.lit(None).cast("string")).otherwise(edge_kind(F.col("dst_kind"), F.col("use") == "decorator", F.col("expression")))
    plain = plain.filter("ours or exact or use = 'call'").withColumn("edge_kind", kind).filter("edge_kind is not null")
    of = [*place, "bare_column", "dst", "edge_kind"]
    plain = plain.select(*of).join(wrapped, ["project", "src", "start", "end"], "left_anti")
    made = joins.contained(plain, handing, ["project", "src"], ("start", "end"), ("r_start", "r_end"))
    made = made.select(*of, F.col("inside").alias("protected"), F.lit(False).alias("in_executor"), F.lit(None).cast("string").alias("via"))
    given = handing.join(ends, ["project", "target"])
    handed = given.select(*place, F.lit(None).cast("int").alias("bare_column"), "dst", F.lit("DirectCall").alias("edge_kind"), F.lit(True).alias("protected"), F.lit(True).alias("in_executor"), F.col("wrapper").alias("via"))
    return CallGraph(functions, nodes, written(made.unionByName(handed).distinct()), targets)


def snapshot(graph: CallGraph) -> DataFrame:
    """(project, line): one line per node and edge, for comparing graphs."""
    n = graph.nodes.select("project", F.format_string("node %s %s %s%s", "id", "kind", "status", F.when(F.col("is_async"), " async").otherwise("")).alias("line"))
    e = graph.edges.select("project", F.format_string("edge %s -> %s %s%s%s", "src", "dst", "edge_kind", F.when(F.col("protected"), " protected").otherwise(""), F.coalesce(F.concat(F.lit(" via "), "via"), F.lit(""))).alias("line"))
    return n.unionByName(e)
