"""The whole analysis of one or many projects in one set of Spark jobs."""

from __future__ import annotations

import functools
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph, render, report
from ..operators.graph import condense, reachable, strongly_connected
from ..session import cut, ship
from ..sources import cache, files
from ..sources.config import Config, ConfigError, NoSources, load
from ..sources.facts import read_facts


@dataclass(frozen=True)
class Options:
    config: str | None = None
    intervention_strategy: str | None = None
    severity: str | None = None
    output_format: str | None = None
    python_version: str | None = None
    cache_enabled: bool | None = False
    clear_cache: bool = False
    first_party: tuple[str, ...] = ()  # taken for compatibility; has no effect
    max_chain_length: int | None = None
    max_paths_per_node: int | None = None


@dataclass
class Outcome:
    """Of each project an exit code; the tables hold all projects.

    ``graph`` and ``reasons`` are of the projects that were analysed anew; unchanged ones come whole from the cache.
    ``pieces`` and ``write`` make documents of any size on executors; ``reports`` brings them to the driver.
    """

    exit_codes: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)
    graph: callgraph.CallGraph | None = None
    reasons: DataFrame | None = None
    diagnostics: DataFrame | None = None
    warnings: DataFrame | None = None

    @functools.cached_property
    def reports(self) -> dict[str, dict]:
        """The report of each project that has one, in memory."""
        told: dict[str, list] = {root: [] for root in self.formats}
        warned: dict[str, list] = {root: [] for root in self.formats}
        if self.formats:
            for r in report.ordered(self.diagnostics).toLocalIterator():
                told[r["project"]].append(r.asDict(recursive=True))
            for r in report.ordered_warnings(self.warnings).toLocalIterator():
                warned[r["project"]].append(r.asDict())
        return {root: render.report(told[root], warned[root]) for root in self.formats}

    def pieces(self, kind: str, together: bool = False) -> DataFrame:
        """(document, section, place, text) of each project's report, or of one of all projects in the order of their paths."""
        rows = [(root, "" if together else root, i if together else 0) for i, root in enumerate(self.formats)]
        documents = self.diagnostics.sparkSession.createDataFrame(rows, "project string, document string, position int")
        return render.pieces(self.diagnostics, self.warnings, documents, kind)

    def write(self, kind: str, where: str) -> None:
        render.write(self.pieces(kind), where)

    def statuses(self) -> DataFrame:
        """Nodes with their statuses after propagation."""
        return reachable(self.graph.nodes, self.graph.edges, ["project"])

    def ranked(self) -> DataFrame:
        """The distinct reasons of each node with their rank: by chain length, root and chain."""
        return report.ranked(self.reasons)

    def shortest(self) -> DataFrame:
        """The first reason of each node, in work linear in the edges."""
        return report.shortest(self.graph)

    def components(self) -> DataFrame:
        return strongly_connected(self.graph.nodes, self.graph.edges, ["project"])

    def condensed(self) -> DataFrame:
        return condense(self.graph.edges, self.components(), ["project"])

    @property
    def exit_code(self) -> int:
        return max(self.exit_codes.values(), default=0)


def analyze_facts(facts: DataFrame, configs: Sequence[Config], options: Options = Options()) -> Outcome:  # noqa: B008
    out = Outcome()
    out.graph = callgraph.build(facts, configs)
    out.reasons = report.reasons(out.graph, options.max_chain_length, options.max_paths_per_node)
    out.diagnostics = cut(report.diagnostics(out.graph, out.reasons, configs))
    out.warnings = report.warnings(facts, out.graph, configs)
    if options.max_chain_length is not None or options.max_paths_per_node is not None:
        spark = facts.sparkSession
        note = "blocking paths are bounded by max_chain_length or max_paths_per_node; some may be missing"
        out.warnings = out.warnings.unionByName(spark.createDataFrame([(c.root, None, note) for c in configs], "project string, file string, message string"))
    return out


def analyze(spark: SparkSession, paths: Sequence[str], options: Options = Options()) -> Outcome:  # noqa: B008
    """Analyses every path as a project of its own, all in the same jobs."""
    ship(spark)
    out, configs = Outcome(), []
    over = {k: getattr(options, k) for k in ("intervention_strategy", "severity", "output_format", "python_version", "cache_enabled")}
    for path in paths:
        root = os.path.abspath(path)
        try:
            configs.append(load(root, options.config, **over))
        except ConfigError as error:
            out.exit_codes[root], out.errors[root] = error.exit_code, str(error)
    if not configs:
        return out
    if options.clear_cache:
        for c in configs:
            cache.clear(c.cache_dir)
    # names and hashes are kept; contents are read again where a file must be parsed
    found = cut(files.read(spark, configs).drop("content"))
    digest = {r["project"]: r["digest"] for r in cache.digests(found).filter("sourced").collect()}
    for c in [c for c in configs if c.root not in digest]:
        out.exit_codes[c.root], out.errors[c.root] = NoSources.exit_code, "No analyzable source files"
    configs = [c for c in configs if c.root in digest]
    versions = {c.root: cache.version(digest[c.root], c, options.max_chain_length, options.max_paths_per_node) for c in configs}
    held = {c.root: r for c in configs if c.cache_enabled and (r := cache.results(spark, c.cache_dir, versions[c.root]))}
    fresh = [c for c in configs if c.root not in held]
    done = Outcome()
    if fresh:
        cached = [c for c in fresh if c.cache_enabled]
        parts = [cache.facts(found.filter(F.col("project") == c.root), c.cache_dir) for c in cached]
        plain = [c.root for c in fresh if not c.cache_enabled]
        if plain:
            parts.append(read_facts(files.contents(found.filter(F.col("project").isin(plain)))))
        facts = cut(functools.reduce(DataFrame.unionByName, parts))
        done = analyze_facts(facts, fresh, options)
        for c in cached:
            of = lambda frame, root=c.root: frame.filter(F.col("project") == root)
            cache.store(c.cache_dir, versions[c.root], of(found), of(facts), of(done.diagnostics), of(done.warnings))
    for diagnosed, warned in held.values():
        done.diagnostics = done.diagnostics.unionByName(diagnosed) if done.diagnostics else diagnosed
        done.warnings = done.warnings.unionByName(warned) if done.warnings else warned
    done.exit_codes, done.errors = out.exit_codes, out.errors
    if not configs:
        return done
    projects = spark.createDataFrame([(c.root,) for c in configs], "project string")
    done.exit_codes |= {r["project"]: r["exit_code"] for r in render.exit_codes(done.diagnostics, projects).collect()}  # one row per path
    done.formats = {c.root: c.output_format for c in configs}
    return done
