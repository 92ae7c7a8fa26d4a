"""Resolution of references across files: alias closure, class ancestry, member lookup."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import callable_kind, dotted_prefixes, qualify
from ..session import cut, written


def _dotted(module, name):
    return qualify(F.nullif(module, F.lit("")), name)


def functions(facts: DataFrame) -> DataFrame:
    """One row per function: identity (path:qualified name), absolute name, kind."""
    rows = facts.filter("fact = 'function'").select(
        "project", "path", "module", "is_stub", "name", "qualified_name", "is_async", "decorators", "start", "end", "line", "column",
        F.concat_ws(":", "path", "qualified_name").alias("identity"),
        _dotted(F.col("module"), F.col("qualified_name")).alias("absolute"),
        F.when(F.col("enclosing").isNotNull(), _dotted(F.col("module"), F.col("enclosing"))).alias("owner"),
    )
    first = Window.partitionBy("project", "identity").orderBy("start")
    rows = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return rows.withColumn("kind", callable_kind(F.col("name"), F.col("qualified_name"), F.col("is_async"), F.col("decorators")))


def aliases(facts: DataFrame) -> DataFrame:
    """(project, name, target): module-level imports, star imports spelled out over what the other module has."""
    direct = facts.filter("fact = 'alias'").select("project", "name", "target").filter("name != target")
    stars = facts.filter("fact = 'import' and kind = 'name' and name = '*'").select("project", "module", F.col("target").alias("base")).distinct()
    symbols = facts.filter("fact in ('function', 'class') and instr(qualified_name, '.') = 0").select("project", F.col("module").alias("base"), "name")
    one = Window.partitionBy("project", "name").orderBy(F.desc("target"))
    single = lambda rows: rows.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n")
    made = single(direct)
    if stars.limit(1).count():
        # round by round outwards from definitions: what a module defines or imports by name comes before a star
        # import, and a name once spelled out keeps its nearest source, so star imports in a circle end
        stars, symbols, made = cut(stars), cut(symbols), cut(made)
        owned = cut(symbols.select("project", _dotted(F.col("base"), F.col("name")).alias("name")).distinct())
        fresh = symbols.unionByName(_members(made))
        while True:
            public = fresh.filter(~F.col("name").startswith("_")).distinct()
            spelled = stars.join(public, ["project", "base"]).select("project", _dotted(F.col("module"), F.col("name")).alias("name"), _dotted(F.col("base"), F.col("name")).alias("target")).filter("name != target")
            new = cut(single(spelled.join(owned, ["project", "name"], "left_anti").join(made, ["project", "name"], "left_anti")))
            if not new.limit(1).count():
                break
            made, fresh = cut(made.unionByName(new)), _members(new)
    return made


def _members(links: DataFrame) -> DataFrame:
    """(project, base, name) of aliases by the module that has them."""
    return links.select("project", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("base"), F.substring_index("name", ".", -1).alias("name"))


def closure(names: DataFrame, links: DataFrame) -> DataFrame:
    """(project, target, resolved): the longest aliased prefix of each name is replaced until none is left.

    A link is used once on the way of a name, so cycles end; one that leads below its own name (a package that
    imports a function of a module named alike) is meant for that name alone.
    """
    grows = F.startswith("target", F.concat("name", F.lit(".")))
    links = written(links.select("project", F.col("name").alias("__prefix"), F.col("target").alias("__to"), grows.alias("__grows")))
    done = None
    start = names.select("project", "target").distinct()
    left = written(start.withColumns({"resolved": F.col("target"), "__used": F.array().cast("array<string>")}))
    while True:
        exploded = left.withColumn("__prefix", F.explode(dotted_prefixes(F.col("resolved")))).join(links, ["project", "__prefix"])
        exploded = exploded.filter("not array_contains(__used, __prefix) and (not __grows or __prefix = resolved)")
        best = exploded.groupBy("project", "target").agg(F.max(F.struct(F.length("__prefix").alias("n"), F.col("__to").alias("to"), F.col("__prefix").alias("by"))).alias("b"))
        step = left.join(best, ["project", "target"], "left")
        moved = F.concat(F.col("b.to"), F.substr(F.col("resolved"), F.col("b.n") + 1))
        step = written(step.select("project", "target", F.coalesce(moved, "resolved").alias("resolved"), F.when(F.col("b").isNotNull(), F.array_append("__used", F.col("b.by"))).alias("__used")))
        settled = step.filter("__used is null").drop("__used")
        done = settled if done is None else done.unionByName(settled)
        left = step.filter("__used is not null")
        if not left.limit(1).count():
            return done


def ancestry(classes: DataFrame) -> DataFrame:
    """(project, class, ancestor, rank): a class and its bases, nearest and leftmost first.

    ``classes`` has project, class and bases (resolved).
    """
    parents = written(classes.select("project", "class", F.posexplode("bases").alias("p", "base")))
    found = delta = written(classes.select("project", "class", F.col("class").alias("ancestor"), F.array(F.lit(0)).alias("rank")))
    while True:
        step = delta.join(parents.select("project", F.col("class").alias("ancestor"), "p", "base"), ["project", "ancestor"])
        step = step.select("project", "class", F.col("base").alias("ancestor"), F.concat(F.array(F.size("rank")), F.slice("rank", F.lit(2), F.size("rank")), F.array("p")).alias("rank"))
        delta = written(step.join(found, ["project", "class", "ancestor"], "left_anti"))
        if not delta.limit(1).count():
            break
        found = found.unionByName(delta)
    return found.groupBy("project", "class", "ancestor").agg(F.min("rank").alias("rank"))


def ordered_syntax(facts: DataFrame) -> DataFrame:
    """The facts of every file in order: functions and classes by qualified name, imports by module, name and alias,
    references by place and text."""
    rank = F.when(F.col("fact").isin("function", "class"), 0).when(F.col("fact") == "import", 1).otherwise(2)
    named = F.when(rank == 0, F.col("qualified_name")).when(rank == 1, F.col("target"))
    keys = [rank, named, F.when(rank == 1, F.col("name")), F.when(rank == 1, F.col("expression")), "start", "end", "expression", "kind", "target"]
    place = F.row_number().over(Window.partitionBy("project", "path").orderBy(*keys))
    return facts.withColumn("ordinal", place - 1)


def decorators(facts: DataFrame) -> DataFrame:
    """(project, identity, decorators): the distinct decorator texts of each function, sorted."""
    used = facts.filter("fact = 'function'").select("project", F.concat_ws(":", "path", "qualified_name").alias("identity"), F.explode("decorators").alias("d"))
    return used.groupBy("project", "identity").agg(F.array_sort(F.collect_set("d")).alias("decorators"))


class Lookup(NamedTuple):
    """What names are resolved with."""

    functions: DataFrame
    resolved: DataFrame  # project, target, resolved: names of the facts, aliases followed
    classes: DataFrame  # project, class, bases, is_stub
    lines: DataFrame  # project, class, ancestor, rank
    index: DataFrame  # project, absolute, identity, is_stub, owner, name, kind: one definition of each absolute name


def lookup(facts: DataFrame, handed: bool = True) -> Lookup:
    """Without ``handed`` the names that references and bases have are resolved, and not those that calls and flows hand over."""
    defined = written(functions(facts))
    references = facts.filter("fact = 'reference'")
    names = references.filter("target is not null").select("project", "target")
    names = names.unionByName(facts.filter("fact = 'class'").select("project", F.explode("bases").alias("target")))
    if handed:
        given = references.filter("arguments is not null").select("project", F.explode("arguments").alias("a"))
        given = given.select("project", F.explode(F.array_distinct(F.array_compact(F.array("a.target", F.when(F.col("a.holds") != "var", F.col("a.value")))))).alias("target"))
        names = names.unionByName(given).unionByName(facts.filter("fact = 'flow' and target is not null").select("project", "target"))
    links = aliases(facts)
    resolved = closure(names, links)
    classes = facts.filter("fact = 'class'").select("project", _dotted(F.col("module"), F.col("qualified_name")).alias("class"), "bases", "is_stub")
    one = Window.partitionBy("project", "class").orderBy("is_stub")
    classes = written(classes.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n"))
    known = resolved.select("project", F.col("target").alias("base"), F.col("resolved").alias("to"))
    spelled = classes.select("project", "class", F.posexplode_outer("bases").alias("p", "base")).join(known, ["project", "base"], "left")
    based = spelled.groupBy("project", "class").agg(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", F.coalesce("to", "base").alias("b"))))).alias("l"))
    lines = written(ancestry(based.select("project", "class", F.transform("l", lambda x: x["b"]).alias("bases"))))
    # a source definition comes before a stub's, the first in order of qualified name, path and place before others
    order = Window.partitionBy("project", "absolute").orderBy("is_stub", "qualified_name", "path", "start")
    index = written(defined.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("project", "absolute", "identity", "is_stub", "owner", "name", "kind"))
    return Lookup(defined, resolved, classes, lines, index)


def located(names: DataFrame, by: Lookup) -> DataFrame:
    """(project, target, resolved, identity, absolute, how, owner, names) of ``names`` (project, target, resolved): what each stands for.

    ``identity`` is a first-party function's, with its absolute name, kind (``how``) and class (``owner``); otherwise ``names`` holds the external
    names that may match.
    """
    direct = by.index.select("project", F.col("absolute").alias("resolved"), "identity", "is_stub", "absolute", F.col("kind").alias("how"), "owner")
    # member lookup: the nearest ancestor that has it; super() starts behind the class itself
    asked = names.select("project", "resolved").distinct().withColumn("__base", F.regexp_extract("resolved", r"^(.*)\.[^.]*$", 1)).withColumn("__member", F.substring_index("resolved", ".", -1))
    asked = asked.withColumn("__above", F.col("__base").endswith(".super()")).withColumn("class", F.regexp_replace("__base", r"\.super\(\)$", ""))
    near = asked.join(by.lines, ["project", "class"]).filter("not (__above and ancestor = class)")
    members = by.index.filter("owner is not null").select("project", F.col("owner").alias("ancestor"), F.col("name").alias("__member"), "identity", "is_stub", "absolute", F.col("kind").alias("how"), "owner")
    by_class = near.join(members, ["project", "ancestor", "__member"]).groupBy("project", "resolved").agg(F.min(F.struct("rank", "identity", "is_stub", "absolute", "how", "owner")).alias("m")).select("project", "resolved", "m.identity", "m.is_stub", "m.absolute", "m.how", "m.owner")
    outside = near.join(by.classes.select("project", F.col("class").alias("ancestor")), ["project", "ancestor"], "left_anti")
    outside = outside.groupBy("project", "resolved").agg(F.collect_set(F.concat_ws(".", "ancestor", "__member")).alias("above"))
    found = direct.unionByName(by_class)
    first = Window.partitionBy("project", "resolved").orderBy("is_stub", "identity")
    found = found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    out = names.join(found, ["project", "resolved"], "left").join(outside, ["project", "resolved"], "left")
    source = F.col("identity").isNotNull() & ~F.col("is_stub")
    every = F.when(source, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(F.array(F.coalesce("absolute", "resolved")), F.coalesce("above", F.array().cast("array<string>"))))))
    ours = [F.when(source, F.col(c)).alias(c) for c in ("identity", "absolute", "how", "owner")]
    return out.select("project", "target", "resolved", *ours, every.alias("names"))


def targets(facts: DataFrame) -> DataFrame:
    """What every referenced name stands for (see ``located``)."""
    by = lookup(facts)
    return located(by.resolved, by)
