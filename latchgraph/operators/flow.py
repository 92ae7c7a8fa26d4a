"""Which objects and functions come into variables: inclusion constraints, closed together with the calls they open.

``sources.facts`` writes down what flows where inside functions (see there for the names of variables).  Here arguments flow into
parameters of the functions that are called, results back to their calls, and attributes of objects into what is read
from them.  A reference to a variable is a call of whatever has come into it, which opens new flows into the
parameters of that function; so both grow together until nothing is new.

Semi-naive: a round joins what is new of the contents with all edges, and what is new of the edges with all contents, and looks up the members of
new objects only.  Where nothing flows that a reference could use, no round is run.

A variable holds what any caller hands over: calls are not told apart by their callers.

Variables into which something may come are numbered once, and edges are pairs of numbers; one from a variable into which nothing can come is
left out.  What a variable holds is kept as bits: things are numbered as they turn up, 64 of them make a block, and a row has a variable, a
block and its bits.  So a step moves a row along an edge for 64 things, and rows that come to one variable are merged before they are shuffled.

Contents of variables are (kind, what): ``object`` of a class, ``class``, ``function`` or ``name`` (something from outside).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import qualify
from ..session import written
from .resolve import Lookup, located
from .windows import dense_ids

FEW, STEPS = 50_000, 3  # steps along edges in one plan, from this many rows or fewer
BITS = 64
_THING = ["project", "kind", "what"]


class Opened(NamedTuple):
    references: DataFrame  # rows of the facts with their target filled in
    targets: DataFrame  # what these targets stand for, as ``resolve.located`` says


class Numbers(NamedTuple):
    """The numbers of variables (project, variable, id) and of things (project, kind, what, block, bit); whether elements are among the variables."""

    variables: DataFrame
    elements: bool
    things: DataFrame | None = None
    blocks: int = 0


def _empty(frame: DataFrame) -> bool:
    return not frame.limit(1).count()


def _things(targets: DataFrame, by: Lookup) -> DataFrame:
    """(project, target, kind, what, how, owner) of every name: a function, a class, or a name from outside."""
    known = targets.join(by.classes.select("project", F.col("class").alias("resolved"), F.lit(True).alias("is_class")), ["project", "resolved"], "left")
    kind = F.when(F.col("absolute").isNotNull(), "function").when(F.col("is_class"), "class").otherwise("name")
    return known.select("project", "target", kind.alias("kind"), F.coalesce("absolute", "resolved").alias("what"), "how", "owner")


def _variables(facts: DataFrame) -> tuple[DataFrame, bool]:
    """(project, variable), more than once: all variables into which something may come; and whether elements of variables are among them.

    They are if something may come into elements at all, and not just from the elements of another variable.
    """
    told = facts.filter("fact in ('flow', 'parameter', 'load', 'result')")
    inner = told.filter("startswith(name, 'E|') and (fact = 'parameter' or (fact = 'flow' and (kind != 'var' or not startswith(receiver, 'E|'))))")
    if _empty(inner):
        return told.filter("not startswith(name, 'E|')").select("project", F.col("name").alias("variable")), False
    return told.select("project", F.explode(F.array("name", F.concat(F.lit("E|"), "name"))).alias("variable")), True


def _edges(pairs: DataFrame, numbers: Numbers) -> DataFrame:
    """(id, source) of pairs (project, variable, source)."""
    from_ = numbers.variables.select("project", F.col("variable").alias("source"), F.col("id").alias("__source"))
    return pairs.join(from_, ["project", "source"]).join(numbers.variables, ["project", "variable"]).select("id", F.col("__source").alias("source")).distinct()


def _constraints(values: DataFrame, things: DataFrame, numbers: Numbers) -> tuple[DataFrame, DataFrame]:
    """Edges (id, source) and contents (id, project, kind, what) of values that flow into variables.

    ``values`` has project, variable, holds (``var``, ``made``, ``named``) and value.
    """
    between = values.filter("holds = 'var'").select("project", "variable", F.col("value").alias("source"))
    told = values.filter("holds != 'var'").withColumnRenamed("value", "target").distinct().join(things, ["project", "target"])
    # the result of a function is what it returns; a name from outside this file may be a variable of another module
    by_result = "kind = 'function' and (holds = 'made' or how = 'Property')"
    from_function = told.filter(by_result).select("project", "variable", F.concat(F.lit("R|"), "what").alias("source"))
    both = between.unionByName(from_function)
    if numbers.elements:
        both = both.unionByName(both.select("project", F.concat(F.lit("E|"), "variable").alias("variable"), F.concat(F.lit("E|"), "source").alias("source")))
    from_module = told.filter("holds = 'named' and kind = 'name'").select("project", "variable", F.concat(F.lit("V|"), "what").alias("source"))
    edges = _edges(both.unionByName(from_module), numbers)
    made = told.filter("holds = 'made' and kind != 'function' and not startswith(what, 'builtins.')").withColumn("kind", F.lit("object"))
    told = told.filter(f"holds = 'named' and not ({by_result})").unionByName(made)
    return edges, told.join(numbers.variables, ["project", "variable"]).select("id", *_THING).distinct()


def _taking(things: DataFrame, parameters: DataFrame, by: Lookup) -> DataFrame:
    """(project, target, unbound, takes) of names that can be called: their parameters, those of a class by its constructor.

    ``parameters`` has project, absolute and takes; a method called on its class (``unbound``) gets its object by hand.
    """
    unbound = F.col("owner").isNotNull() & ~F.col("how").isin("StaticMethod", "ClassMethod")
    by_name = things.filter("kind = 'function'").select("project", "target", F.col("what").alias("absolute"), unbound.alias("unbound"))
    classes = things.filter("kind = 'class'").select("project", "target", F.col("what").alias("class"))
    built = _members(classes.select("project", "class", F.lit("__init__").alias("member")).distinct(), by)
    by_class = classes.join(built.select("project", "class", "absolute"), ["project", "class"]).select("project", "target", "absolute", F.lit(False).alias("unbound"))
    return by_name.unionByName(by_class).join(parameters, ["project", "absolute"]).select("project", "target", "unbound", "takes")


def _handed() -> Column:
    """What a call's arguments hand over, of those of which something is known."""
    return F.transform(F.filter("arguments", lambda a: a["value"].isNotNull()), lambda a: F.struct(*[a[n].alias(n) for n in ("position", "keyword", "holds", "value")])).alias("arguments")


def _given(calls: DataFrame, taking: DataFrame) -> DataFrame:
    """What calls (project, target, level, arguments) hand to parameters: (project, variable, holds, value).  Level 1 is a call on an object."""
    fits = lambda a, p: (a["position"] == p["level"]) | (a["keyword"] == p["parameter"]) | ((p["level"] < 0) & (a["position"] >= -1 - p["level"]))
    a = calls.join(taking, ["project", "target"]).filter("not unbound or level != 0").select("project", "takes", F.explode("arguments").alias("a"))
    return a.select("project", "a", F.explode(F.filter("takes", lambda p: fits(F.col("a"), p))).alias("p")).select("project", "p.variable", "a.holds", "a.value")


def _open_names(targets: DataFrame, things: DataFrame) -> DataFrame:
    """(project, target, receiver, member) of names that may be members of results of functions, of variables of other modules and of
    attributes: main.make.data, other.thing.data."""
    names = targets.filter("identity is null").select("project", "target", "resolved").join(things.filter("kind = 'name'").select("project", "target"), ["project", "target"], "left_semi")
    base = F.regexp_extract("resolved", r"^(.*)\.[^.]*$", 1)
    last = F.substring_index("resolved", ".", -1)
    places = F.array(F.struct(F.concat(F.lit("R|"), base).alias("r"), last.alias("m")), F.struct(F.concat(F.lit("V|"), base).alias("r"), last.alias("m")), F.struct(F.concat(F.lit("V|"), "resolved").alias("r"), F.lit(None).cast("string").alias("m")))
    names = names.select("project", "target", F.explode(places).alias("p")).select("project", "target", F.col("p.r").alias("receiver"), F.col("p.m").alias("member"))
    return names.filter("receiver not in ('R|', 'V|')")


def opened(facts: DataFrame, targets: DataFrame, by: Lookup) -> Opened | None:
    """References that flows resolve; None if there are none."""
    things = written(_things(targets, by))
    # references whose target is not known, by the variable that tells
    references = facts.filter("fact = 'reference' and enclosing is not null and not is_stub")
    open_names = _open_names(targets, things)
    asked = references.filter("receiver is not null").select("project", "receiver", F.col("name").alias("member")).distinct()
    asked = written(asked.withColumn("target", F.lit(None).cast("string")).unionByName(open_names))
    variables, elements = _variables(facts)
    asking = asked.join(variables.withColumnRenamed("variable", "receiver").distinct(), ["project", "receiver"])
    asking = written(asking)
    if _empty(asking):
        return None

    numbers = Numbers(written(variables.distinct().withColumn("id", F.monotonically_increasing_id())), elements)
    numbered = lambda frame, name="receiver": frame.join(numbers.variables.withColumnRenamed("variable", name), ["project", name])
    flows = facts.filter("fact = 'flow'").select("project", F.col("name").alias("variable"), F.col("kind").alias("holds"), F.coalesce("target", "receiver").alias("value"))
    absolute = qualify(F.nullif(F.col("module"), F.lit("")), F.col("enclosing"))
    takes = F.collect_set(F.struct("level", F.col("expression").alias("parameter"), F.col("name").alias("variable"))).alias("takes")
    parameters = written(facts.filter("fact = 'parameter'").groupBy("project", absolute.alias("absolute")).agg(takes))
    # calls whose function is known
    calls = facts.filter("fact = 'reference' and arguments is not null and target is not null and kind in ('call', 'implicit')").select("project", "target", "level", _handed()).filter("size(arguments) > 0")
    taking = _taking(things, parameters, by)
    edges, contents = _constraints(written(flows.unionByName(_given(calls, taking))), things, numbers)
    contents = written(contents)
    if _empty(contents):
        return None
    edges = written(edges)
    loads = written(numbered(facts.filter("fact = 'load'").select("project", "receiver", F.col("expression").alias("member"), F.col("name").alias("variable")).distinct()))
    results = written(numbered(facts.filter("fact = 'result'").select("project", "receiver", F.col("name").alias("variable")).distinct()))
    questions = written(numbered(asking.select("project", "receiver", "member").distinct()))
    uses = references.filter("receiver is not null").withColumn("member", F.col("name"))
    plain = references.filter("target is not null").drop("receiver").join(asking.filter("target is not null").select("project", "target", "receiver", "member").distinct(), ["project", "target"])
    uses = uses.unionByName(plain)
    handing = written(uses.filter("arguments is not null").select("project", "receiver", "member", _handed()).filter("size(arguments) > 0"))
    hands = not _empty(handing)

    found = state = caught = None
    while True:
        numbers, come = _bits(contents, numbers)
        state = spread(edges, _merged(state, come if caught is None else come.unionByName(caught)))
        at = _decoded(state, numbers)
        meant = written(_meant(questions, at))
        found = meant if found is None else found.unionByName(meant)
        # attributes that are read: methods, properties' results, and what was put into them in the class or an ancestor
        read = loads.join(at.filter("kind = 'object'").select("id", F.col("what").alias("class")), "id").select("project", "variable", "class", "member").distinct()
        # results of calling what came in
        called = results.join(at.drop("project"), "id").select("project", "variable", "kind", "what")
        nothing = F.lit(None).cast("string")
        news = written(read.select("project", "variable", F.lit("read").alias("kind"), "class", "member").unionByName(called.select("project", "variable", "kind", F.col("what").alias("class"), nothing.alias("member"))))
        # arguments of the calls that these references are
        same = (handing["project"] == meant["project"]) & (handing["receiver"] == meant["receiver"]) & handing["member"].eqNullSafe(meant["member"])
        calls = written(handing.join(meant, same).select(handing["project"], F.col("meant").alias("target"), F.lit(1).alias("level"), "arguments")) if hands else None
        if _empty(news) and (calls is None or _empty(calls)):
            break
        read, called = news.filter("kind = 'read'"), news.filter("kind != 'read'").withColumnRenamed("class", "what")
        names = read.select("project", F.concat_ws(".", "class", "member").alias("target"))
        if calls is not None:
            names = names.unionByName(calls.select("project", "target"))
        names = names.distinct().withColumn("resolved", F.col("target"))
        where = written(_things(located(names, by), by).filter("kind = 'function'"))
        got = read.withColumn("target", F.concat_ws(".", "class", "member")).join(where.select("project", "target", "what", "how"), ["project", "target"])
        new_contents = got.filter("how != 'Property'").select("project", "variable", F.lit("function").alias("kind"), "what")
        new_contents = new_contents.unionByName(called.filter("kind = 'class'").select("project", "variable", F.lit("object").alias("kind"), "what"))
        pairs = got.filter("how = 'Property'").select("project", "variable", F.concat(F.lit("R|"), "what").alias("source"))
        put = read.join(by.lines.select("project", "class", "ancestor"), ["project", "class"])
        pairs = pairs.unionByName(put.select("project", "variable", F.concat(F.lit("V|"), F.concat_ws(".", "ancestor", "member")).alias("source")))
        for e in ("", "E|"):
            pairs = pairs.unionByName(called.filter("kind = 'function'").select("project", F.concat(F.lit(e), "variable").alias("variable"), F.concat(F.lit(f"{e}R|"), "what").alias("source")))
        new_edges, contents = _edges(pairs, numbers), numbered(new_contents, "variable").select("id", *_THING)
        if calls is not None:
            more_edges, more_contents = _constraints(_given(calls, _taking(where, parameters, by)), things, numbers)
            new_edges, contents = new_edges.unionByName(more_edges).distinct(), contents.unionByName(more_contents)
        fresh = written(new_edges.join(edges, ["id", "source"], "left_anti"))
        contents = written(contents.distinct())
        caught = None
        if not _empty(fresh):
            # what the sources of new edges hold already; what comes in later goes along all edges
            caught = _moved(fresh, state.select("id", "block", "mask"))
            edges = written(edges.unionByName(fresh))
        state = state.select("id", "block", "mask", F.lit(0).cast("long").alias("since"))
    if _empty(found):
        return None
    found = written(found.distinct())
    rows = uses.drop("target").join(found.withColumnRenamed("meant", "target"), (uses["project"] == found["project"]) & (uses["receiver"] == found["receiver"]) & uses["member"].eqNullSafe(found["member"]))
    rows = rows.select(*[uses[c] if c != "target" else F.col("target") for c in facts.columns])
    names = found.select("project", F.col("meant").alias("target")).distinct().join(targets.select("project", "target"), ["project", "target"], "left_anti")
    return Opened(rows, located(names.withColumn("resolved", F.col("target")), by))


def _bits(contents: DataFrame, numbers: Numbers) -> tuple[Numbers, DataFrame]:
    """Contents (id, project, kind, what) as bits (id, block, mask); things that have no number yet get one."""
    new = contents.select(_THING).distinct()
    if numbers.things is not None:
        new = new.join(numbers.things, _THING, "left_anti")
    new = dense_ids(new, _THING, "n")
    new = written(new.select(*_THING, (numbers.blocks + F.floor(F.col("n") / BITS)).cast("int").alias("block"), (F.col("n") % BITS).cast("int").alias("bit")))
    blocks = max(numbers.blocks, (new.agg(F.max("block")).first()[0] or 0) + 1)
    known = new if numbers.things is None else numbers.things.unionByName(new)
    return numbers._replace(things=known, blocks=blocks), contents.join(known, _THING).groupBy("id", "block").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))


def _decoded(state: DataFrame, numbers: Numbers) -> DataFrame:
    """(id, project, kind, what) of what is new since the last call of ``spread``."""
    bits = F.expr(f"filter(sequence(0, {BITS - 1}), i -> (shiftrightunsigned(since, i) & 1) = 1)")
    return state.filter("since != 0").select("id", "block", F.explode(bits).alias("bit")).join(numbers.things, ["block", "bit"]).select("id", *_THING)


def _moved(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (id, block, mask) moved one step along edges, merged by variable and block."""
    return edges.join(rows.withColumnRenamed("id", "source"), "source").groupBy("id", "block").agg(F.bit_or("mask").alias("mask"))


def _merged(state: DataFrame | None, come: DataFrame) -> DataFrame:
    """The state after rows (id, block, mask) have come in.

    A state has for each variable and block all bits (``mask``), those since the last rest (``since``) and those that came just now (``fresh``).
    """
    none = F.lit(0).cast("long")
    rows = come.select("id", "block", none.alias("mask"), none.alias("since"), F.col("mask").alias("come"))
    if state is not None:
        rows = rows.unionByName(state.select("id", "block", "mask", "since", none.alias("come")))
    rows = rows.groupBy("id", "block").agg(*[F.bit_or(c).alias(c) for c in ("mask", "since", "come")])
    fresh = F.col("come").bitwiseAND(F.bitwise_not("mask"))
    return rows.select("id", "block", F.col("mask").bitwiseOR(F.col("come")).alias("mask"), F.col("since").bitwiseOR(fresh).alias("since"), fresh.alias("fresh"))


def spread(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Moves what is fresh in a state along edges to the end."""
    while True:
        state = written(state)
        moving = state.filter("fresh != 0").select("id", "block", F.col("fresh").alias("mask"))
        n = moving.limit(FEW + 1).count()
        if not n:
            return state
        come = step = _moved(edges, moving)
        # where little moves, some steps in one plan
        for _ in range(STEPS - 1 if n <= FEW else 0):
            step = _moved(edges, step)
            come = come.unionByName(step)
        state = _merged(state, come)


def _meant(asking: DataFrame, at: DataFrame) -> DataFrame:
    """What references mean: members of objects (calling one is its __call__), functions, names from outside."""
    joined = asking.join(at.drop("project"), "id")
    meant = F.when(F.col("kind") == "object", F.concat_ws(".", "what", F.coalesce("member", F.lit("__call__"))))
    meant = meant.when(F.col("member").isNull(), F.when(F.col("kind") == "class", F.concat("what", F.lit(".__init__"))).otherwise(F.col("what")))
    meant = meant.when(F.col("kind") != "function", F.concat_ws(".", "what", "member"))
    return joined.select("project", "receiver", "member", meant.alias("meant")).filter("meant is not null").distinct()


def _members(asked: DataFrame, by: Lookup) -> DataFrame:
    """(project, class, member, absolute): the function that a member of a class is."""
    names = asked.withColumn("target", F.concat_ws(".", "class", "member")).withColumn("resolved", F.col("target"))
    return located(names.select("project", "target", "resolved"), by).filter("absolute is not null").select("project", "target", "absolute").join(names.select("project", "target", "class", "member"), ["project", "target"]).select("project", "class", "member", "absolute")
