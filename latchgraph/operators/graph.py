"""Graph operators: blocking paths, reachability, strongly connected components, condensation.

Iterative operators run as DataFrame loops; every round is cut to the shared checkpoint folder, so a
lost executor costs one round at most.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written
from .windows import dense_ids

FEW, STEPS = 50_000, 4
KNOWN, NEVER, SPREAD, OPEN = "KnownBlocking", "KnownNonBlocking", "PropagatedBlocking", "Unknown"


def _empty(frame: DataFrame) -> bool:
    return not frame.limit(1).count()


def simple_paths(nodes: DataFrame, edges: DataFrame, link: Column, name: Column, keys: list[str] | None = None, max_length: int | None = None, max_paths: int | None = None) -> DataFrame:
    """All blocking paths: (keys.., node, root, chain), seeds with empty chains included.

    ``nodes``: keys, id, status.  ``edges``: keys, src, dst, protected and what ``link`` (a struct with a
    field ``function_name``) reads.  ``name`` is the caller's function_name over ``edges``.  A path takes
    an unprotected edge u -> v in front of a path of v unless u stands in that path's chain already or
    must never block.  The root has no link, so it may be entered once more.

    Semi-naive: each round joins only the longest paths found so far, ``STEPS`` steps at once where the edges are few
    enough to be broadcast.  ``max_length`` and
    ``max_paths`` (per node and round) bound the work where a graph has too many paths; by default there is
    no bound.
    """
    keys = keys or []
    never = nodes.filter(F.col("status") == NEVER).select(*keys, F.col("id").alias("src"))
    usable = written(edges.filter(~F.col("protected")).join(never, [*keys, "src"], "left_anti").select(*keys, "src", F.col("dst").alias("node"), link.alias("__link"), name.alias("__name")).distinct())
    few = usable.limit(FEW + 1).count() <= FEW
    usable = F.broadcast(usable) if few else usable
    kind = usable.select(F.array("__link").alias("chain")).schema["chain"].dataType
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def longer(paths: DataFrame) -> DataFrame:
        step = usable.join(paths, [*keys, "node"]).filter(~F.exists("chain", lambda x: x["function_name"] == F.col("__name")))
        return step.select(*keys, F.col("src").alias("node"), "root", F.concat(F.array("__link"), F.col("chain")).alias("chain"))

    found = delta = cut(nodes.filter(F.col("status") == KNOWN).select(*keys, F.col("id").alias("node"), F.col("id").alias("root"), F.array().cast(kind).alias("chain")))
    length = 0
    while not _empty(delta) and (max_length is None or length < max_length):
        if max_paths is not None:
            rank = F.row_number().over(Window.partitionBy(*keys, "node").orderBy("chain", "root"))
            made = cut(longer(delta).withColumn("__n", rank).filter(F.col("__n") <= max_paths).drop("__n"))
            steps = 1
        elif few:
            # edges that every task holds: some steps at once, each without a shuffle, in as many partitions as before
            steps = STEPS if max_length is None else min(STEPS, max_length - length)
            grown = [longer(delta)]
            for _ in range(steps - 1):
                grown.append(longer(grown[-1]))
            made = cut(functools.reduce(DataFrame.unionByName, grown).coalesce(n))
        else:
            made, steps = written(longer(delta)), 1
        found = found.unionByName(made)
        length += steps
        delta = made.filter(F.size("chain") == length)
    return found


def shortest_paths(nodes: DataFrame, edges: DataFrame, link: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys.., node, root, chain): of each node that blocks the first of its blocking paths by length, root and chain.

    Nodes are reached in rounds of equal length, and the first path of a node is a link in front of the first path of a node of the round before; it
    never repeats a node.  A node keeps one path, so the work is linear in the edges however many paths there are.  ``nodes``,
    ``edges`` and ``link`` are as for ``simple_paths``; seeds have empty chains.
    """
    keys = keys or []
    never = nodes.filter(F.col("status") == NEVER).select(*keys, F.col("id").alias("src"))
    usable = cut(edges.filter(~F.col("protected")).join(never, [*keys, "src"], "left_anti").select(*keys, "src", F.col("dst").alias("node"), link.alias("__link")).distinct())
    kind = usable.select(F.array("__link").alias("chain")).schema["chain"].dataType
    found = last = written(nodes.filter(F.col("status") == KNOWN).select(*keys, F.col("id").alias("node"), F.col("id").alias("root"), F.array().cast(kind).alias("chain")))
    while True:
        step = usable.join(last, [*keys, "node"]).select(*keys, F.col("src").alias("node"), "root", F.concat(F.array("__link"), F.col("chain")).alias("chain"))
        new = step.join(found.select(*keys, "node"), [*keys, "node"], "left_anti")
        best = new.groupBy(*keys, "node").agg(F.min(F.struct("root", "chain")).alias("__best"))
        last = written(best.select(*keys, "node", "__best.root", "__best.chain"))
        if _empty(last):
            return found
        found = found.unionByName(last)


def reachable(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., id, status) with statuses spread backwards along unprotected edges; linear in the edges per round."""
    keys = keys or []
    never = nodes.filter(F.col("status") == NEVER).select(*keys, F.col("id").alias("src"))
    usable = cut(edges.filter(~F.col("protected")).join(never, [*keys, "src"], "left_anti").select(*keys, "src", "dst").distinct())
    seen = delta = cut(nodes.filter(F.col("status") == KNOWN).select(*keys, "id"))
    while not _empty(delta):
        step = usable.join(delta.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi").select(*keys, F.col("src").alias("id")).distinct()
        delta = cut(step.join(seen, [*keys, "id"], "left_anti"))
        seen = cut(seen.unionByName(delta))
    spread = seen.withColumn("__hit", F.lit(True))
    status = F.when((F.col("status") == OPEN) & F.col("__hit"), SPREAD).otherwise(F.col("status"))
    return nodes.join(spread, [*keys, "id"], "left").withColumn("status", status).drop("__hit")


def strongly_connected(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., id, scc): the least member names a component.

    Nodes without an edge in or out are trimmed off round by round.  The rest is coloured with the largest
    id that reaches a node; within a colour, what reaches the colour's own node backwards is a component.
    """
    keys = keys or []
    nodes = cut(nodes.select(*keys, "id").distinct())
    graph = cut(edges.filter("src != dst").select(*keys, "src", "dst").distinct())
    done = None

    def settle(rows: DataFrame) -> None:
        nonlocal done
        done = rows if done is None else done.unionByName(rows)

    while True:
        # trim to nodes that have edges both ways
        while True:
            both = graph.select(*keys, F.col("src").alias("id")).intersect(graph.select(*keys, F.col("dst").alias("id")))
            kept = cut(graph.join(both.withColumnRenamed("id", "src"), [*keys, "src"], "left_semi").join(both.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi"))
            if kept.count() == graph.count():
                break
            graph = kept
        if _empty(graph):
            break
        colour = cut(graph.select(*keys, F.col("src").alias("id")).union(graph.select(*keys, F.col("dst").alias("id"))).distinct().withColumn("colour", F.col("id")))
        while True:
            come = graph.join(colour.withColumnRenamed("id", "src"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("id")).agg(F.max("colour").alias("__come"))
            spread = cut(colour.join(come, [*keys, "id"], "left").select(*keys, "id", F.greatest("colour", F.coalesce("__come", "colour")).alias("colour"), (F.coalesce("__come", "colour") > F.col("colour")).alias("__new")))
            moved = not _empty(spread.filter("__new"))
            colour = spread.drop("__new")
            if not moved:
                break
        same = graph.join(colour.withColumnRenamed("id", "src"), [*keys, "src"]).join(colour.select(*keys, F.col("id").alias("dst"), F.col("colour").alias("__c")), [*keys, "dst"]).filter("colour = __c").select(*keys, "src", "dst", "colour")
        same = cut(same)
        members = delta = cut(colour.filter("id = colour"))
        while not _empty(delta):
            step = same.join(delta.select(*keys, F.col("id").alias("dst"), "colour"), [*keys, "dst", "colour"], "left_semi").select(*keys, F.col("src").alias("id"), "colour").distinct()
            delta = cut(step.join(members, [*keys, "id"], "left_anti"))
            members = cut(members.unionByName(delta))
        named = members.groupBy(*keys, "colour").agg(F.min("id").alias("scc"))
        settle(cut(members.join(named, [*keys, "colour"]).select(*keys, "id", "scc")))
        gone = members.select(*keys, F.col("id").alias("src"))
        graph = cut(graph.join(gone, [*keys, "src"], "left_anti").join(gone.withColumnRenamed("src", "dst"), [*keys, "dst"], "left_anti"))
    if done is None:
        return nodes.withColumn("scc", F.col("id"))
    return nodes.join(done, [*keys, "id"], "left").withColumn("scc", F.coalesce("scc", "id"))


def condense(edges: DataFrame, scc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., from_scc, to_scc, all_protected, n_edges) between different components."""
    keys = keys or []
    left = scc.select(*keys, F.col("id").alias("src"), F.col("scc").alias("from_scc"))
    right = scc.select(*keys, F.col("id").alias("dst"), F.col("scc").alias("to_scc"))
    joined = edges.join(left, [*keys, "src"]).join(right, [*keys, "dst"]).filter("from_scc != to_scc")
    return joined.groupBy(*keys, "from_scc", "to_scc").agg(F.bool_and("protected").alias("all_protected"), F.count("*").alias("n_edges"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of an acyclic graph: 0 without incoming edges, else one more than the highest predecessor."""
    rest = cut(edges.select("src", "dst").distinct())
    left = cut(nodes.select("id").distinct())
    done = None
    level = 0
    while not _empty(left):
        ready = cut(left.join(rest.select(F.col("dst").alias("id")), "id", "left_anti"))
        if _empty(ready):
            raise ValueError("the graph has a cycle")
        rows = ready.withColumn("level", F.lit(level))
        done = rows if done is None else done.unionByName(rows)
        left = cut(left.join(ready, "id", "left_anti"))
        rest = cut(rest.join(ready.withColumnRenamed("id", "src"), "src", "left_anti"))
        level += 1
    return done if done is not None else nodes.select("id", F.lit(0).alias("level"))


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, position) of an acyclic graph: again and again the least id that is ready, as from a heap.

    A node's label begins with the greatest of its ancestors and itself, then the greatest of those between that one and it, and so on
    down to itself.  A node is taken after the greatest of its ancestors and, once that is out, before anything greater; within
    the nodes that wait for it the same holds again.  So labels, compared element by element, stand in the order of the heap.  A label comes from the greatest label of the
    predecessors: its elements above the node's id, and the id.  Levels are labelled one after another; labels are as
    long as the longest descent to a node.
    """
    rest = cut(edges.select("src", "dst").distinct())
    left = cut(nodes.select("id").distinct())
    done, labels = None, None
    while not _empty(left):
        ready = cut(left.join(rest.select(F.col("dst").alias("id")), "id", "left_anti"))
        if _empty(ready):
            raise ValueError("the graph has a cycle")
        known = ready.withColumn("best", F.lit(None).cast("array<long>")) if labels is None else ready.join(labels, "id", "left")
        above = F.coalesce(F.filter("best", lambda x: x > F.col("id")), F.array().cast("array<long>"))
        fresh = cut(known.select("id", F.concat(above, F.array(F.col("id").cast("long"))).alias("label")))
        done = fresh if done is None else cut(done.unionByName(fresh))
        left = cut(left.join(ready, "id", "left_anti"))
        # the greatest label so far is kept for what is not ready yet
        sent = rest.join(fresh.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.col("label").alias("best"))
        sent = sent if labels is None else sent.unionByName(labels.join(left, "id", "left_semi"))
        labels = cut(sent.groupBy("id").agg(F.max("best").alias("best")))
        rest = cut(rest.join(ready.withColumnRenamed("id", "src"), "src", "left_anti"))
    if done is None:
        return nodes.select("id", F.lit(0).cast("long").alias("position"))
    return dense_ids(done, ["label"], "position").select("id", F.col("position").cast("long").alias("position"))
