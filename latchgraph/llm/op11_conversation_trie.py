"""Prefix trie of conversations by smallest-member ownership.

A node of the trie is a distinct sequence of first turns; its members are the conversations that start with
it, and its owner is the member with the smallest id.  A conversation that owns a node owns every deeper node
of its path, so it owns a suffix of the path, and each node is owned by exactly one member.  Sums over a
subtree therefore become sums over the members of its top:

- tokens that sharing saves: what the members' turns from there on hold, minus what they own of it;
- leaves: members that own their last node, where nobody goes on;
- children: members that own the next node of their path.

Windows along the conversations give each turn's prefix key and running tokens, ownership marks what is owned, and one
group-by of the prefix sums the marks.  The smallest member of a prefix comes from an aggregation, not from a
window over the prefix: the root's window would gather all conversations in one task.

A prefix key is the exclusive-or of two 64-bit hashes of (depth, SHA-256 of role and text) over the turns so far, so it
can be summed in parts: turns are dealt by range of (conversation, turn), and a conversation that spans several
ranges gets running values from its ranges' totals.  Whatever concerns a whole conversation is joined by
(conversation, range), so a conversation with a third of all turns never meets in one task.  Texts do not
leave the first scan.

Ends: ids of members that end at a node are hashed in ascending order.  A range of the ends joins its ids to strings of at most one batch,
and one task streams a node's strings through SHA-256; it holds one batch at a time (SHA-256 itself runs in sequence).

Defined cases: rows without conv_id are left out; null role and text are empty; null turns come first; turns that tie follow each
other by the SHA-256 of role and text; repeated rows are turns of their own; negative ids take their base and remainder towards zero; columns other than
conv_id, turn, role and text are not looked at; an empty table has no conversation and so no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import cut, partitions, table

GROUP = 100  # conversations of one group take the first turns of its first conversation
MOST = 6  # they take fewer than this
WIDE = 1000  # at most so many nodes have more than a WIDE-th of all nodes as children

_KEY = ["depth", "ka", "kb"]
_HERE = ["conv_id", "part"]
_NO_NODE = (1 << 62) - 1


def dealt(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, tokens and part: turns without their texts, in ranges that may cut a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("tokens"),
        F.monotonically_increasing_id().alias("tie"),  # equal rows are interchangeable; this lets a range end between them
    )
    rows = rows.repartitionByRange(partitions(rows.sparkSession), "conv_id", F.col("turn").asc_nulls_first(), "digest", "tie")
    return cut(rows.select("conv_id", "turn", "digest", "tokens", F.spark_partition_id().alias("part")))


def rebuilt(turns: DataFrame, group: int = GROUP, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Paths of conversations that take their first turns from the first conversation of their group.

    Gives the ids of all conversations, and rows of conv_id, part, depth (from 1), digest and tokens, with parts in the order of depths.
    """
    number = F.row_number().over(Window.partitionBy(*_HERE).orderBy(F.col("turn").asc_nulls_first(), "digest"))
    numbered = turns.withColumn("n", number.cast("long"))
    counts = turns.groupBy(*_HERE).agg(F.count("*").alias("n"))
    along = Window.partitionBy("conv_id").orderBy("part")
    parts = counts.select(*_HERE, (F.sum("n").over(along) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("turns"))
    first = F.col("conv_id") % group == 0

    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    parts = parts.select("*", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h)
    bases = parts.filter(first & (F.col("before") == 0)).select("base", F.col("turns").alias("base_turns"))
    parts = cut(parts.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0)))))

    placed = numbered.join(parts, _HERE).withColumn("place", F.col("before") + F.col("n"))
    heads = numbered.filter(first).join(parts.filter(first), _HERE).select(F.col("conv_id").alias("base"), (F.col("before") + F.col("n")).alias("depth"), "digest", "tokens")
    heads = parts.filter("before = 0 AND taken > 0").select("conv_id", "base", "taken").join(heads.filter(F.col("depth") < most), "base").filter("depth <= taken")
    own = placed.filter("place > h").select(*_HERE, (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "tokens")
    paths = own.unionByName(heads.select("conv_id", F.lit(-1).alias("part"), "depth", "digest", "tokens"))
    return parts.filter("before = 0").select("conv_id"), paths


def _keyed(ids: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each turn with its prefix's key, its parent's key and running tokens; and the parts of each conversation with its totals."""
    root = ids.select("conv_id", F.lit(-2).alias("part"), F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("tokens"))
    rows = turns.select(*_HERE, "depth", "digest", "tokens").unionByName(root)
    rows = rows.select(*_HERE, "depth", "tokens", *[F.xxhash64(F.lit(i), "depth", "digest").alias(x) for i, x in ((1, "a"), (2, "b"))])
    run = Window.partitionBy(*_HERE).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select(*_HERE, "depth", "tokens", "a", "b", F.bit_xor("a").over(run).alias("xa"), F.bit_xor("b").over(run).alias("xb"), F.sum("tokens").over(run).alias("upto"))

    totals = rows.groupBy(*_HERE).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("tokens").alias("t"), F.max("depth").alias("d"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    nought = F.lit(0).cast("long")
    parts = totals.select(
        *_HERE,
        *[F.coalesce(F.bit_xor(x).over(earlier), nought).alias(f"{x}0") for x in ("a", "b")],
        F.coalesce(F.sum("t").over(earlier), nought).alias("t0"),
        F.sum("t").over(whole).alias("all_tokens"),
        F.max("d").over(whole).alias("last"),
    )
    ka, kb = F.col("xa").bitwiseXOR(F.col("a0")), F.col("xb").bitwiseXOR(F.col("b0"))
    keyed = running.join(parts, _HERE).select(
        *_HERE, "depth", "tokens", "last", ka.alias("ka"), kb.alias("kb"), ka.bitwiseXOR(F.col("a")).alias("pa"), kb.bitwiseXOR(F.col("b")).alias("pb"), (F.col("upto") + F.col("t0")).alias("upto")
    )
    return cut(keyed), parts.select(*_HERE, "all_tokens")


def _parents(nodes: DataFrame, wide: int = WIDE) -> DataFrame:
    """Adds parent_conv_id.  Below the first node that it owns, a conversation's parent is its own; the first one looks its parent up.

    Nodes with very many children are few by count, so they are broadcast; lookups of the others are shuffled.
    """
    entry = (F.col("own_from") == F.col("depth")) & (F.col("depth") > 0)
    inner = nodes.filter(~entry).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    most = max(1000, nodes.count() // wide)
    owners = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.broadcast(owners.filter(F.col("n_children") > most).drop("n_children"))
    few = owners.filter((F.col("n_children") <= most) & (F.col("n_children") > 0)).drop("n_children")
    up = ["depth", "pa", "pb"]
    entries = nodes.filter(entry)
    return inner.unionByName(entries.join(many, up)).unionByName(entries.join(many, up, "left_anti").join(few, up))


def _ends(keyed: DataFrame) -> DataFrame:
    """For each node at which conversations end, the SHA-256 of their ids in ascending order."""
    ends = keyed.filter("depth = last").select(*_KEY, "conv_id")
    n = partitions(ends.sparkSession)
    ends = ends.repartitionByRange(n, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs: list[list] = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if runs and runs[-1][:3] == key:
                    runs[-1][4].append(str(conv))
                else:
                    runs.append([*key, conv, [str(conv)]])
            columns = [[r[i] for r in runs] for i in range(4)]
            arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([",".join(r[4]) for r in runs], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*_KEY, "first_id", "ids"])

    strings = ends.mapInArrow(join, "depth long, ka long, kb long, first_id long, ids string")
    strings = strings.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first_id")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for d, a, b, ids in zip(*(batch.column(x).to_pylist() for x in (*_KEY, "ids")), strict=True):
                if now == (d, a, b):
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (d, a, b), hashlib.sha256()
                state.update(ids.encode())
            yield made(done)
        if now is not None:
            yield made([(*now, state.hexdigest())])

    def made(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], [*_KEY, "ends_sha256"])

    return strings.mapInArrow(stream, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``ids`` has each conv_id once; ``turns`` has conv_id, part, depth (gapless from 1 in each conversation), digest and tokens, where parts
    cut a conversation in the order of its depths.  (conv_id, depth) is a key of the nodes, so it finds a node's turn.
    """
    keyed, parts = _keyed(ids, turns)
    smallest = keyed.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.min("tokens").alias("tokens"), (F.count("*") == F.count(F.when(F.col("depth") == F.col("last"), 1))).alias("childless"))
    # owned nodes are a path's suffix: where it begins, what it holds, and whether its end is a leaf
    owned = smallest.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.sum("tokens").alias("own_tokens"), F.max_by("childless", "depth").alias("leaf"))
    facts = parts.join(owned, "conv_id", "left").select(
        *_HERE, "all_tokens", F.coalesce("own_from", F.lit(_NO_NODE)).alias("own_from"), F.coalesce("own_tokens", F.lit(0)).alias("own_tokens"), F.coalesce("leaf", F.lit(False)).alias("leaf")
    )

    def flag(x: Column) -> Column:
        return F.sum(x.cast("long"))

    depth, own_from = F.col("depth"), F.col("own_from")
    occurring = F.col("all_tokens") - F.col("upto") + F.col("tokens")
    nodes = keyed.join(facts, _HERE).groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        flag((depth + 1 >= own_from) & (depth < F.col("last"))).alias("n_children"),
        flag(F.col("leaf")).alias("n_leaves"),
        F.sum(occurring - F.when(depth >= own_from, occurring).otherwise(F.col("own_tokens"))).alias("saved_tokens"),
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
        F.min("own_from").alias("own_from"),
    )
    nodes = _parents(cut(nodes)).join(_ends(keyed), _KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(dealt(table(spark, sf_dir, "conversations"))))
