import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from latchgraph.llm.op11_conversation_trie import _parents, dealt, op11, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, part string, digest string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in by.items()}


def plain(rows):
    own = turns_of(rows)
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, convs in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(convs) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not children[k]
    out = []
    for k, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(k))
        out.append((min(convs), len(k), min(members[k[:-1]]) if k else None, len(convs), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def table(spark, rows, folder):
    path = str(folder)
    spark.createDataFrame([(*r, 5, "p", "x") for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def found(frame):
    return sorted(tuple(r) for r in frame.select(COLUMNS).collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    rows = [(c, t, r.choice(("user", "bot", None)), r.choice(("", "a", "bb", None, "äé\U0001f600"))) for c in [*range(90, 130), 300, 301, 417, -5, -100, -103] for t in range(r.randint(0, 7))]
    rows += [(c, t, "user", f"w{t // 3}") for c in (1000, 1007) for t in range(150)]  # long ones that share all turns
    rows += [(1012, None, "x", "same")] * 40 + [(1012, 3, "b", "tie"), (1012, 3, "a", "tie"), (1012, 3, "a", "tie")]  # a hot, repeated turn and ties
    rows += [(None, 1, "user", "no id")] * 3
    return rows


def test_equals_brute_force(spark, rows, tmp_path):
    assert found(op11(spark, table(spark, rows, tmp_path))) == plain(rows)


def test_long_conversations_span_ranges(spark, rows, tmp_path):
    turns = dealt(spark.read.parquet(table(spark, rows, tmp_path) + "/conversations.parquet"))
    assert turns.filter("conv_id = 1000").select("part").union(turns.filter("conv_id = 1007").select("part")).distinct().count() > 1
    largest = turns.groupBy("part").count().agg({"count": "max"}).first()[0]
    assert largest < 0.6 * turns.count()


def test_parents_of_wide_nodes(spark, rows, tmp_path):
    """The looked-up parent is the same whether its node counts as one with many children or not."""
    nodes = spark.createDataFrame(
        [(0, 10, 11, 1, 2500, -1, -1, 0)] + [(1, i, i, i + 1, 0, 10, 11, 1 if i else 0) for i in range(2500)], "depth long, ka long, kb long, conv_id long, n_children long, pa long, pb long, own_from long"
    )
    got = _parents(nodes).select("depth", "parent_conv_id").distinct().collect()
    assert sorted(map(tuple, got), key=str) == [(0, None), (1, 1)]


def test_owner_and_depth_are_a_key(spark, rows, tmp_path):
    nodes = op11(spark, table(spark, rows, tmp_path))
    assert nodes.count() == nodes.select("conv_id", "depth").distinct().count()


def test_general_paths(spark):
    """Paths that were not rebuilt: one conversation without turns, two equal ones."""
    turns = spark.createDataFrame([(c, 0, d, bytes([d]), 10 * d) for c in (7, 9) for d in (1, 2)], "conv_id long, part int, depth long, digest binary, tokens long")
    ids = spark.createDataFrame([(7,), (8,), (9,)], "conv_id long")
    ends = {k: hashlib.sha256(k.encode()).hexdigest() for k in ("", "8", "7,9")}
    assert found(prefix_trie(ids, turns)) == [(7, 0, None, 3, 1, 1, 30, ends["8"]), (7, 1, 7, 2, 1, 1, 30, ends[""]), (7, 2, 7, 2, 0, 1, 20, ends["7,9"])]


def test_empty(spark):
    ids, turns = rebuilt(dealt(spark.createDataFrame([], SCHEMA)))
    assert prefix_trie(ids, turns).columns == COLUMNS and not prefix_trie(ids, turns).count()
