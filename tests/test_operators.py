import heapq
import random

import pytest
from pyspark.sql import functions as F

from latchgraph.functions import text as T
from latchgraph.operators import graph, joins, sets, windows


def link():
    return F.struct(F.col("src").cast("string").alias("function_name"))


def closed(edges):
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    changed = True
    while changed:
        changed = False
        for a in reach:
            more = set().union(*(reach.get(b, set()) for b in reach[a])) - reach[a] if reach[a] else set()
            if more:
                reach[a] |= more
                changed = True
    return reach


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_condensation(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(45)}
    nodes = spark.range(30)
    frame = spark.createDataFrame([(a, b, r.random() < 0.5) for a, b in sorted(edges)], "src long, dst long, protected boolean")
    scc = graph.strongly_connected(nodes, frame)
    got = {x["id"]: x["scc"] for x in scc.collect()}
    reach = closed(edges)
    for a in range(30):
        mutual = [b for b in range(30) if b in reach.get(a, ()) and a in reach.get(b, ())]
        assert got[a] == min([a, *mutual])
    wide = {(x["from_scc"], x["to_scc"]): x["all_protected"] for x in graph.condense(frame, scc).collect()}
    for x in frame.collect():
        a, b = got[x["src"]], got[x["dst"]]
        if a != b:
            assert (a, b) in wide and (wide[a, b] is False or x["protected"])


def paths(spark, nodes, edges, **bounds):
    n = spark.createDataFrame(nodes, "id long, status string")
    e = spark.createDataFrame(edges, "src long, dst long, protected boolean")
    found = graph.simple_paths(n, e, link(), F.col("src").cast("string"), **bounds)
    return sorted((r["node"], r["root"], [x["function_name"] for x in r["chain"]]) for r in found.collect())


def test_paths(spark):
    nodes = [(1, "Unknown"), (2, "Unknown"), (3, "KnownBlocking"), (4, "KnownNonBlocking"), (5, "Unknown")]
    edges = [(1, 2, False), (2, 1, False), (2, 3, False), (1, 3, True), (4, 3, False), (5, 4, False), (3, 2, False)]
    # 4 never blocks; the protected edge carries nothing; the root may be entered once more
    assert paths(spark, nodes, edges) == [(1, 3, ["1", "2"]), (1, 3, ["1", "2", "3", "2"])][:1] + [(2, 3, ["2"]), (3, 3, []), (3, 3, ["3", "2"])]
    assert paths(spark, nodes, edges, max_length=1) == [(2, 3, ["2"]), (3, 3, [])]
    status = {r["id"]: r["status"] for r in graph.reachable(spark.createDataFrame(nodes, "id long, status string"), spark.createDataFrame(edges, "src long, dst long, protected boolean")).collect()}
    assert status == {1: "PropagatedBlocking", 2: "PropagatedBlocking", 3: "KnownBlocking", 4: "KnownNonBlocking", 5: "Unknown"}


def test_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    assert {r["id"]: r["level"] for r in graph.levels(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long"), edges).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}
    with pytest.raises(ValueError):
        graph.levels(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_windows_and_sets(spark):
    rows = spark.createDataFrame([(i % 5, 100 - i) for i in range(100)], "k int, v int")
    assert {r["k"]: r["v"] for r in windows.first_wins(rows, ["k"], ["v"]).collect()} == {0: 5, 1: 4, 2: 3, 3: 2, 4: 1}
    assert {r["k"]: r["v"] for r in windows.last_wins(rows, ["k"], ["v"]).collect()} == {0: 100, 1: 99, 2: 98, 3: 97, 4: 96}
    assert [r["id"] for r in windows.dense_ids(rows, ["v"]).orderBy("v").collect()] == list(range(100))
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    out = sets.effective(base, base.filter("k = 'a'"), spark.createDataFrame([("a", 9), ("c", 3)], "k string, v int"), ["k"])
    assert {r["k"]: r["v"] for r in out.collect()} == {"a": 9, "b": 2, "c": 3}


def test_joins(spark):
    names = spark.createDataFrame([("a.b.c",), ("a.bc",), ("a",), ("x",)], "name string")
    prefixes = spark.createDataFrame([("a.b",), ("x",)], "prefix string")
    assert sorted(r["name"] for r in joins.module_prefix(names, "name", prefixes, "prefix").collect()) == ["a.b.c", "x"]
    points = spark.createDataFrame([("f", 3, 4), ("f", 3, 9), ("g", 3, 4)], "k string, s int, e int")
    ranges = spark.createDataFrame([("f", 1, 5), ("f", 1, 2)], "k string, a int, b int")
    got = {(r["k"], r["e"]): r["inside"] for r in joins.contained(points, ranges, ["k"], ("s", "e"), ("a", "b")).collect()}
    assert got == {("f", 4): True, ("f", 9): False, ("g", 4): False}


def test_offsets(spark):
    text = "añb\nçd\U0001f600e\n"
    raw = text.encode()
    frame = spark.createDataFrame([(i,) for i in range(-1, len(raw) + 2)], "o int").withColumn("c", F.lit(bytearray(raw)))
    for r in frame.select("o", T.line_of(F.col("c"), F.col("o")).alias("l"), T.column_of(F.col("c"), F.col("o")).alias("k")).collect():
        o = r["o"]
        whole = 0 <= o <= len(raw) and (o == len(raw) or raw[o] & 0xC0 != 0x80)
        if not whole:
            assert r["l"] is None and r["k"] is None
        else:
            before = raw[:o].decode()
            assert (r["l"], r["k"]) == (before.count("\n") + 1, len(before.rsplit("\n", 1)[-1]) + 1)


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(T.module_of(F.lit("stubs/a/b.pyi"))) == "a.b"
    assert value(T.module_of(F.lit("pkg/__init__.py"))) == "pkg"
    assert value(T.party_name(F.lit("pkg/mod.py"), F.lit("C.f"), F.lit(False))) == "pkg.mod.C.f"
    assert value(T.party_name(F.lit("pkg/mod.py"), F.lit("f"), F.lit(True))) == "f"
    assert value(T.party_name(F.lit("main.py"), F.lit("f"), F.lit(False))) == "f"
    assert value(T.relative_path(F.lit("/a/b\\c.py"), F.lit("/a/"))) == "b/c.py"
    assert value(T.storage_key(F.lit("a/b"))) != value(T.storage_key(F.lit("a_b")))
    assert value(T.stem(F.lit("a/b.c.py"))) == "b.c"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_topological_order_is_that_of_a_heap(spark, seed):
    r = random.Random(seed)
    n = 40
    rank = list(range(n))
    r.shuffle(rank)
    edges = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(60)) if rank[a] < rank[b]}
    waits = {v: sum(b == v for _, b in edges) for v in range(n)}
    heap, want = [v for v in waits if not waits[v]], []
    heapq.heapify(heap)
    while heap:
        want.append(heapq.heappop(heap))
        for b in (b for a, b in edges if a == want[-1]):
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(heap, b)
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {x["position"]: x["id"] for x in graph.topological_order(spark.range(n), frame).collect()}
    assert [got[i] for i in range(n)] == want


def test_topological_order_of_a_falling_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(12, 0, -1)], "src long, dst long")
    assert {x["id"]: x["position"] for x in graph.topological_order(spark.range(13), chain).collect()} == {12 - i: i for i in range(13)}
    assert graph.topological_order(spark.range(0), chain.limit(0)).collect() == []
    with pytest.raises(ValueError):
        graph.topological_order(spark.range(13), chain.union(spark.createDataFrame([(0, 12)], "src long, dst long"))).collect()


def test_contained_sweep(spark):
    """Against all pairs, with one hot key, ties and null keys."""
    r = random.Random(4)
    ranges = [(r.choice(("hot", "hot", "hot", "x", None)), a := r.randrange(300), a + r.randrange(40)) for _ in range(200)]
    points = [(i, r.choice(("hot", "hot", "hot", "x", "y", None)), a := r.randrange(300), a + r.randrange(20)) for i in range(300)]
    got = joins.contained(spark.createDataFrame(points, "i int, k string, p int, q int"), spark.createDataFrame(ranges, "k string, a int, b int"), ["k"], ("p", "q"), ("a", "b"))
    assert {(x["i"], x["inside"]) for x in got.collect()} == {(i, k is not None and any(k == m and a <= p and q <= b for m, a, b in ranges)) for i, k, p, q in points}


@pytest.mark.parametrize("strict", [True, False])
def test_last_before(spark, strict):
    r = random.Random(6)
    right = [(r.choice(("hot", "hot", "x", None)), r.randrange(200), r.randrange(9)) for _ in range(150)]
    left = [(i, r.choice(("hot", "hot", "x", "y", None)), r.randrange(200)) for i in range(200)]
    got = joins.last_before(spark.createDataFrame(left, "i int, k string, p int"), spark.createDataFrame(right, "k string, a int, v int"), ["k"], "p", "a", "v", "last", strict)
    want = set()
    for i, k, p in left:
        fits = [(a, v) for m, a, v in right if k is not None and m == k and (a < p or (a == p and not strict))]
        if fits:
            want.add((i, max(fits)[1]))
    assert {(x["i"], x["last"]) for x in got.collect()} == want


def test_running_values_cross_ranges(spark):
    rows = spark.createDataFrame([("k", i, i if i % 50 == 0 else None) for i in range(1000)], "k string, o int, v int")
    got = windows.running(rows, ["k"], ["o"], "v", "last", last=True)
    assert all(x["last"] == x["o"] // 50 * 50 for x in got.collect())


def scanned(args):
    """Parts of an argument list in a loop over its characters."""
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(args):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            parts.append((begin, i))
            begin = i + 1
    if begin < len(args):
        parts.append((begin, len(args)))
    out = []
    for a, b in parts:
        raw = args[a:b]
        start = len(args[:a].encode()) + len(raw.encode()) - len(raw.lstrip().encode())
        out.append((raw.strip(), start, start + len(raw.strip().encode())))
    return out


def test_argument_scanner(spark):
    r = random.Random(2)
    texts = ["", ",", " a , (b, c", "x),y", '"a,b",[1,{2,3}]', "é , ü,"] + ["".join(r.choice("ab,,()[]{} \"é\t") for _ in range(r.randint(1, 30))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, args string")
    got = frame.select("i", T.split_arguments(F.col("args")).alias("a"), T.argument_ranges(F.concat(F.lit("é("), "args", F.lit(")")), F.lit(10)).alias("b")).collect()
    for x in got:
        assert [tuple(a) for a in x["a"]] == scanned(texts[x["i"]])
        assert [tuple(b) for b in x["b"]] == [(t, a + 13, b + 13) for t, a, b in scanned(texts[x["i"]]) if t]


def test_questions(spark, tmp_path):
    from latchgraph.operators import questions
    from latchgraph.sources import files
    from latchgraph.sources.facts import read_facts

    text = "import time\nclass A:\n    @property\n    def slow(self):\n        time.sleep(1)\n    def use(self):\n        self.slow\n        return self + self\n"
    source = files.from_texts(spark, [("p", "a.py", text), ("p", "empty.py", "")])
    made = questions.index(read_facts(source), source)
    questions.save(made, str(tmp_path / "index"))
    kept = questions.load(spark, str(tmp_path / "index"))
    asks = [("call", 5, 9), ("callable", 5, 9), ("property", 7, 14), ("attribute", 7, 14), ("dunder", 8, 16), ("call", 1, 1), ("executor", 5, 9)]
    want = [["time.sleep"], ["time.sleep"], ["a.py:A.slow"], ["a.py:A.slow"], [], [], []]
    assert [questions.answer(kept, "p", "a.py", *a) for a in asks] == want
    assert questions.answer(kept, "p", "gone.py", "call", 1, 1) is None and questions.answer(kept, "p", "empty.py", "call", 1, 1) == []
    rows = [("p", path, line, column, q) for path in ("a.py", "gone.py") for q, line, column in asks]
    asked = spark.createDataFrame(rows + rows[:1], "project string, path string, line int, column int, question string")
    for table in (made, kept):
        got = [(r["path"], r["question"], r["line"], r["column"], r["known"], r["answer"]) for r in questions.answers(table, asked).collect()]
        expected = [("a.py", *a, True, w) for a, w in zip(asks + asks[:1], want + want[:1])] + [("gone.py", *a, False, None) for a in asks]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_reports_store_their_rows_once_and_know_the_last_place(spark, monkeypatch):
    """Documents over several ranges, and orders with one key twice, which are two diagnostics."""
    from latchgraph.operators import render, windows

    stored = []
    for module in (windows, render):
        monkeypatch.setattr(module, "cut", lambda frame, cut=module.cut: (stored.append("primary_location" in frame.columns), cut(frame))[1])
    n = 50
    found = spark.range(n).selectExpr("if(id % 7 = 0, 'p', 'q') project", "'LATCH001' code", "'error' severity", "concat('m', id) message", "struct(concat('f', id % 3) file, int(id) line, 1 column) primary_location", "cast(array() as array<struct<file string, line int, column int, message string>>) related_locations", "cast(array() as array<struct<function string, file string, line int, is_async boolean, is_first_party boolean>>) chain", "'h' help", "'s' intervention_strategy")
    documents = spark.createDataFrame([("p", "p", 0), ("q", "q", 0)], "project string, document string, position int")
    warnings = spark.createDataFrame([], "project string, file string, message string")
    made = [r for r in render.ordered_pieces(render.pieces(found, warnings, documents, "sarif")).collect() if r["section"] == 1]
    assert stored.count(True) == 1
    assert [r["place"] for r in made] == list(range(n))
    assert [i for i, r in enumerate(made) if not r["text"].endswith(",")] == [7, n - 1]
