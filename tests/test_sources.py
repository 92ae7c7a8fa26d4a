"""How generated source is dealt over tasks, and what is read of it."""

import os

import pytest

from latchgraph.operators import callgraph, questions, resolve
from latchgraph.plans import sources
from latchgraph.sources import files
from latchgraph.sources.config import Config
from latchgraph.sources.facts import SYNTAX, Reader, read_facts

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_files_are_dealt_over_all_tasks(spark):
    rows = sources.source_files(spark, DATA).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert len(rows) == 4 and min(rows) > 0
    assert sum(rows) == spark.read.parquet(f"{DATA}/part.parquet").count()


@pytest.mark.parametrize("kinds", [("function",), ("reference",), ("import", "class"), SYNTAX, ("syntax_error",)])
def test_facts_of_some_kinds(spark, kinds):
    texts = [("p", "a.py", "import os\nclass A:\n    x: int = 1\n    def f(self, é, g=lambda y: [z for z in y]):\n        return os.stat('é')(self.f(é)) + é\n"), ("p", "b.py", "def f(:\n"), ("p", "c.py", "async def g(x):\n    y = x.a\n    for z in y: str(z)\n    return (w := y[0]) or -w\n")]
    found = files.from_texts(spark, texts)
    wanted = sorted(map(str, read_facts(found).filter(f"fact in {kinds!r}" if len(kinds) > 1 else f"fact = '{kinds[0]}'").collect()))
    assert wanted and wanted == sorted(map(str, read_facts(found, kinds).collect()))


TEXTS = [
    ("p", "a.py", "import os\nclass A(dict):\n    x: int = 1\n    def f(self, é, g=lambda y: [z for z in y]):\n        self.o = open('o')\n        return os.stat('é')(self.f(é)) + é\n"),
    ("p", "b.py", "if (n := len('x')): pass\ntype T = list[int]\nmatch n:\n    case 1 | None: n\n    case {'k': str(), **r}: r[0]\n"),
]


@pytest.mark.parametrize("kinds", [None, ("reference",), SYNTAX, ("class",)])
def test_facts_of_some_columns(spark, kinds):
    found, kept = files.from_texts(spark, TEXTS), ["path", "fact", "kind", "target", "line", "bases"]
    some = read_facts(found, kinds, kept)
    assert set(some.columns) == set(kept)
    assert sorted(map(str, some.select(kept).collect())) == sorted(map(str, read_facts(found, kinds).select(kept).collect()))


def test_what_is_not_asked_for_is_not_made():
    """Arguments are not looked at without their column, nor expressions without references."""
    read = lambda facts, columns: Reader("p", "a.py", "a", False, False, TEXTS[0][2].encode(), facts, columns)
    calls = [r for r in read(frozenset(["reference"]), frozenset(["kind"])).read() if r["kind"] == "call"]
    assert calls and not any(r["arguments"] for r in calls)
    reader = read(frozenset(["class"]), None)
    reader.call = reader.implicit = None  # would fail when called
    assert [r["bases"] for r in reader.read()] == [["builtins.dict"]]


def test_index_resolves_what_references_and_bases_name(spark):
    facts = read_facts(files.from_texts(spark, TEXTS))
    kept = questions.FACTS.split()
    names = lambda by: {r["target"] for r in by.resolved.collect()}
    few = names(resolve.lookup(facts, handed=False))
    assert few == {r["target"] for r in facts.filter("fact = 'reference' and target is not null").collect()} | {"builtins.dict"}
    where = facts.select("project", "path").distinct()
    pruned = read_facts(files.from_texts(spark, TEXTS), SYNTAX, kept)
    assert sorted(map(str, questions.index(pruned, where).collect())) == sorted(map(str, questions.index(facts, where, resolve.lookup(facts)).collect()))


def test_nodes_without_edges(spark):
    facts = read_facts(files.from_texts(spark, TEXTS))
    config = [Config(root="p")]
    rows = lambda frame: sorted(map(str, frame.collect()))
    alone, whole = callgraph.build(facts, config, edges=False), callgraph.build(facts, config)
    assert alone.edges is None and whole.edges is not None
    assert rows(alone.nodes) == rows(whole.nodes) and any("open" in r for r in rows(alone.nodes))


@pytest.mark.parametrize("kinds", [("call",), ("attribute",), ("implicit",), ("decorator",), ("call", "attribute", "decorator")])
def test_references_of_some_kinds(spark, kinds):
    found = files.from_texts(spark, TEXTS + [("p", "c.py", "import d\n@d.e(1)\ndef f(x: 'dict'):\n    d.g; x.y; x + 1; x(); d.h(x.z)\n    [d.i for x.j in x]\n    return len(x)\n")])
    whole = read_facts(found, ("reference",)).collect()
    some = read_facts(found, ("reference",), kinds=kinds).collect()
    assert some and sorted(map(str, some)) == sorted(str(r) for r in whole if r["kind"] in kinds)


def test_implicit_references_of_some_methods(spark):
    found = files.from_texts(spark, TEXTS + [("p", "c.py", "def f(x: 'dict'):\n    x + 1; x < 2; x(); -x\n    return len(x)\n")])
    whole = read_facts(found, ("reference",), kinds=("implicit",)).collect()
    for methods in (["__lt__", "__len__"], ["__call__"]):
        some = read_facts(found, ("reference",), kinds=("implicit",), methods=methods).collect()
        assert some and sorted(map(str, some)) == sorted(str(r) for r in whole if (r["name"] or r["target"].rsplit(".", 1)[1]) in methods)


def test_expressions_are_passed_by_where_only_statements_are_asked_for():
    seen = []
    for text in ("class A:\n    def f(self): return [x for x in self.y] + (1,)\n", "def f(self):\n    [0 for self.x in y]\n    class B(self.x): pass\n"):
        reader = Reader("p", "a.py", "a", False, False, text.encode(), frozenset(["class", "import"]), None)
        visit, kinds = reader.visit, set()
        reader.visit = lambda node, *more, v=visit, k=kinds: (k.add(type(node).__name__), v(node, *more))[1]
        rows = reader.read()
        assert [r["name"] for r in rows] == ["A" if "A" in text else "B"]
        seen.append(kinds)
    # a comprehension that binds an attribute is gone into
    assert "BinOp" not in seen[0] and "ListComp" in seen[1]


def test_index_of_asked_places(spark):
    facts, where = read_facts(files.from_texts(spark, TEXTS)), files.from_texts(spark, TEXTS).select("project", "path")
    asked = spark.createDataFrame([("p", "/p/a.py" if where.first()["path"].startswith("/") else "a.py", 6, 16, "call")], "project string, path string, line int, column int, question string")
    whole = questions.index(facts, where)
    some = questions.index(facts, where, asked=asked)
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(some.filter("kind is not null")) == rows(whole.filter("kind is not null and path like '%a.py' and line = 6 and column = 16")) and some.filter("kind is not null").count()
    assert rows(questions.answers(some, asked)) == rows(questions.answers(whole, asked))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_question_without_references_parses_nothing(spark, monkeypatch):
    monkeypatch.setattr(sources, "facts", None)  # would fail when called
    assert sources.ux11_event_loop_executor(spark, DATA).count() == spark.read.parquet(f"{DATA}/part.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_source_is_the_template_with_its_places_filled(spark):
    made = {r["path"]: bytes(r["content"]).decode() for r in sources.source_files(spark, DATA).collect()}
    for part in spark.read.parquet(f"{DATA}/part.parquet").collect():
        text = sources.TEXT
        for name, (column, values) in sources.CHOICES.items():
            text = text.replace(f"<{name}>", values[part[column] % len(values)])
        text = text.replace("\t", " " * sources.STEPS[part["p_partkey"] % 2]).replace("#", str(part["p_partkey"]))
        assert made[f"pkg/m{part['p_partkey']}.py"] == "\n" * (part["p_size"] % sources.BLANK) + text


DECORATED = [
    ("p", "m.py", "import latchgraph\nfrom latchgraph import blocking, non_blocking as calm\nclass A:\n    @blocking\n    def f(self): pass\n    @property\n    def g(self): return 1\n@calm\nasync def h(): pass\n@latchgraph.unblocker(1)\ndef k(a, b): pass\n"),
    ("p", "time.py", "def sleep(): pass\n"),
]


def test_own_nodes_need_no_flows(spark):
    found, config = files.from_texts(spark, DECORATED), [Config(root="p")]
    kinds, columns, of = callgraph.OWN
    some = read_facts(found, [*kinds, "reference"], columns.split(), of)
    assert not some.filter("fact in ('flow', 'parameter', 'load', 'result') or kind = 'call'").count()
    rows = lambda frame: sorted(map(str, frame.collect()))
    whole = rows(callgraph.build(read_facts(found), config).nodes.filter("is_first_party"))
    assert rows(callgraph.own_nodes(some, config)) == whole and sum("KnownBlocking" in r for r in whole) == 2
    # what a variable of a module stands for is told by flows
    kept = files.from_texts(spark, DECORATED + [("p", "n.py", "import m\n@m.mine\ndef f(): pass\n")])
    assert callgraph.own_nodes(read_facts(kept, [*kinds, "reference"], columns.split(), of), config) is None


def test_operators_whose_methods_stand_nowhere_give_no_edge(spark):
    config = [Config(root="p")]
    text = "import socket\nclass A:\n    def __len__(self): return 1\n    def __add__(self, x): return x\nclass B(A): pass\nasync def f(x: A, y: 'B'):\n    x + 1; x < 2; -y; len(y); x(); x[0]\n    with y: pass\n"
    found = files.from_texts(spark, [("p", "a.py", text)])
    special = callgraph.methods(found, config)
    assert {"__add__", "__len__"} <= set(special) and not {"__lt__", "__neg__", "__call__", "__getitem__"} & set(special)
    rows = lambda **more: sorted(map(str, callgraph.build(read_facts(found, **more), config).edges.collect()))
    assert rows(methods=special) == rows() and len(rows()) == 2
    assert callgraph.methods(files.from_texts(spark, [("p", "a.py", "é = 1\n")]), config) is None
    assert callgraph.methods(found, [Config(root="p", blocking_modules=("socket",))]) is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_report_of_diagnostics_makes_no_warnings(spark, monkeypatch):
    monkeypatch.setattr(sources.report, "warnings", None)  # would fail when called
    assert sources.ana_source_report(spark, DATA).count()
