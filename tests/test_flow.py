"""What comes into variables, and how it is kept."""

import random

from latchgraph.operators import flow, resolve
from latchgraph.sources import files
from latchgraph.sources.facts import read_facts


def found(spark, text):
    facts = read_facts(files.from_texts(spark, [("p", "a.py", text)]))
    by = resolve.lookup(facts)
    opened = flow.opened(facts, resolve.located(by.resolved, by), by)
    return {(r["enclosing"], r["target"]) for r in opened.references.collect()} if opened else set()


def test_many_things_of_one_variable_are_few_rows(spark, monkeypatch):
    n, rows, spread = 70, [], flow.spread
    monkeypatch.setattr(flow, "spread", lambda edges, state: (lambda out: rows.append(out.count()) or out)(spread(edges, state)))
    text = "".join(f"class A{i}:\n    def run(self): pass\n" for i in range(n)) + "def f(x): x.run()\ndef g(x): f(x)\n" + "".join(f"g(A{i}())\n" for i in range(n))
    assert found(spark, text) == {("f", f"a.A{i}.run") for i in range(n)}
    # two variables with two blocks of 64 things; then what is read from one as well
    assert rows == [4, 6]


def test_parameters_of_calls_that_open_later(spark):
    """``f`` is called through a variable only, so nothing comes into its parameter before that call is known."""
    text = "class A:\n    def run(self): pass\ndef f(x): x.run()\ndef g(h): h(A())\ng(f)\n"
    assert {("g", "a.f"), ("f", "a.A.run")} <= found(spark, text)


def test_bits_go_along_edges_to_the_end(spark):
    r = random.Random(3)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(45)}
    held = {i: {(r.randrange(2), 1 << r.choice([0, 5, 63])) for _ in range(2)} for i in range(4)}
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = spark.createDataFrame([(i, b, signed(m)) for i, x in held.items() for b, m in x], "id long, block int, mask long")
    state = flow.spread(spark.createDataFrame([(b, a) for a, b in edges], "id long, source long"), flow._merged(None, rows))
    got = {(x["id"], x["block"]): x["mask"] for x in state.collect()}
    want, changed = {i: set(x) for i, x in held.items()}, True
    while changed:
        changed = False
        for a, b in edges:
            more = want.get(a, set()) - want.get(b, set())
            if more:
                want.setdefault(b, set()).update(more)
                changed = True
    assert got == {(i, b): signed(sum(m for c, m in x if c == b)) for i, x in want.items() for b in {c for c, _ in x}}
    assert all(x["since"] == x["mask"] and x["fresh"] == 0 for x in state.collect())
