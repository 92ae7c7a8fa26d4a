import collections
import random

import brute
import pytest
from pyspark.sql import functions as F

from latchgraph.llm import op6_mixing as op


def goals(totals: dict, weights=op.WEIGHTS, share=op.SHARE, cap=op.CAP) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out = share * sum(totals.values()), {}
    rest = list(names)
    while rest:
        level = left / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > cap * totals[s]]
        if not over:
            return out | {s: level * w[s] for s in rest}
        for s in over:
            out[s] = cap * totals[s]
            left -= out[s]
            rest.remove(s)
    return out


def mixed(docs):
    rows = docs.select("doc_id", "source", op.word_count(F.col("text")).alias("size"))
    return op.plan(rows, [F.col("doc_id")], F.col("source"), F.col("size"))


def test_targets_and_takes(docs, rows):
    got = mixed(docs).collect()
    totals = collections.Counter()
    for _, text, _, source in rows:
        totals[source] += len(brute.words(text))
    want = goals(totals)
    taken = collections.Counter()
    largest = collections.Counter()
    for r in got:
        assert r["__total"] == totals[r["source"]] and r["__target"] == pytest.approx(want[r["source"]])
        assert r["__copies"] <= 2 and len(r["__positions"]) == r["__copies"]
        assert all(0 <= p <= 1 for p in r["__positions"])
        taken[r["source"]] += r["__copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(rows)
    for s in totals:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_word_count(spark, rows):
    frame = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "i long, text string")
    assert [r["n"] for r in frame.orderBy("i").select(op.word_count(F.col("text")).alias("n")).collect()] == [len(brute.words(r[1])) for r in rows]


def test_water_level(spark):
    r = random.Random(2)
    for _ in range(3):
        totals = {f"s{i}": r.choice((0, 1, 10, 1000, 50)) for i in range(r.randint(1, 9))} | {None: 7}
        frame = spark.createDataFrame(list(totals.items()), "__source string, __total long")
        got = {x["__source"]: x["__target"] for x in op.targets(frame).collect()}
        assert got == pytest.approx(goals(totals))


def test_schedule_inversion(spark):
    knots = [0.4, 1.0, 1.6]
    frame = spark.range(0, 11).select((F.col("id") / 10).alias("part"))
    got = [r["t"] for r in frame.select("part", op._inverse_demand(F.col("part"), F.array(*[F.lit(k) for k in knots]), F.array(*[F.lit(k) for k in op.demand(knots)])).alias("t")).orderBy("part").collect()]

    def demand(t):
        steps = 20000
        grid = [(i + 0.5) / steps for i in range(steps)]
        rate = lambda x: knots[0] + (knots[1] - knots[0]) * 2 * x if x < 0.5 else knots[1] + (knots[2] - knots[1]) * (2 * x - 1)
        return sum(rate(x) for x in grid if x < t) / sum(rate(x) for x in grid)

    assert [demand(t) for t in got] == pytest.approx([i / 10 for i in range(11)], abs=1e-3)


def test_reruns_agree(docs):
    key = lambda r: str((r["doc_id"], r["size"], r["__copies"], r["__positions"]))
    assert sorted(map(key, mixed(docs).collect())) == sorted(map(key, mixed(docs.repartition(5)).collect()))


def test_mix_documents(docs, empty):
    out = op.mix_documents(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got and max(got.values()) <= 4  # two copies of each of two identical rows
    sizes, largest = collections.Counter(), collections.Counter()
    for r in out.collect():
        sizes[r["source"]] += len(brute.words(r["text"]))
        largest[r["source"]] = max(largest[r["source"]], len(brute.words(r["text"])))
    for r in mixed(docs).select("source", "__target").distinct().collect():
        assert abs(sizes[r["source"]] - r["__target"]) <= max(largest[r["source"]], 9000 if r["source"] == "src0" else 200)
    assert op.mix_documents(empty).count() == 0


def test_no_python_in_plan(docs, capsys):
    mixed(docs).explain()
    assert "Python" not in capsys.readouterr().out


def test_rows_without_ids_spread(spark, tmp_path):
    """A third of all rows has no id: the query's keys tell them apart, and the source's target is met."""
    rows = [(None if i % 3 else i, f"word{i} " * (1 + i % 7), "src0") for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op.op6(spark, str(tmp_path)).collect()
    assert len(got) == 900
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 7
    hashes = spark.createDataFrame(rows, "doc_id long, text string, source string").select(F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text")), 59).alias("b"))
    assert hashes.groupBy("b").count().agg({"count": "max"}).first()[0] < 90
