import hashlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latchgraph.llm import op9_fingerprints as op


def likeness(a, b):
    x, y = brute.shingles(a, 5), brute.shingles(b, 5)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_edits_and_successors(docs, rows):
    got = op.compare_with_edits(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    texts = [r[1] or "" for r in order]
    want = {}
    for i, r in enumerate(order):
        a, b = texts[i], texts[(i + 1) % len(texts)]
        m = len(a) // 4
        want.setdefault(r[0], []).append((a, a[: len(a) - m] + b[:m], b))
    for r in got:
        fits = [w for w in want[r["doc_id"]] if hashlib.sha256(w[1].encode()).hexdigest() == r["edited_sha256"] and len(w[0]) == r["n_chars"]]
        assert fits
        a, edited, b = fits[0]
        assert r["near_edited"] == pytest.approx(likeness(a, edited), abs=0.2)
        assert r["near_next"] == pytest.approx(likeness(a, b), abs=0.2)
        if len(brute.shingles(a, 5) | brute.shingles(edited, 5)) <= op.SIZE:
            assert r["near_edited"] == likeness(a, edited)


def test_equal_texts_equal_fingerprints(docs):
    seen = {}
    plain = {r["doc_id"]: r["fingerprint"] for r in op.fingerprint(docs).collect()}
    for r in op.compare_with_edits(docs).collect():
        assert plain[r["doc_id"]] == r["fingerprint"]
    for r in docs.join(op.fingerprint(docs).dropDuplicates(["doc_id"]), "doc_id").collect():
        assert seen.setdefault((r["text"] or "").lower(), r["fingerprint"]) == r["fingerprint"]


def test_sketches():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 6000, dtype=np.uint64)
    b = np.concatenate((a[:4000], r.integers(0, 1 << 63, 3000, dtype=np.uint64)))
    x, y = op.sketch(a), op.sketch(b)
    assert (op.merge(op.sketch(a[:2500]), op.sketch(a[2500:])) == x).all()
    assert (op.read(op.write(x)) == x).all()
    assert op.resemblance(x, y) == pytest.approx(4000 / 9000, abs=0.15)
    # hashes fill half of the range here, so that counts come out twice as large
    assert op.distinct(x) == pytest.approx(12000, rel=0.3)
    assert op.containment(op.sketch(a[:4000]), y) == pytest.approx(1.0, abs=0.35)
    few = op.sketches(pa.array(["a b c d e f", "A B c d e", None, "x"]))
    assert [op.distinct(s) for s in few] == [2, 1, 0, 1] and op.containment(few[1], few[0]) == 1.0
    assert op.resemblance(few[2], few[2]) == 1.0 and op.resemblance(few[2], few[3]) == 0.0


def test_one_row_and_empty(spark, empty):
    one = spark.createDataFrame([(5, "one two three four five six")], "doc_id long, text string")
    [r] = op.compare_with_edits(one).collect()
    assert r["near_next"] == 1.0
    assert op.compare_with_edits(empty).count() == 0


def test_rows_without_ids_and_hot_ids(spark):
    """A third has no id and a third has one id: they spread over ranges, and everyone still meets its successor."""
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"text number {i} has some words of its own {i * i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed = op._ranged(frame, 16).filter("not __ahead")
    assert placed.groupBy("__range").count().agg({"count": "max"}).first()[0] < 120
    order = [r["text"] for r in frame.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy(F.col("doc_id").asc_nulls_last(), "h").collect()]
    want = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        m = len(a) // 4
        want.append(hashlib.sha256((a[: len(a) - m] + b[:m]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in op.compare_with_edits(frame).collect()) == sorted(want)
