import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latchgraph.llm import op8_exact_topk as op


def brute(rows, top=5, step=50):
    """A list for each distinct query vector of an id."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good}:
        if q % step == 0:
            ranked = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)))[:top]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = op.search(frame, F.col("vec_id") % 50 == 0, **more).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


@pytest.mark.parametrize("block, pivots", [(7, 5), (2048, 64), (1, 1)])
def test_brute_force(spark, block, pivots):
    r = np.random.default_rng(4)
    rows = [(i, [round(float(x), 3) for x in r.normal(size=8) * (0.1 if i % 2 else 1)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # many copies: ties go to the smaller id
    assert found(spark, rows, block=block, pivots=pivots) == brute(rows)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (50, [0.5, -0.5]), (50, [0.5, 0.25]), (7, [-1.0, 0.001]), (None, [1.0, 1.0])]
    assert found(spark, rows) == brute(rows)


def test_large_values(spark):
    rows = [(i, [3e6 + i, -1e5 * i, 1e6 / (i + 1)]) for i in range(60)]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(OverflowError):
        op.products(np.array([[1e12]]), np.array([[1e12]]))


def test_pruning_keeps_the_best(spark):
    # groups far apart: most are pruned, and the result stays whole
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=6) * 0.05 + (i % 10) * 3]) for i in range(300)]
    assert found(spark, rows, pivots=10) == brute(rows)
    centre = np.array([[0.0, 0.0], [100.0, 0.0], [-100.0, 0.0]])
    groups = op.Groups(centre, np.array([1.0, 1.0, 1.0]), np.array([1.0, 101.0, 101.0]), np.array([10, 10, 10]), np.array([1, 1, 1]))
    assert op._needed(np.array([[1.0, 0.0]]), groups, 5).tolist() == [[False, True, False]]
    # ten rows equal to a pivot score for sure what it scores, however wide its group is
    wide = groups._replace(radius=np.array([1.0, 300.0, 1.0]), length=np.array([1.0, 400.0, 101.0]), equal=np.array([1, 10, 1]))
    assert op._needed(np.array([[1.0, 0.0]]), wide, 5).tolist() == [[False, True, False]]


@pytest.mark.parametrize("pivots", [1, 5, 64, None])
def test_all_rows_of_few_ids(spark, pivots):
    r = np.random.default_rng(6)
    rows = [(50, [float(x) for x in r.normal(size=4)]) for _ in range(30)]
    assert found(spark, rows, pivots=pivots) == brute(rows) == []
    rows += [(i, [float(x) for x in r.normal(size=4)]) for i in (1, 100, 100)]
    assert found(spark, rows, pivots=pivots) == brute(rows)


@pytest.mark.parametrize("copies", [2, 5, 6, 9])
def test_repeated_query_rows(spark, copies):
    # each vector is its own pivot; the query's own rows score best and are no candidates
    rows = [(50, [10.0, 0.0])] * copies + [(i, [9.0 - 0.2 * i, 0.1 * i]) for i in range(1, 30)]
    assert found(spark, rows) == brute(rows)


def test_query_id_with_different_vectors(spark):
    rows = [(50, [10.0 - 0.1 * i, 0.0]) for i in range(7)] + [(i, [9.0 - 0.2 * i, 0.1 * i]) for i in range(1, 30)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
