import brute
import numpy as np
import pytest

from latchgraph.llm import op1_jaccard_join as op


def found(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("shingle, percent", [(3, 90), (5, 80), (1, 60)])
def test_brute_force(docs, rows, shingle, percent):
    assert found(op.classes(docs, shingle, percent)) == brute.components(rows, shingle, percent)


def test_small_sets_by_subsets(spark):
    # sets of 1 to 24 shingles, each with one or two shingles more or less
    texts = [" ".join(f"w{n}x{i}" for i in range(n)) for n in range(1, 25)]
    rows = [(i, t) for i, t in enumerate(t for n, x in enumerate(texts) for t in (x, x + f" y{n}", x + f" y{n} z{n}"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(op.classes(frame, 1, 90)) == brute.components(rows, 1, 90)
    assert op.Scheme(90).most_light() == 18
    many = op.Scheme(90).choose({3: 1000, 9: 1000})
    assert many.boundary >= 3


def test_keys_never_miss():
    # any two sets that link share a key, whatever the boundary
    r = np.random.default_rng(1)
    import pyarrow as pa

    for percent in (60, 80, 90):
        for boundary in (0, op.Scheme(percent).most_light()):
            scheme = op.Scheme(percent, boundary)
            for _ in range(60):
                n = int(r.integers(1, 80))
                base = [f"w{x}" for x in r.integers(0, 10**6, n)]
                other = list(base)
                for _ in range(int(r.integers(0, max(2, n // 6)))):
                    if r.random() < 0.5 and other:
                        other.pop(int(r.integers(0, len(other))))
                    else:
                        other.append(f"n{r.integers(0, 10**6)}")
                a, b = set(base), set(other)
                sets = op.Sets(pa.array([" ".join(base), " ".join(other)]), 1)
                keys, of = scheme.keys(sets, np.array([i for i in (0, 1) if sets.size[i]]))
                if b and 100 * len(a & b) >= percent * len(a | b):
                    assert set(keys[of == 0]) & set(keys[of == 1])


def test_links_across_stars(spark):
    # a chain of documents each of which links with the next only
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((100 - i, " ".join(f"c{j}" if j < i * 9 else base[j] for j in range(200))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(op.classes(frame, 1, 90)) == brute.components(rows, 1, 90)


def test_hot_group(spark):
    # a third of all rows are one text; most others share a line
    rows = [(i, "same text for very many rows of this table") if i % 3 == 0 else (i, "a line that all rows share here " + " ".join(f"{i}w{j}" for j in range(40))) for i in range(900)]
    got = found(op.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90))
    assert [g for g in got if g[0] % 3 == 0] == sorted(((i, 7, 0) for i in range(0, 900, 3)), key=str)
    assert all(g[2] == g[0] for g in got if g[0] % 3)


def test_keep_one(docs, rows):
    kept = op.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute.components(rows, 5, 80) if i is not None and i == c}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_keep_rows(spark):
    # rows without an id, and different texts under one id, stay unless they are near copies
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(1, text("a")), (None, text("b")), (None, text("c")), (None, text("a") + " x"), (2, text("d")), (2, text("e")), (2, text("a") + " y"), (2, text("d"))]
    rows += [(None, text("f")), (None, text("f")), (None, ""), (3, None), (9, text("g")), (4, text("g") + " z"), (4, text("h"))]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, component_id int")
    out = op.keep_rows(frame, 5, 80)
    assert out.columns == frame.columns
    want = [(1, text("a")), (None, text("b")), (None, text("c")), (2, text("d")), (2, text("e")), (None, text("f")), (None, ""), (3, None), (4, text("g") + " z"), (4, text("h"))]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_pipeline_keeps_rows_without_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    frame = spark.createDataFrame([(None, "a text of its own that no other row has"), (1, "words of another text altogether, also alone")], "doc_id long, text string")
    assert dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, frame, "").count() == 2


def test_empty(empty):
    assert op.classes(empty).count() == 0 and op.keep_one(empty).count() == 0
