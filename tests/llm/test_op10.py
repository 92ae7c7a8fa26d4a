import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latchgraph.llm import op10_language_id as op


def predicted(docs):
    return op.predict(docs, op.fit(op.training_rows(docs)), ["doc_id"])


def test_held_out_accuracy(docs, rows):
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 1000 and len(r[1]) > 20}
    got = {r["doc_id"]: r for r in predicted(docs).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_undetermined(docs):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predicted(docs).collect()}
    for i in (1000, 1001, 1002, 1005):
        assert got[i] == ("und", 0.0)
    assert got[1003][0] != "und" and got[1007][0] != "und"


def test_labels_are_no_input(docs):
    model = op.fit(op.training_rows(docs))
    swapped = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    key = lambda r: str(r)
    assert sorted(op.predict(docs, model, ["doc_id"]).collect(), key=key) == sorted(op.predict(swapped, model, ["doc_id"]).collect(), key=key)


def test_nothing_to_learn(docs, empty):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in predicted(bare).collect()} == {"und"}
    assert predicted(empty).count() == 0


def test_keep_identified(docs):
    kept = op.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {1000, 1001, 1002, 1005}
    assert len([i for i in ids if i is not None and i < 1000]) >= 110


def test_repeated_rows_do_not_lift_the_bound(spark):
    rows = [(None, "der hund und die katze", "de")] * 300 + [(None, f"the cat and dog {i}", "en") for i in range(200)] + [(7, "il gatto e il cane", "it")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = []
    plain = op.train
    try:
        op.train = lambda made, langs, idf: taken.append((len(made), langs)) or plain(made, langs, idf)
        model = op.fit(docs, per_lang=20)
    finally:
        op.train = plain
    # one distinct German and Italian document, and the bound of English ones
    assert taken == [(22, ["de", "en", "it"])]
    assert {r["lang_pred"] for r in op.predict(docs, model, ["doc_id"]).filter("lang_pred != 'und'").collect()} <= {"de", "en", "it"}


def test_training_agrees_with_plain_loops():
    """FTRL-proximal, written out coordinate by coordinate."""
    r = np.random.default_rng(3)
    k, d = 3, 12
    rows = []
    for i in range(60):
        y = i % k
        index = np.sort(r.choice(d, 4, replace=False)) if i % 4 else np.array([y, 5 + y])
        rows.append((index, r.random(len(index)), y))
    alpha, beta, l1, l2 = 0.7, 1.0, 0.05, 0.1
    model = op.train(rows, ["a", "b", "c"], np.ones(d), epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n = [[0.0] * k for _ in range(d + 1)], [[0.0] * k for _ in range(d + 1)]

    def weight(i, c):
        return 0.0 if abs(z[i][c]) <= l1 else -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    for _ in range(2):
        for j, (index, value, y) in enumerate(rows):
            if j % 5 == 4:
                continue
            x = [*zip(index.tolist(), value.tolist()), (d, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in x for c in range(k)}
            scores = [sum(v * w[i, c] for i, v in x) for c in range(k)]
            e = [math.exp(s - max(scores)) for s in scores]
            for i, v in x:
                for c in range(k):
                    g = (e[c] / sum(e) - (c == y)) * v
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * w[i, c]
                    n[i][c] += g * g
    got = np.vstack([model.weights, model.bias])
    assert np.allclose(got, [[weight(i, c) for c in range(k)] for i in range(d + 1)], atol=1e-5)


def test_temperature_is_the_best_of_a_grid():
    r = np.random.default_rng(8)
    truth = r.integers(0, 3, 200)
    logits = r.normal(size=(200, 3)) * 4
    logits[np.arange(200), truth] += 1.5
    t = op._temperature(logits, truth)

    def loss(t):
        p = op._softmax(logits / t)
        return -np.log(p[np.arange(200), truth]).mean()

    assert loss(t) <= min(loss(x) for x in np.exp(np.linspace(-2.5, 2.5, 200))) + 2e-3
    assert op._temperature(np.zeros((0, 3)), np.zeros(0, int)) == pytest.approx(1.0)


def test_only_the_commonest_languages_are_learned(spark):
    """Hundreds of values that stand in few rows each leave the sample bounded."""
    rows = [(i, "the of and", "en") for i in range(30)] + [(100 + i, "der und ein", "de") for i in range(20)] + [(1000 + i, f"junk {i}", f"x{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op.fit(docs, max_langs=2)
    assert model.langs == ["de", "en"]
