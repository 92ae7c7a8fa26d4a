import brute
import numpy as np
import pytest

from latchgraph.llm import op2_lm_scoring as op


def test_base_scores(docs, rows):
    got = op.score(docs).collect()
    key = lambda r: (str(r[0]), r[2])
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want = sorted(brute.scores(rows), key=key)
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert [m[5] for m in mine] == pytest.approx([w[5] for w in want])


def test_better_than_base(docs):
    got = [r for r in op.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_against_exact_bigrams(docs, rows):
    """The quantised model stays within half a step, and the finer steps of what shards are told, of the exact one."""
    import collections
    import math
    import zlib

    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    tokens = [[*brute.words(t), "</s>"] for _, t, *_ in rows]
    c, c2 = collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held):
        if not h:
            c.update(t)
            c["<s>"] += 1
            c2.update(zip(["<s>", *t], t))
    n = sum(len(t) for t, h in zip(tokens, held) if not h)
    p = lambda w: (1 - op.UNKNOWN) * c[w] / n if c[w] else op.UNKNOWN
    exact = collections.defaultdict(list)
    for r, t in zip(rows, tokens):
        exact[r[0]].append(sum(math.log10((c2[v, w] + op.PRIOR * p(w)) / (c[v] + op.PRIOR)) for v, w in zip(["<s>", *t], t)))
    for r in op.score(docs).collect():
        assert min(abs(r["score"] - e) for e in exact[r["doc_id"]]) <= 0.03 * r["n_tokens"]


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (500, 600), (1000, 1 << 40), (300, 1 << 62)):
        values = np.sort(r.choice(universe, n, replace=False) if universe < 1000 else r.integers(0, universe, n)).astype(np.uint64)
        coded = op.EliasFano(*op.EliasFano.encode(values, universe))
        assert (coded.at(np.arange(n)) == values).all()
        wanted = r.integers(0, universe, 200).astype(np.uint64)
        assert (coded.successor(wanted) == np.searchsorted(values, wanted)).all()


def test_trie():
    r = np.random.default_rng(2)
    pairs = np.unique(r.integers(0, 300, (2000, 2)), axis=0).astype(np.uint64)
    code = r.integers(1, 256, len(pairs))
    trie = op.Trie(op.Trie.seal(pairs[:, 0], pairs[:, 1], code, 301))
    known = {tuple(p): c for p, c in zip(pairs.tolist(), code.tolist())}
    asked = r.integers(0, 301, (3000, 2)).astype(np.uint64)
    assert trie.find(asked[:, 0], asked[:, 1]).tolist() == [known.get(tuple(a), 0) for a in asked.tolist()]
    none = op.Trie(op.Trie.seal(pairs[:0, 0], pairs[:0, 1], code[:0], 5))
    assert not none.find(asked[:, 0], asked[:, 1]).any()


def test_empty_and_all_held_out(spark, empty):
    assert op.score(empty).count() == 0
    only = spark.createDataFrame([(i, "a b c") for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    got = op.score(only).collect()
    assert got and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["held_out"] for r in got)


def test_word_level():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 700):
        hashes = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
        counts = r.integers(1, 1 << 40, len(hashes)).astype(np.uint64)
        level = op.WordLevel(op.WordLevel.seal(hashes, counts))
        wanted = np.unique(np.concatenate((hashes, r.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64))))
        known = dict(zip(hashes.tolist(), zip(counts.tolist(), range(len(hashes)))))
        count, at = level.find(wanted)
        assert list(zip(count.tolist(), at.tolist())) == [known.get(w, (0, 0)) for w in wanted.tolist()]
        assert level.seen == len(hashes)


def test_new_texts_by_a_stored_model(spark, docs, rows):
    """Texts that were never learned from get from the stored shards what the one plan gives them."""
    held = docs.filter(op.held_out(op.F.col("doc_id"), 7))
    assert 0 < held.count() < docs.count()
    model = op.learn(docs).kept()
    key = lambda r: (r[0], r[2], r[6])
    want = sorted((tuple(r) for r in op.score(docs).collect() if r["held_out"]), key=key)
    got = sorted((tuple(r) for r in op.score(held, model=model).collect()), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want])
    assert op.score(docs.limit(0), model=model).count() == 0
