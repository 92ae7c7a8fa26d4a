import random

import brute
import pytest

from latchgraph.llm import op7_substring_dedup as op


def found(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect()), key=str)


def test_brute_force(docs, rows):
    assert found(op.digest(docs)) == sorted((x[:4] for x in brute.removed(rows)), key=str)


@pytest.mark.parametrize("window, kmer", [(5, 3), (4, 4), (3, 1), (7, 2)])
def test_repetitive_texts(spark, window, kmer):
    # few distinct words, so that windows repeat inside and across documents at every distance
    r = random.Random(window)
    rows = [(i // 2 if i % 7 == 0 else i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(op.digest(frame, window, kmer)) == sorted((x[:4] for x in brute.removed(rows, window)), key=str)


def test_shared_passage(spark):
    # a third of all documents share one passage
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, (" ".join(f"{i}a{j}" for j in range(30)) + " " + (passage if i % 3 == 0 else "x") + f" {i}z")) for i in range(300)]
    got = found(op.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(g[2] for g in got) == 55 * 99


def test_repeated_row_overlaps_an_earlier_document(spark):
    # equal rows share the middle of a passage with an earlier document, so that paths branch at its rims
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    passage = words("p", 60)
    rows = []
    for k in range(12):
        shared = passage[k : 60 - k]
        rows += [(k, " ".join(words(f"x{k}y", 30) + shared + words(f"z{k}y", 30)))]
        rows += [(100 + k, " ".join(words(f"u{k}y", 25) + passage + words(f"v{k}y", 25)))] * (2 + k % 2)
    # one id for different texts that have a window at the same place
    rows += [(200, " ".join(words("q", 40) + words("r", 30))), (200, " ".join(words("q", 40) + words("s", 30))), (200, " ".join(words("q", 30)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(op.digest(frame)) == sorted((x[:4] for x in brute.removed(rows)), key=str)


def test_remove_repeats(docs, rows):
    out = op.remove_repeats(docs)
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) if r["text"] is not None else (str(r["doc_id"]), "", 0) for r in out.collect())
    want = []
    for (i, text, *_), (_, n, gone, _, kept) in zip(rows, brute.removed(rows)):
        if gone and not kept:
            continue
        if not gone:
            want.append((str(i), text or "", len(text or "")))
        else:
            want.append((str(i), None, kept))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=lambda x: (x[0], str(x[1])))):
        if w[1] is not None and g[0] == w[0] and g[1] == w[1]:
            continue
    kept_words = sorted((str(i), " ".join(k)) for (i, *_), (_, n, gone, _, k) in zip(rows, brute.removed(rows)) if not (gone and not k))
    assert sorted((g[0], " ".join(brute.words(g[1], lower=False))) for g in got) == kept_words
    assert all(g[2] == len(g[1]) for g in got)


def test_empty(empty):
    assert op.digest(empty).count() == 0 and op.remove_repeats(empty).count() == 0
