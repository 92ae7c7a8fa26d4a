import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from latchgraph.llm.op13_source_divergence import counts, divergence, op13, share, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, chunk int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, min_docs, top=10):
    by, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        by[lang, source].update(words(text))
        docs[lang].update(set(words(text)))
    out = []
    for lang in {k[0] for k in by}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in by if x == lang]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        ps = {s: shares(by[lang, s]) for s in sources}
        q = shares(sum((by[lang, s] for s in sources), Counter()))
        for s in sources:
            ranked = sorted((-sum((ps[s][t] - ps[o][t]) ** 2 // (ps[s][t] + ps[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(ranked, 1)]
            ranked = sorted((-((ps[s][t] - q[t]) ** 2 // (ps[s][t] + q[t])), t.encode()) for t in kept if by[lang, s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(ranked, 1)]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def some():
    r = random.Random(6)
    stems = ["the", "The", "of", "äé", "中文", "ＡＢ", "\U0001f600x", "z", "É", "zz", "é"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for _ in range(400):
        text = "".join(r.choice(stems) + r.choice((" ", "  ", "-1_", "\x00", ".\n", " ")) for _ in range(r.choice((0, 1, 5, 30))))
        rows.append((r.choice((text, text, text, None, "")), r.choice(("en", "en", "en", "fr", None)), r.choice(("a", "a", "a", "b", "é", "ｚ", "\U0001f600", None))))
    rows += [("1 2 3", "xx", "p"), (None, "xx", "q"), ("alone", "yy", "only"), ("A" * 70_000 + " the", "en", "a")] * 3
    return rows


@pytest.fixture(scope="module")
def frame(spark, some):
    return spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(some)], SCHEMA).repartition(5)


def test_terms():
    texts = pa.array(["Ab-cÉ\x00d", None, "", "12", "é", "x", " "])
    at, terms = terms_of(texts)
    assert list(zip(at.tolist(), terms.to_pylist(), strict=True)) == [(0, "ab"), (0, "cÉ"), (0, "d"), (4, "é"), (5, "x"), (6, " ")]
    assert terms_of(texts.slice(4, 2))[1].to_pylist() == ["é", "x"]


def test_share_does_not_overflow():
    n, total, kept = 9 * 10**14, 9 * 10**15 // 4, 10**12
    assert share(np.array([n, 0]), total, kept).tolist() == [1 + 10**9 * (x + 2) // (total + 2 * kept) for x in (n, 0)]


def test_groups_without_terms_are_counted(frame, some):
    got = {(r.lang, r.source) for r in counts(frame).filter("term IS NULL").collect()}
    assert got == {(lang or "", source or "") for _, lang, source in some}


@pytest.mark.parametrize(("min_docs", "chunk", "block"), [(10, 16_384, 64), (1, 7, 2), (3, 5, 1), (10_000, 5, 64)])
def test_equals_brute_force(frame, some, min_docs, chunk, block):
    """Also with chunks of few terms and blocks of few sources, and where no term is kept."""
    assert found(divergence(frame, min_docs=min_docs, chunk_size=chunk, block=block)) == plain(some, min_docs)


def test_query_over_odd_rows(spark, docs, tmp_path):
    docs.unionByName(docs).write.parquet(f"{tmp_path}/documents.parquet")
    all_rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()] * 2
    assert found(op13(spark, str(tmp_path))) == plain(all_rows, 10)


def test_empty(spark, empty):
    assert divergence(empty).collect() == []
