import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from latchgraph.llm.op12_piece_encoding import SPACE, Encoder, Vocabulary, decode, encode, model_path, op12


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(model_path()))


def awkward(library):
    r = random.Random(4)
    pieces = [library.id_to_piece(i).replace(SPACE, " ") for i in range(259, library.get_piece_size())]
    texts = ["", " ", "  ", " " * 33 + "x" + " " * 17, "\n", "\n\n a\tb\r\n", "\x00<s></s><unk><0x0A>", f"{SPACE}{SPACE}a{SPACE}", "ﬁ　é​\U0001f600中文梦", "a" * 500, " \n \n  ", "�"]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(400)]
    texts += ["".join(r.choice(f"ab \n\r\t{SPACE}éßв中的=-_*/(){{}};012'\"") for _ in range(r.randint(1, 60))) for _ in range(800)]
    texts += ["".join(r.choice(" tehn") for _ in range(r.randint(1, 60))) for _ in range(800)]
    texts += ["".join(chr(r.choice((r.randrange(32, 0x3000), r.randrange(0xE000, 0x110000)))) for _ in range(30)) for _ in range(100)]
    return texts


def test_ids_and_texts_of_the_library(library, encoder):
    for text in awkward(library):
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert encoder.vocabulary.decode(ids) == library.decode(ids.tolist())


def test_any_ids_decode(library, encoder):
    r = random.Random(2)
    for _ in range(600):
        ids = [r.choice((r.randrange(300), r.randrange(32000))) for _ in range(r.randint(1, 12))]
        assert encoder.vocabulary.decode(np.array(ids)) == library.decode(ids)
    with pytest.raises(ValueError):
        encoder.vocabulary.decode(np.array([32000]))


def test_last_piece_of_every_prefix(library, encoder):
    text = f"{SPACE}thenstationes=();ation{SPACE}{SPACE}{SPACE}andx中"
    last = encoder.last_pieces(text)
    for i in range(1, len(text) + 1):
        pieces = library.encode(text[1:i], out_type=str) if i > 1 else [SPACE]
        if not pieces[-1].startswith("<0x"):
            assert last[i] == pieces[-1]


def test_pair_test_is_what_the_encoder_does(encoder):
    """Against joining the concatenation step by step."""
    r = random.Random(8)
    pieces = [p for p in encoder.score if encoder.joins(p) and 0 < len(p) < 6]

    def joined(text):
        symbols = list(text)
        while True:
            scores = [encoder.score.get(a + b, -np.inf) for a, b in zip(symbols[:-1], symbols[1:], strict=True)]
            if not scores or max(scores) == -np.inf:
                return symbols
            at = scores.index(max(scores))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    kept = 0
    for _ in range(4000):
        a, b = r.choice(pieces), r.choice(pieces)
        assert encoder.compatible(a, b) == (joined(a + b) == [a, b])
        kept += encoder.compatible(a, b)
    assert 0 < kept < 4000


def test_long_text_without_cuts_in_linear_work(library, encoder):
    r = random.Random(3)
    text = "".join(r.choice("tehnabc") for _ in range(60_000))
    assert encoder.encode(text).tolist() == library.encode(text)


def test_few_kept_units(library, monkeypatch):
    monkeypatch.setattr("latchgraph.llm.op12_piece_encoding._UNITS", 5)
    monkeypatch.setattr("latchgraph.llm.op12_piece_encoding._PAIRS", 20)
    small = Encoder(Vocabulary(model_path()))
    for text in awkward(library)[:200]:
        assert small.encode(text).tolist() == library.encode(text)
    assert len(small.known) <= 5 and len(small.older) <= 5


def test_query_over_odd_rows(spark, docs, rows, library, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, op12(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_interface_keeps_rows_and_columns(spark, docs, rows, library):
    """Other columns stay; ones named as the results are replaced; ids go back to texts."""
    both = decode(encode(docs.withColumnRenamed("size", "ids").withColumnRenamed("__row", "__from"), model_path()), model_path(), text="component_id")
    assert sorted(both.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "component_id", "ids"])
    found = both.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == library.encode(r.text or "") and r.component_id == (r.text or "").replace(SPACE, " ")


def test_empty(spark, empty):
    assert decode(encode(empty, model_path()), model_path()).collect() == []
