import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from latchgraph.llm import op3_packing as op

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op.tokenizer_path())


def check(rows, got, plain, capacity=op.CAPACITY):
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r[0]].append([*plain.encode(r[1] or "", add_special_tokens=False).ids, 2])
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, copies in ids.items():
        # every copy of a document is cut into pieces that cover it once
        assert sum(p[1] for p in pieces[i]) == sum(map(len, copies))
        for start, length, crc, total in pieces[i]:
            assert any(len(c) == total and zlib.crc32(np.array(c[start : start + length], "<u4").tobytes()) == crc for c in copies)
        if len(copies) == 1:
            at = 0
            for start, length, *_ in sorted(pieces[i]):
                assert start == at
                at += length
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        # nothing is padded: full, or a power of two
        assert at == capacity or at & (at - 1) == 0


def test_round_trip(docs, rows, plain):
    check(rows, op.pack(docs, op.tokenizer_path()).collect(), plain)


def test_small_windows(docs, rows, plain):
    check(rows, op.pack(docs, op.tokenizer_path(), capacity=64, windows=3, fan_in=2).collect(), plain, 64)


def test_bounded_windows():
    packer = op.Packer(0, 100, 4)
    r = random.Random(1)
    for i in range(500):
        packer.add(i, np.arange(r.randint(1, 150), dtype=np.uint32))
        assert len(packer.open) <= 4


def test_units_are_exact(plain):
    r = random.Random(5)
    signs = "abzAZ09'.,|<>-_é́ÈßñçŁ×÷—\u00a0\u2003 \t\n\r\x0b\x1c\x85½²٣中文İıſΣς😀'st"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["a<|startoftext|>b <|endoftext|>", "don't I'M we'll x's,'s", "", "É,Û.ß;"]
    encoder = op.UnitEncoder(op.tokenizer_path())
    for i in range(0, len(texts), 50):
        part = texts[i : i + 50]
        got = encoder.encode(pa.array(part))
        assert [g.tolist() for g in got] == [[*e.ids, 2] for e in plain.encode_batch(part, add_special_tokens=False)]


def test_empty(empty):
    assert op.pack(empty, op.tokenizer_path()).count() == 0
