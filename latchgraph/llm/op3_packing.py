"""Bounded-space online packing of token sequences.

Every partition keeps at most ``windows`` open windows of ``capacity`` tokens.  A document's tokens
beyond whole windows go best-fit into the open window with the least room that still holds them; when
none does and no window may be opened, the document is cut to fill the fullest window, which is
emitted.  At the end a partition joins its open windows, leaving one partial window; the partial
windows of ``fan_in`` partitions are joined in a second step, and what is left is cut at powers of two,
so nothing is padded.

Tokenising: the vocabulary lower-cases text and splits it at white space, between letters and other
signs, and around digits, so each unit between such places is encoded once per worker and looked up
afterwards (64-bit hash of its lower-cased bytes, at most ``_UNITS`` kept).  Places beside an apostrophe
(contractions) and beside most non-ASCII signs are left to the tokenizer, as are texts that may hold
the string of a special token.

Defined cases: a null or empty text gives the end token alone; repeated rows are packed once each; a
null doc_id is carried along; a text of any length is cut; of windows with equal room the one opened first is
taken; columns other than doc_id and text are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import cut, table
from ._words import Words, pieces

CAPACITY = 4096
WINDOWS = 16
FAN_IN = 256
END = 2
_UNITS = 1_000_000
_AT_ONCE = 4096

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 ASCII sign; 0 for the apostrophe, white space and non-ASCII
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[ord("'")] = 0


def unit_cuts(data: np.ndarray) -> np.ndarray:
    """True before bytes at which the tokenizer splits as well, whatever stands around them."""
    kind = _KIND[data]
    # the second byte of a two-byte letter of U+00C0 to U+017F ends a letter; without the two signs among
    # them and U+0130, whose lower case ends in a combining dot
    ends = kind.copy()
    lead = (data >= 0xC3) & (data <= 0xC5)
    latin = np.zeros(len(data), bool)
    latin[1:] = lead[:-1] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))) & ~((data[:-1] == 0xC4) & (data[1:] == 0xB0))
    ends[latin] = 1
    out = np.zeros(len(data), bool)
    left, right = ends[:-1], kind[1:]
    out[1:] = (left > 0) & (right > 0) & ((left != right) | (left == 2))
    return out


class UnitEncoder:
    """Token ids of texts through a bounded table of white-space-free units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, words: Words, hashes: np.ndarray, sample: np.ndarray) -> None:
        if len(self.known) + len(hashes) > _UNITS:
            self._clear()
        data = words.data
        lengths, parts = [], [self.ids]
        # few at once: the tokenizer's own records are far larger than the ids
        for i in range(0, len(sample), _AT_ONCE):
            some = sample[i : i + _AT_ONCE]
            units = [data[b:e].tobytes().decode("utf-8") for b, e in zip(words.begin[some].tolist(), words.end[some].tolist(), strict=True)]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts.append(np.fromiter((i for x in found for i in x), np.uint32, int(lengths[-1].sum())))
        length = np.concatenate(lengths)
        place = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate(parts)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, place)
        self.length = np.insert(self.length, at, length)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text with the end token after them."""
        plain = any("<|" in x for x in texts.to_pylist() if x)
        words = Words(texts, lower=not plain, split=None if plain else unit_cuts)
        unique, sample, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        there = np.zeros(len(unique), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] == unique
        if not there.all():
            size = len(self.known)
            self._learn(words, unique[~there], sample[~there])
            if len(self.known) < size + (~there).sum():  # the table was cleared
                return self.encode(texts)
            at = np.searchsorted(self.known, unique)
        length, place = self.length[at][back].astype(np.int64), self.place[at][back].astype(np.int64)
        ends = np.cumsum(length)
        flat = self.ids[np.repeat(place - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[words.first]
        out = np.full(len(flat) + len(texts), END, np.uint32)
        number = np.diff(bounds)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), number)] = flat
        cuts = bounds + np.arange(len(bounds))
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Packer:
    """Open windows of one partition; ``emit`` collects the pieces of finished sequences."""

    def __init__(self, base: int, capacity: int = CAPACITY, windows: int = WINDOWS):
        self.base, self.capacity, self.windows = base, capacity, windows
        self.open: list[list] = []  # [free, pieces]
        self.emit: list[tuple] = []
        self.number = 0

    def _finish(self, content: list[tuple], left: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in content:
            crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
            self.emit.append((doc_id, start, len(ids), crc, total, self.base + self.number, offset, ids.astype("<u4").tobytes() if left else None))
            offset += len(ids)
        self.number += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._finish([(doc_id, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        while at < total:
            need = total - at
            fitting = [w for w in self.open if w[0] >= need]
            if fitting:
                window = min(fitting, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                window = [self.capacity, []]
                self.open.append(window)
            else:
                window = min(self.open, key=lambda w: w[0])
            part = ids[at : at + window[0]]
            window[1].append((doc_id, at, part, total))
            window[0] -= len(part)
            at += len(part)
            if not window[0]:
                self.open.remove(window)
                self._finish(window[1])

    def join(self) -> list[tuple]:
        """Joins the open windows, fullest first; returns the pieces of the one that stays partial."""
        held: list[tuple] = []
        room = self.capacity
        for _, content in sorted(self.open, key=lambda w: w[0]):
            for doc_id, start, ids, total in content:
                at = 0
                while at < len(ids):
                    part = ids[at : at + room]
                    held.append((doc_id, start + at, part, total))
                    at += len(part)
                    room -= len(part)
                    if not room:
                        self._finish(held)
                        held, room = [], self.capacity
        self.open = []
        return held

    def last(self, held: list[tuple]) -> None:
        """Cuts what is left into sequences of powers of two."""
        size = sum(len(x[2]) for x in held)
        while size:
            room = 1 << (size.bit_length() - 1)
            size -= room
            content = []
            while room:
                doc_id, start, ids, total = held.pop(0)
                content.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    held.insert(0, (doc_id, start + room, ids[room:], total))
                room -= len(content[-1][2])
            self._finish(content)


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left_ids binary, part long"


def _batches(rows: list[tuple], part: int, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)), pa.array([part] * len(rows), pa.int64())], schema=schema)


_ENCODERS: dict[str, UnitEncoder] = {}


def _arrow_schema(id_type: pa.DataType) -> pa.Schema:
    longs = [pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    return pa.schema([pa.field("doc_id", id_type), *longs, pa.field("left_ids", pa.binary()), pa.field("part", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece of a document's tokens; ``tokenizer`` is the path of a vocabulary file."""
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, UnitEncoder(tokenizer))
        part = TaskContext.get().partitionId()
        packer, schema = Packer(part << 32, capacity, windows), None
        for batch in batches:
            schema = schema or _arrow_schema(batch.schema.field(0).type)
            for piece in pieces(batch, "text"):
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1)), strict=True):
                    packer.add(doc_id, ids)
            yield _batches(packer.emit, part, schema)
            packer.emit = []
        if schema:
            if held := packer.join():
                packer._finish(held, left=True)
            yield _batches(packer.emit, part, schema)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group, schema = None, None, None
        for batch in batches:
            schema = batch.schema
            for r in batch.to_pylist():
                if r["part"] // fan_in != group:
                    if packer:
                        packer.last(packer.join())
                        yield _batches(packer.emit, group, schema)
                    group = r["part"] // fan_in
                    packer = Packer((1 << 62) | (group << 32), capacity, 1)
                # whole partial windows follow each other; join() cuts them
                packer.open.append([0, [(r["doc_id"], r["start"], np.frombuffer(r["left_ids"], "<u4"), r["doc_tokens"])]])
        if packer:
            packer.last(packer.join())
            yield _batches(packer.emit, group, schema)

    schema = _schema(id_type)
    packed = cut(docs.select("doc_id", "text").mapInArrow(first, schema))
    rest = packed.filter(F.col("left_ids").isNotNull())
    rest = rest.withColumn("__group", F.floor(F.col("part") / fan_in)).repartition("__group").sortWithinPartitions("__group", "part", "offset").drop("__group")
    return packed.filter(F.col("left_ids").isNull()).unionByName(rest.mapInArrow(second, schema)).drop("left_ids", "part")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
