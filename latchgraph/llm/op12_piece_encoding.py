"""Encoding and decoding with a merge-type piece vocabulary through a table of prefixes.

The vocabulary's encoder joins, again and again, the two neighbouring symbols whose join is the piece of the
highest score (the leftmost of equals).  What it makes of a text is the only sequence of pieces in which each piece encodes to itself and
each two neighbours encode to themselves: a join across a place never happens iff it does not happen among the two
pieces that meet there.  So every prefix of a text has one last piece, the only match that ends there and is compatible with the
last piece of the prefix before it.  For each place the automaton of all pieces gives the matches that end there, the pair test
leaves one, and the ids are read from the end backwards; the work grows with the text's length.

The pair test replays both pieces' own joins in the order in which the encoder makes them and asks whether, at some
moment, a join across their border would come first.  Characters that are no piece stand for themselves in the
table and become their bytes' pieces (or the unknown id).

Texts are cut where no piece can cross: between two characters of which the left one, or the pair, stands
inside no piece.  In this vocabulary that is before white space that follows other characters, and around line
ends.  A worker keeps the ids of units that it has met, at most twice ``_UNITS`` of up to ``_UNIT_CHARS``
characters, and the answers to at most ``_PAIRS`` pair tests.

Nothing is shuffled.  Decoding is a gather of the pieces' bytes.

Defined cases: a null or empty text has no ids and decodes to an empty text; ids outside the vocabulary are an error; texts of any
length are encoded whole; rows keep their order and number, repeated ones as well; a null doc_id is carried along; all columns stay, but
columns named as the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import table
from ._words import give_back, pieces

SPACE = "▁"
_UNITS = 250_000
_PAIRS = 1_000_000
_UNIT_CHARS = 64


class Vocabulary:
    """Pieces, scores and kinds of a model file of the merge type without text normalisation."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(raw)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        spec = model.normalizer_spec
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        others = {kind.USER_DEFINED, kind.UNUSED} & {p.type for p in model.pieces}
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not plain or others:
            raise ValueError(f"{path}: only merge-type models that leave the text as it is, without pieces of the user, are supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.bytes = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        surface = {i: p.piece.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)}
        surface |= {i: b"" for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        surface[self.unknown] = model.trainer_spec.unk_surface.encode() or " ⁇ ".encode()
        surface |= {i: bytes([b]) for b, i in by_byte.items()}
        #: whether ids may stand for incomplete characters, and whether the first piece loses its leading space
        self.single = np.zeros(len(surface), bool)
        self.single[list(by_byte.values())] = True
        self.spaced = np.array([p.piece.startswith(SPACE) and p.type == kind.NORMAL for p in model.pieces])
        self.length = np.array([len(surface[i]) for i in range(len(surface))], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.surface = np.frombuffer(b"".join(surface[i] for i in range(len(surface))), np.uint8)
        del sentencepiece

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; bytes that form no character become U+FFFD, each for itself."""
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.length):
            raise ValueError("an id lies outside the vocabulary")
        sizes, begins = self.length[ids], self.begin[ids]
        if self.prefix and (said := np.flatnonzero(sizes > 0)).size and self.spaced[ids[said[0]]]:
            begins[said[0]] += 1
            sizes[said[0]] -= 1
        ends = np.cumsum(sizes)
        data = self.surface[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()
        if not self.single[ids].any():
            return data.decode()
        return "".join(_lenient(data[a:b]) for a, b in self._runs(ids, ends, sizes))

    def _runs(self, ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Bytes of runs of single-byte ids, and of the ids between them: a character never reaches over their borders."""
        cuts = np.flatnonzero(np.diff(self.single[ids])) + 1
        starts = ends - sizes
        yield from zip([0, *starts[cuts].tolist()], [*starts[cuts].tolist(), int(ends[-1])], strict=True)


def _lenient(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[at : at + e.start].decode() + "�")
                at += e.start + 1
        return "".join(out)


class _First(dict):
    """Stands before a text's first piece: every piece may begin it."""

    def get(self, piece, default=None):
        return True


class Encoder:
    """Ids of texts by the prefix table."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.score = vocabulary.score
        self.history: dict[str, list[tuple] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            if self.joins(piece):
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        crossed = any(a != SPACE and b == SPACE for a, b in inside)
        joined = {c for pair in inside for c in pair}
        alone = "".join(c for c in "\n\t\x00" if c not in joined)
        #: matches the units of a text, which no join connects
        self.units = re.compile(rf"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone and not crossed else r"(?s:.+)").findall
        self.first = _First()
        self._forget()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _forget(self) -> None:
        #: for each piece, which pieces may follow it, as far as asked
        self.follow: dict[str, dict[str, bool]] = {}
        self.asked = 0

    def joins(self, piece: str) -> list[tuple] | None:
        """The encoder's joins on a piece alone: (score, first symbol after it, last symbol after it) each; None if the piece isn't what results."""
        if piece not in self.history:
            symbols, steps = list(piece), [(0.0, piece[0], piece[-1])]
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(symbols[:-1], symbols[1:], strict=True)]
            while scores and (best := max(scores)) > -np.inf:
                at = scores.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                steps.append((best, symbols[0], symbols[-1]))
                del scores[at]
                if at:
                    scores[at - 1] = self.score.get(symbols[at - 1] + symbols[at], -np.inf)
                if at < len(scores):
                    scores[at] = self.score.get(symbols[at] + symbols[at + 1], -np.inf)
            self.history[piece] = steps if len(symbols) == 1 else None
        return self.history[piece]

    def compatible(self, left: str, right: str) -> bool:
        """True if the encoder leaves the border of two pieces as it is."""
        a, b, i, j = self.joins(left), self.joins(right), 1, 1
        while True:
            # of equal scores the leftmost join comes first: left's own, then the one across, then right's own
            across = self.score.get(a[i - 1][2] + b[j - 1][1])
            x = a[i][0] if i < len(a) else None
            y = b[j][0] if j < len(b) else None
            if across is not None and (x is None or across > x) and (y is None or across >= y):
                return False
            if x is None and y is None:
                return True
            if y is None or (x is not None and x >= y):
                i += 1
            else:
                j += 1

    def _may_follow(self, left: str, right: str) -> bool:
        row = self.follow.setdefault(left, {})
        if right not in row:
            row[right] = self.compatible(left, right)
            self.asked += 1
        return row[right]

    def last_pieces(self, unit: str) -> list[str]:
        """The last piece of each prefix of ``unit`` (the empty one first)."""
        size = len(unit)
        last, rows = [""] * (size + 1), [None] * (size + 1)
        rows[0], follow, at = self.first, self.follow, -1
        for end, (piece, n) in self.automaton.iter(unit):
            if end != at:
                row = rows[end + 1 - n]
                if row is None:
                    return self._last_pieces_of_all(unit)
                fits = row.get(piece)
                if fits is None:
                    fits = self._may_follow(last[end + 1 - n], piece)
                if fits:
                    at, last[end + 1] = end, piece
                    rows[end + 1] = follow.get(piece) or follow.setdefault(piece, {})
        return last if at == size - 1 else self._last_pieces_of_all(unit)

    def _last_pieces_of_all(self, unit: str) -> list[str]:
        """The same where a character is no piece: it stands for itself."""
        ends: list[list[str]] = [[] for _ in unit]
        for end, (piece, _) in self.automaton.iter(unit):
            ends[end].append(piece)
        last = [""]
        for end, matches in enumerate(ends):
            if not matches or len(matches[-1]) > 1:
                matches.append(unit[end])
            last.append(next(p for p in matches if (self._may_follow(last[end + 1 - len(p)], p) if len(p) <= end else True)))
        return last

    def _unit(self, unit: str) -> bytes:
        if self.asked > _PAIRS:
            self._forget()
        last, end, v, out = self.last_pieces(unit), len(unit), self.vocabulary, []
        while end:
            piece = last[end]
            end -= len(piece)
            if piece in v.ids:
                out.append(v.ids[piece])
            elif v.bytes:
                out.extend(v.bytes[b] for b in reversed(piece.encode()))
            elif not out or out[-1] != v.unknown:
                out.append(v.unknown)
        return array("i", reversed(out)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        units = self.units(self.vocabulary.prefix + text.replace(" ", SPACE))
        found = list(map(self.known.get, units))
        if None in found:
            for i, unit in enumerate(units):
                if found[i] is None:
                    found[i] = self._met(unit)
        return np.frombuffer(b"".join(found), np.int32)

    def _met(self, unit: str) -> bytes:
        ids = self.known.get(unit) or self.older.get(unit) or self._unit(unit)
        if len(unit) <= _UNIT_CHARS:
            if len(self.known) >= _UNITS:
                self.older, self.known = self.known, {}
            self.known[unit] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(Vocabulary(path)))


def _with(docs: DataFrame, column: str, kind: str, size: str, make) -> DataFrame:
    """``docs`` with a column that ``make`` computes from the column ``__from``; ``size``: the column by whose bytes batches are cut."""
    rest = [f for f in docs.schema if f.name not in (column, "__from")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{column}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, size) if size else [batch]:
                arrays = [piece.column(f.name) for f in rest] + [make(piece.column("__from"))]
                yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in rest), column])
            give_back()

    return docs.select(*[f.name for f in rest], "__from").mapInArrow(run, schema)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts; ``model`` is the path of a model file that every machine has."""

    def make(texts: pa.Array) -> pa.Array:
        encoder = _encoder(model)
        return _lists([encoder.encode(t) for t in texts.to_pylist()])

    return _with(docs.withColumn("__from", F.col(text).cast("string")), ids, "array<int>", "__from", make)


def decode(frame: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the texts of its ids (null: empty)."""

    def make(lists: pa.Array) -> pa.Array:
        vocabulary = _encoder(model).vocabulary
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        return pa.array([vocabulary.decode(flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.string())

    return _with(frame.withColumn("__from", F.col(ids).cast("array<int>")), text, "string", "", make)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_path()
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    return decode(encoded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
