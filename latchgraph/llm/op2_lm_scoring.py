"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is an interpolated bigram model over words and an end token:

    p(w)     = (1 - unknown) * c(w) / N        ``unknown`` for all unseen words together
    p(w | v) = (c(v, w) + prior * p(w)) / (c(v) + prior)

``Model`` has two levels of shards, each shard one binary row.  A shard of the word level holds the
hashes of its bucket's training words in Elias-Fano form and their counts; a word's id is its place
there with the bucket's number.  A shard of the pair level is a trie: sorted contexts, monotone
pointers to their successors, the successors as one monotone sequence of context-relative numbers
(context rank times vocabulary plus word), all in Elias-Fano form, and the smoothed probabilities
quantised to one byte.  Bytes are laid out so that a task maps them into memory and looks up in place.
A lookup is a successor search: the high bits of the context-relative number name a short run, whose
low bits are compared.

``learn`` builds the shards, ``Model.kept`` writes them to the shared checkpoint folder for later jobs,
and ``score`` answers from shards alone: stored ones, or, where a table is scored by its own model, those
that the task of a bucket seals, opens and answers from, since they would cross the network once more
otherwise.  Shards and text chunks exchange packed
requests and one-byte answers (see ``_exchange``), so neither the driver nor any task holds the model of
the whole corpus, and a frequent context is spread over all shards because pairs are dealt by both
words.  Counts of contexts and probabilities of words reach the shards in steps of 1 % or less.

Defined cases: a null or empty text is the end token alone; null ids are never held out; repeated rows
are learned from and scored once each; texts of any length are scored whole; with no training rows every token
is unknown; an empty table gives an empty result; columns other than doc_id and text are not looked at;
ties play no part.
"""

from __future__ import annotations

import math
import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._exchange import bucket_of, chunked, firsts, in_order, layout, pack, pack_rising, spans, unpack, unpack_rising
from ._tables import cut, held_out, partitions, table
from ._words import U, Words, mix

UNKNOWN = 0.03
PRIOR = 20.0
_END, _BEGIN = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
U32 = np.uint32
_CHUNK = 4 << 20
_STEPS = 20.0  # steps of quantisation per factor of ten
_FINE, _OCTAVE = 300.0, 64.0  # steps in requests: of probabilities per factor of ten, of counts per factor of two
_REQUEST = "__bucket int, __chunk int, a binary, b binary, n binary, q binary"
_REPLY = "__chunk int, bucket int, round int, reply binary"
_SHARD = "__bucket int, shard binary"


class EliasFano:
    """An ascending sequence of n numbers below a universe, in about 2 + log2(universe / n) bits each."""

    def __init__(self, low_bits: int, size: int, low: np.ndarray, high: np.ndarray):
        self.low_bits, self.size, self.low, self.high = low_bits, size, low, high
        # where each value of the high bits begins: the zeros of the unary part
        bits = np.unpackbits(high)
        zeros = np.flatnonzero(bits == 0)
        self.begins = np.concatenate(([0], zeros - np.arange(len(zeros)))).clip(max=size)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        low_bits = min(57, max(0, (universe // max(1, n)).bit_length() - 1))
        low = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low_bits]
        high = (values >> U(low_bits)).astype(np.int64)
        bits = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        return low_bits, n, np.concatenate((np.packbits(low, bitorder="little"), np.zeros(8, np.uint8))), np.packbits(bits)

    def low_at(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        bit = index.astype(np.int64) * self.low_bits
        # the eight bytes from the one in which a number begins hold all of it: up to 7 + 57 bits
        words = np.lib.stride_tricks.sliding_window_view(self.low, 8)[bit >> 3].view("<u8").ravel()
        return (words >> (bit & 7).astype(np.uint64)) & U((1 << self.low_bits) - 1)

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """For each number the index of the first element not below it."""
        high = (wanted >> U(self.low_bits)).astype(np.int64).clip(max=len(self.begins) - 2)
        at, end = self.begins[high], self.begins[high + 1]
        low = wanted & U((1 << self.low_bits) - 1)
        # a frequent context has long runs: halve what is left of each
        open_ = np.flatnonzero(at < end)
        while len(open_):
            middle = (at[open_] + end[open_]) >> 1
            less = self.low_at(middle) < low[open_]
            at[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[at[open_] < end[open_]]
        return at

    def at(self, index: np.ndarray) -> np.ndarray:
        """Elements by index."""
        high = np.searchsorted(self.begins, index, side="right") - 1
        return (high.astype(np.uint64) << U(self.low_bits)) | self.low_at(index)


def _sealed(numbers: list[int], levels: list[tuple], *more: np.ndarray) -> bytes:
    """A shard: its numbers, then each Elias-Fano level, then further arrays, behind a head of sizes."""
    arrays = [x for level in levels for x in level[2:]] + list(more)
    head = [len(numbers), len(levels), len(more), *numbers, *(x for level in levels for x in level[:2]), *(x.nbytes for x in arrays)]
    return b"".join([np.array(head, "<i8").tobytes(), *(x.tobytes() for x in arrays)])


def _opened(shard: bytes) -> tuple[list[int], list[EliasFano], list[np.ndarray]]:
    """The parts of a shard, as views of one mapping."""
    mapping = mmap.mmap(-1, len(shard))
    mapping.write(shard)
    whole = np.frombuffer(mapping, np.uint8)
    numbers, levels, more = whole[:24].view("<i8").tolist()
    arrays = 2 * levels + more
    head = whole[24 : 8 * (3 + numbers + 2 * levels + arrays)].view("<i8").tolist()
    ends = 8 * (3 + len(head)) + np.cumsum(head[numbers + 2 * levels :], dtype=np.int64)
    views = [whole[e - n : e] for e, n in zip(ends.tolist(), head[numbers + 2 * levels :], strict=True)]
    kinds = head[numbers : numbers + 2 * levels]
    return head[:numbers], [EliasFano(kinds[2 * i], kinds[2 * i + 1], views[2 * i], views[2 * i + 1]) for i in range(levels)], views[2 * levels :]


class WordLevel:
    """One shard of words: ascending hashes and their counts."""

    def __init__(self, shard: bytes):
        (self.base, self.seen), (self.hashes,), (counts,) = _opened(shard)
        self.counts = counts.view("<u8")

    @staticmethod
    def seal(hashes: np.ndarray, counts: np.ndarray) -> bytes:
        """``hashes`` ascend; the first is kept apart so that the sequence begins at 0."""
        base = hashes[0] if len(hashes) else U(0)
        universe = int(hashes[-1] - base) + 1 if len(hashes) else 1
        return _sealed([int(base.astype(np.int64)), int((hashes != _BEGIN).sum())], [EliasFano.encode(hashes - base, universe)], counts.astype("<u8"))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 where unseen) and place of each of the ascending ``wanted``."""
        base = np.int64(self.base).astype(np.uint64)
        count, at = np.zeros(len(wanted), np.uint64), np.zeros(len(wanted), np.uint64)
        if self.hashes.size:
            most = self.hashes.at(np.array([self.hashes.size - 1]))[0]
            inside = np.flatnonzero((wanted >= base) & (wanted - base <= most))
            place = self.hashes.successor(wanted[inside] - base)
            same = self.hashes.at(place) == wanted[inside] - base
            count[inside[same]] = self.counts[place[same]]
            at[inside[same]] = place[same].astype(np.uint64)
        return count, at


class Trie:
    """One shard of pairs: contexts, pointers, context-relative successors and quantised probabilities."""

    def __init__(self, shard: bytes):
        (self.vocabulary,), (self.contexts, self.pointers, self.words), (self.codes,) = _opened(shard)

    @staticmethod
    def seal(context: np.ndarray, word: np.ndarray, code: np.ndarray, vocabulary: int) -> bytes:
        """Entries ascend by (context, word)."""
        new = firsts(context)
        contexts = context[new]
        rank = np.cumsum(new) - 1
        pointers = np.append(np.flatnonzero(new), len(context)).astype(np.uint64)
        relative = rank.astype(np.uint64) * U(vocabulary) + word
        levels = [EliasFano.encode(contexts, vocabulary), EliasFano.encode(pointers, len(context) + 1), EliasFano.encode(relative, len(contexts) * vocabulary + 1)]
        return _sealed([vocabulary], levels, code.astype(np.uint8))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each (context, word); 0 where the shard has none."""
        out = np.zeros(len(context), np.uint8)
        if not self.contexts.size:
            return out
        rank = self.contexts.successor(context)
        known = np.flatnonzero((rank < self.contexts.size) & (word < self.vocabulary))
        known = known[self.contexts.at(rank[known]) == context[known]]
        wanted = rank[known].astype(np.uint64) * U(self.vocabulary) + word[known]
        at = self.words.successor(wanted)
        inside = at < self.pointers.at(rank[known] + 1).astype(np.int64)
        known, at, wanted = known[inside], at[inside], wanted[inside]
        same = self.words.at(at) == wanted
        out[known[same]] = self.codes[at[same]]
        return out


def _quantised(p: np.ndarray, least: int = 0) -> np.ndarray:
    return np.rint(-np.log10(np.maximum(p, 1e-13)) * _STEPS).clip(least, 255).astype(np.uint8)


class _Text:
    """Tokens of one chunk: words and an end token for each document."""

    def __init__(self, rows: pa.Table):
        self.rows = in_order(rows)
        words = Words(self.rows.column("text"), lower=True)
        n = len(self.rows)
        self.counts = words.counts + 1
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        tokens = np.full(self.first[-1], _END, np.uint64)
        tokens[np.arange(len(words.hash)) + np.repeat(np.arange(n), words.counts)] = words.hash
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first[:-1]] = _BEGIN
        held = np.array(self.rows.column("__held").to_pylist(), bool)
        self.used = np.repeat(~held, self.counts)
        self.keys, back = np.unique(np.concatenate((tokens, [_BEGIN])), return_inverse=True)
        self.token = back[:-1]
        self.begin = back[-1]
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[self.first[:-1]] = self.begin
        self.number = np.bincount(self.token[self.used], minlength=len(self.keys))
        self.number[self.begin] = (~held).sum()

    def words(self, chunk: int, buckets: int) -> list[tuple]:
        return [(k, chunk, pack_rising(self.keys[i:j]), b"", pack(self.number[i:j].astype(np.uint32)), b"") for k, i, j in spans(bucket_of(self.keys, buckets))]

    def learn(self, replies: pa.Table, buckets: int, total: int, unknown: float) -> None:
        """Counts, ids and probabilities of this chunk's words."""
        got = sorted((b, r) for b, n, r in _replies(replies) if n == 1)
        half = [len(r) // 2 for _, r in got]
        self.count = np.concatenate([unpack(r[:h], np.uint64) for (_, r), h in zip(got, half, strict=True)]).astype(np.float64)
        self.id = np.concatenate([unpack_rising(r[h:], np.uint64) * U(buckets) + U(b) for (b, r), h in zip(got, half, strict=True)])
        self.p = np.where(self.count > 0, (1 - unknown) * self.count / max(total, 1), unknown if total else 1.0)

    def pairs(self) -> None:
        """Distinct bigrams of known words, ascending by bucket, context and word."""
        known = (self.count[self.token] > 0) & (self.count[self.before] > 0)
        self.known = np.flatnonzero(known)
        pair = self.before[known].astype(np.int64) * len(self.keys) + self.token[known]
        unique, self.back = np.unique(pair, return_inverse=True)
        self.used_pairs = np.bincount(self.back[self.used[known]], minlength=len(unique))
        self.v, self.w = np.divmod(unique, len(self.keys))

    def bigrams(self, chunk: int, buckets: int) -> list[tuple]:
        v, w = self.id[self.v], self.id[self.w]
        bucket = bucket_of(mix(v * U(0x9FB21C651E98DF25) + w), buckets)
        self.order = order = np.lexsort((w, v, bucket))
        v, w, n, bucket = v[order], w[order], self.used_pairs[order].astype(np.uint32), bucket[order]
        weight = np.rint(np.log2(self.count[self.v]) * _OCTAVE).clip(0, 4095).astype(np.uint32)[order]
        chance = np.rint(-np.log10(np.maximum(self.p[self.w], 1e-13)) * _FINE).astype(np.uint32)[order]
        hints = np.where(n > 0, weight << U32(12) | chance, U32(0))
        return [(k, chunk, pack_rising(v[i:j]), pack(w[i:j]), pack(n[i:j]), pack(hints[i:j])) for k, i, j in spans(bucket)]

    def score(self, replies: pa.Table, prior: float) -> tuple[np.ndarray, ...]:
        got = sorted((b, r) for b, n, r in _replies(replies) if n == 2)
        codes = np.zeros(len(self.v), np.uint8)
        if got:
            codes[self.order] = np.concatenate([np.frombuffer(r, np.uint8) for _, r in got])
        logs = np.log10(prior * self.p[self.token] / (self.count[self.before] + prior))
        found = codes[self.back]
        logs[self.known] = np.where(found > 0, found / -_STEPS, logs[self.known])
        at = self.first[:-1]
        if not len(at):
            return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        count = self.count[self.token]
        return np.add.reduceat(logs, at), np.add.reduceat(np.log10(count + 1), at), np.add.reduceat((count > 0).astype(np.int64), at)


def _replies(replies: pa.Table) -> Iterator[tuple]:
    return zip(*(replies.column(c).to_pylist() for c in ("bucket", "round", "reply")), strict=True)


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["__bucket", "__chunk", "a", "b", "n", "q"])


def _made(chunk: list[int], bucket: list[int], number: list[int], made: list[bytes]) -> pa.Table:
    return pa.table({"__chunk": pa.array(chunk, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "round": pa.array(number, pa.int32()), "reply": pa.array(made, pa.binary())})


def _numbers(rows: pa.Table, column: str, how, dtype) -> list[np.ndarray]:
    return [how(x, dtype) for x in rows.column(column).to_pylist()]


def _shard(bucket: int, shard: bytes) -> pa.Table:
    return pa.table({"__bucket": pa.array([bucket], pa.int32()), "shard": pa.array([shard], pa.binary())})


def _count_words(rows: pa.Table) -> pa.Table:
    number = np.concatenate(_numbers(rows, "n", unpack, np.uint32))
    unique, back = np.unique(np.concatenate(_numbers(rows, "a", unpack_rising, np.uint64)), return_inverse=True)
    total = np.bincount(back, weights=number, minlength=len(unique)).astype(np.uint64)
    return _shard(rows.column("__bucket")[0].as_py(), WordLevel.seal(unique[total > 0], total[total > 0]))


def _count_pairs(prior: float):
    def run(rows: pa.Table) -> pa.Table:
        v, w, n, q = (np.concatenate(_numbers(rows, c, f, t)) for c, t, f in (("a", np.uint64, unpack_rising), ("b", np.uint64, unpack), ("n", np.uint32, unpack), ("q", np.uint32, unpack)))
        used = np.flatnonzero(n)
        order = used[np.lexsort((w[used], v[used]))]
        new = firsts(v[order], w[order])
        head = order[new]
        count = np.bincount(np.cumsum(new) - 1, weights=n[order], minlength=len(head))
        weight, p = np.exp2((q[head] >> U32(12)) / _OCTAVE), 10.0 ** ((q[head] & U32(4095)) / -_FINE)
        code = _quantised(np.minimum((count + prior * p) / (np.maximum(weight, count) + prior), 1.0), 1)
        vocabulary = int(max(v[head].max(), w[head].max())) + 1 if len(head) else 1
        return _shard(rows.column("__bucket")[0].as_py(), Trie.seal(v[head], w[head], code, vocabulary))

    return run


def _find_words(rows: pa.Table, shards: pa.Table) -> pa.Table:
    """Answers with each word's count and id; one more row has the number of words seen in training."""
    bucket = (rows if rows.num_rows else shards).column("__bucket")[0].as_py()
    shard = shards.column("shard")[0].as_py() if shards.num_rows else WordLevel.seal(np.zeros(0, np.uint64), np.zeros(0))
    level = WordLevel(shard)
    made = [pack(count) + pack_rising(at) for count, at in map(level.find, _numbers(rows, "a", unpack_rising, np.uint64))]
    made.append(str(level.seen).encode())
    chunk = rows.column("__chunk").to_pylist()
    # the row of a bucket's vocabulary goes to a group of its own
    return _made([*chunk, -1 - bucket], [bucket] * len(made), [1] * len(chunk) + [0], made)


def _find_pairs(rows: pa.Table, shards: pa.Table) -> pa.Table:
    """Answers with a code for each pair; 0 where the shard has none."""
    v, w = _numbers(rows, "a", unpack_rising, np.uint64), _numbers(rows, "b", unpack, np.uint64)
    if shards.num_rows and rows.num_rows:
        found = Trie(shards.column("shard")[0].as_py()).find(np.concatenate(v), np.concatenate(w))
        ends = np.cumsum([len(x) for x in v])
        made = [found[e - len(x) : e].tobytes() for x, e in zip(v, ends.tolist(), strict=True)]
    else:
        made = [bytes(len(x)) for x in v]
    return _made(rows.column("__chunk").to_pylist(), rows.column("__bucket").to_pylist(), [2] * rows.num_rows, made)


def _sealed_and_found(count, find):
    """Seals a bucket's shard and answers the bucket's requests from its bytes."""
    return lambda rows: find(rows, count(rows))


def _training_tokens(docs: DataFrame, modulus: int) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._words import pieces

        total = 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                total += len(Words(piece.column(0), lower=False).hash) + piece.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    used = docs.filter(~held_out(F.col("doc_id"), modulus)).select("text")
    return used.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


@dataclass(frozen=True)
class Model:
    """Shards of words and of pairs, one row per bucket, with what a scorer must know of the training."""

    words: DataFrame
    pairs: DataFrame
    buckets: int
    total: int
    unknown: float
    prior: float

    def kept(self) -> Model:
        """The same model with its shards written to the shared checkpoint folder."""
        return Model(cut(self.words), cut(self.pairs), self.buckets, self.total, self.unknown, self.prior)


class _Requests:
    """The rows that chunks and shards exchange about one table."""

    def __init__(self, docs: DataFrame, chunks: int, buckets: int, modulus: int, total: int, unknown: float):
        self.n = partitions(docs.sparkSession)
        self.dealt = chunked(docs, chunks, held_out(F.col("doc_id"), modulus).alias("__held"))
        self.buckets = buckets

        def first(rows: pa.Table) -> pa.Table:
            return _table(_Text(rows).words(rows.column("__chunk")[0].as_py(), buckets))

        def second(rows: pa.Table, replies: pa.Table) -> pa.Table:
            text = _Text(rows)
            text.learn(replies, buckets, total, unknown)
            text.pairs()
            return _table(text.bigrams(rows.column("__chunk")[0].as_py(), buckets))

        self.second = second
        self.words = self.dealt.groupBy("__chunk").applyInArrow(first, _REQUEST).repartition(self.n, "__bucket")

    def by_bucket(self, asked: DataFrame, shards: DataFrame, find) -> DataFrame:
        return asked.groupBy("__bucket").cogroup(shards.repartition(self.n, "__bucket").groupBy("__bucket")).applyInArrow(find, _REPLY)

    def pairs(self, known: DataFrame) -> DataFrame:
        replies = known.filter("round = 1").repartition(self.n, "__chunk")
        asked = self.dealt.groupBy("__chunk").cogroup(replies.groupBy("__chunk")).applyInArrow(self.second, _REQUEST)
        return asked.repartition(self.n, "__bucket")


def learn(docs: DataFrame, modulus: int = 7, unknown: float = UNKNOWN, prior: float = PRIOR) -> Model:
    """The model of all documents that are not held out."""
    used = docs.filter(~held_out(F.col("doc_id"), modulus))
    chunks, buckets = layout(used, chunk_bytes=_CHUNK)
    total = _training_tokens(docs, modulus)
    requests = _Requests(used, chunks, buckets, modulus, total, unknown)
    words = requests.words.groupBy("__bucket").applyInArrow(_count_words, _SHARD)
    known = requests.by_bucket(requests.words, words, _find_words)
    pairs = requests.pairs(known).groupBy("__bucket").applyInArrow(_count_pairs(prior), _SHARD)
    return Model(words, pairs, buckets, total, unknown, prior)


def score(docs: DataFrame, modulus: int = 7, unknown: float = UNKNOWN, prior: float = PRIOR, model: Model | None = None) -> DataFrame:
    """Scores every document by ``model``, or by the model of those documents that are not held out."""
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()
    chunks, buckets = layout(docs, chunk_bytes=_CHUNK)
    if model is None:
        total = _training_tokens(docs, modulus)
    else:
        total, buckets, unknown, prior = model.total, model.buckets, model.unknown, model.prior
    requests = _Requests(docs, chunks, buckets, modulus, total, unknown)

    def third(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:  # the row of a bucket's vocabulary
            seen = [int(r) for r in replies.column("reply").to_pylist()]
            empty = [None] * len(seen)
            return pa.table({"doc_id": pa.array(empty, ids), "held_out": pa.array(empty, pa.bool_()), "n_tokens": pa.array(empty, pa.int64()), "n_known": pa.array(empty, pa.int64()), "logs": pa.array(empty, pa.float64()), "score": pa.array(empty, pa.float64()), "seen": pa.array(seen, pa.int64())})
        text = _Text(rows)
        text.learn(replies, buckets, total, unknown)
        text.pairs()
        text.bigrams(0, buckets)
        scores, logs, known = text.score(replies, prior)
        return pa.table({"doc_id": text.rows.column("doc_id"), "held_out": text.rows.column("__held"), "n_tokens": pa.array(text.counts, pa.int64()), "n_known": pa.array(known, pa.int64()), "logs": pa.array(logs), "score": pa.array(scores), "seen": pa.array([None] * len(logs), pa.int64())})

    ids = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}.get(id_type, pa.int64())
    if model is None:
        one = requests.words.groupBy("__bucket").applyInArrow(_sealed_and_found(_count_words, _find_words), _REPLY)
        two = requests.pairs(one).groupBy("__bucket").applyInArrow(_sealed_and_found(_count_pairs(prior), _find_pairs), _REPLY)
    else:
        one = requests.by_bucket(requests.words, model.words, _find_words)
        two = requests.by_bucket(requests.pairs(one), model.pairs, _find_pairs)
    replies = one.unionByName(two).repartition(requests.n, "__chunk")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, score double, seen long"
    scored = cut(requests.dealt.groupBy("__chunk").cogroup(replies.groupBy("__chunk")).applyInArrow(third, schema))
    vocabulary = scored.agg(F.sum("seen")).first()[0] or 0
    base = F.col("logs") - F.col("n_tokens") * math.log10(total + 1 * (vocabulary + 1))
    rows = scored.filter(F.col("seen").isNull())
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
