"""N-gram Jaccard join: a size-aware heavy-light set similarity join.

Documents are sets of ``shingle`` consecutive words; two link when intersection / union is at least
``percent`` / 100.  Equal sets fall together first.  Between different sets:

* light sets: if the smaller set of a pair has at most ``boundary`` shingles, the whole of it must lie
  in the larger one, which enumerates all its subsets of that fixed size as keys;
* heavy sets scan inverted lists.  A list stands for a block of shingles rather than one shingle: a set
  of a size class is split by hash into one block more than two linked sets can differ in, so they
  have an equal block.  A shingle that a third of all documents share makes no long list by that;
* the boundary is the one of least cost, counted from the sizes of all sets.

A list of a few sets gives all its pairs; a longer one links its sets to one of them only (a star).  Pairs
are first held against a bound: the counts of two sets by hash bucket differ by no more than the sets do.
Verified intersections confirm the rest and give components.  For links between components, the sets of
long lists are joined once more on inverted lists of single shingles, rarest first, cut by prefix length and
position; pairs inside one component, which a large group of near copies consists of, are never made.

Defined cases: a null or empty text has no shingles and links with nothing; fewer words than
``shingle`` make one; texts of any length are taken whole; rows with equal sets link; a row without an id takes part and has no component_id
of its own to give; an empty table gives an empty result; extra columns pass through ``keep_rows``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sized
from ._components import components
from ._exchange import BUCKET_BYTES, CHUNK_BYTES, bucket_of, firsts, layout, pack, pack_rising, spans, unpack, unpack_rising
from ._tables import cut, partitions, table
from ._words import U, Words, mix, pieces

SHINGLE = 3
PERCENT = 90
_SECOND = U(0xD6E8FEB86659FD93)
_LIST_COST = 3  # work for a list entry, with what it leads to, against that for a subset


class Sets:
    """Sorted distinct shingles of each row, with two hashes of the whole set."""

    def __init__(self, texts: pa.Array, shingle: int):
        hashes, first = Words(texts, lower=True).shingles(shingle)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = firsts(hashes, row)
        self.values, self.row = hashes[new], row[new]
        self.size = np.bincount(self.row, minlength=len(first) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        full = self.size > 0
        self.key, self.check = np.zeros(len(self.size), np.uint64), np.zeros(len(self.size), np.uint64)
        if len(self.values):
            at = self.first[:-1][full]
            self.key[full] = mix(np.add.reduceat(mix(self.values + _SECOND), at) + self.size[full].astype(np.uint64))
            self.check[full] = mix(np.add.reduceat(mix(self.values ^ _SECOND), at))


class Scheme:
    """Size classes with their numbers of blocks, and the light sizes, for one threshold."""

    def __init__(self, percent: int, boundary: int = 0):
        self.percent, self.boundary = percent, boundary
        self.ratio = percent / 100
        self.least, self.blocks, self.spare = [], [], []
        low = 1
        while low < 1 << 40:
            high = max(low + 1, math.ceil(low * (1 + 1.5 * (100 / percent - 1))))
            # sets a <= b that link differ in at most (a + b)(100 - p) / (100 + p) <= a (100 - p) / p shingles
            differ = (high - 1) * (100 - percent) // percent
            spare, n = 0, differ + 1
            for _ in range(3):
                mean = n * math.exp(-low / n)
                spare = math.ceil(mean + 2.3 * math.sqrt(mean)) if mean > 0.02 else 0
                n = differ + 1 + spare
            self.least.append(low)
            self.blocks.append(n)
            self.spare.append(spare)
            low = high

    def class_of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.least, size, side="right") - 1

    def limit(self, size):
        """The largest size that links with a set of ``size``."""
        return size * 100 // self.percent

    def overlap(self, a, b):
        """Shingles that linked sets of these sizes have in common, at least."""
        return -(-(self.percent * (a + b)) // (100 + self.percent))

    def most_light(self) -> int:
        """Up to this size the smaller of two linked sets lies wholly in the larger."""
        a = 0
        while a < 64 and all(self.overlap(a + 1, b) == a + 1 for b in range(a + 1, self.limit(a + 1) + 1)):
            a += 1
        return a

    def subset_sizes(self, size: int) -> list[int]:
        return [a for a in range(max(1, self.overlap(size, 0)), min(size, self.boundary) + 1) if self.limit(a) >= size]

    def classes(self, size: int) -> list[int]:
        """The classes in whose lists a set of this size stands: its own, and the one below where a set of it may link."""
        if size <= self.boundary:
            return []
        c = int(self.class_of(np.array([size]))[0])
        return [c, c - 1] if c and self.limit(self.least[c] - 1) >= size else [c]

    def choose(self, sizes: dict[int, int]) -> Scheme:
        """The boundary of least cost for a number of sets by size."""
        costs = []
        for x in range(self.most_light() + 1):
            s = Scheme.__new__(Scheme)
            s.__dict__ |= self.__dict__ | {"boundary": x}
            light = sum(n * math.comb(k, a) for k, n in sizes.items() for a in s.subset_sizes(k))
            heavy = sum(n * _LIST_COST * sum(s.blocks[c] for c in s.classes(k)) for k, n in sizes.items())
            costs.append((light + heavy, x, s))
        return min(costs, key=lambda c: c[:2])[2]

    def keys(self, sets: Sets, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All keys of the sets in ``rows`` and the row of each."""
        out, of = [], []
        size = sets.size[rows]
        own = self.class_of(size)
        values = mix(sets.values * U(0xA0761D6478BD642F) + U(1))
        lowest = np.array(self.least, np.int64)
        for back in (0, 1):
            c = own - back
            use = (size > self.boundary) & (c >= 0)
            if back:
                use &= (lowest[own] - 1) * 100 // self.percent >= size
            at, c = rows[use], c[use]
            if not len(at):
                continue
            n = np.array(self.blocks, np.int64)[c]
            begin = np.concatenate(([0], np.cumsum(n)))
            length = sets.size[at]
            place = np.repeat(sets.first[at] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            block = (mix(sets.values[place] + U(7)) % np.repeat(n, length).astype(np.uint64)).astype(np.int64) + np.repeat(begin[:-1], length)
            sums = np.zeros(begin[-1], np.uint64)
            np.add.at(sums, block, values[place])
            filled = np.zeros(begin[-1], bool)
            filled[block] = True
            which = np.repeat(np.arange(len(at)), n)
            # empty blocks may be left out where they are no more than the spare ones
            empty = n - np.add.reduceat(filled.astype(np.int64), begin[:-1])
            keep = filled | np.repeat(empty > np.array(self.spare, np.int64)[c], n)
            number = np.arange(begin[-1]) - np.repeat(begin[:-1], n)
            label = mix((np.repeat(c, n).astype(np.uint64) << U(32)) + number.astype(np.uint64))
            out.append(mix(sums + label)[keep])
            of.append(at[which][keep])
        for i in rows[size <= self.limit(self.boundary)] if self.boundary else []:
            n = int(sets.size[i])
            part = values[sets.first[i] : sets.first[i + 1]]
            whole = np.add.reduce(part, dtype=np.uint64)
            for a in self.subset_sizes(n):
                left_out = np.array([sum(map(int, x)) & (1 << 64) - 1 for x in itertools.combinations(part, n - a)], np.uint64)
                out.append(mix(whole - left_out + mix(np.full(len(left_out), (1 << 60) + a, np.uint64))))
                of.append(np.full(len(left_out), i))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(of)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _reference() -> Column:
    """A number for a row: its id, or a hash of the text where it has none.  Rows may share one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def _text_hash() -> Column:
    """With the reference, the key of a row's id and text; independent of the hash that a reference may be."""
    return F.xxhash64(F.lit(0), "text")


def set_table(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, ref, t (hash of the text), n (set size), key and check (hashes of the set) of every row."""
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = Sets(piece.column(1), shingle)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), piece.column(3), pa.array(sets.size, pa.int64()), _signed(sets.key), _signed(sets.check)], ["doc_id", "ref", "t", "n", "key", "check"])

    return docs.select("doc_id", "text", _reference().alias("ref"), _text_hash().alias("t")).mapInArrow(run, f"doc_id {id_type}, ref long, t long, n long, key long, check long")


def _stars(docs: DataFrame, sets: DataFrame, shingle: int, scheme: Scheme) -> DataFrame:
    """(x, y, near, long): pairs of sets that share a list, by key; ``near`` where their sizes allow a link.

    A short list gives all its pairs, a long one links its sets to the least of them (``long``).

    Lists hold references, which pack better than keys; rows that share one only add pairs to verify.
    """
    _, buckets = layout(docs)
    n = partitions(docs.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                sets = Sets(piece.column(0), shingle)
                rows = np.flatnonzero(sets.size)
                rows = rows[np.unique(sets.key[rows], return_index=True)[1]]
                keys, of = scheme.keys(sets, rows)
                order = np.argsort(keys)
                keys, of = keys[order], piece.column(1).to_numpy()[of[order]]
                # 56 bits of a key are sent; lists that fall together only add pairs to verify
                made = [(k, pack_rising(keys[i:j] >> U(8)), pack(of[i:j])) for k, i, j in spans(bucket_of(keys, buckets))]
                if made:
                    b, k, o = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(o, pa.binary())], ["__bucket", "k", "o"])

    def meet(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_rising(x, np.uint64) for x in rows.column("k").to_pylist()])
        of = np.concatenate([unpack(x, np.int64) for x in rows.column("o").to_pylist()])
        order = np.lexsort((of, keys))
        keys, of = keys[order], of[order]
        new = firsts(keys, of)
        keys, of = keys[new], of[new]
        head = np.flatnonzero(firsts(keys))
        size = np.diff(np.append(head, len(of)))
        first, length = np.repeat(head, size), np.repeat(size, size)
        place = np.arange(len(of))
        made = [(of[place[at]], of[place[at] - d], np.zeros(len(at), bool)) for d in range(1, _SHORT) if len(at := np.flatnonzero((length <= _SHORT) & (place - first >= d)))]
        at = np.flatnonzero((length > _SHORT) & (place > first))
        made.append((of[at], of[first[at]], np.ones(len(at), bool)))
        x, y, long = (np.concatenate(c) for c in zip(*made, strict=True))
        order = np.lexsort((long, y, x))
        x, y, long = x[order], y[order], long[order]
        # of equal pairs the last one tells whether a long list is among theirs
        last = np.append(firsts(x, y)[1:], True) if len(x) else np.zeros(0, bool)
        return pa.table({"x": pa.array(x[last]), "y": pa.array(y[last]), "long": pa.array(long[last])})

    asked = docs.select("text", _reference().alias("ref")).mapInArrow(ask, "__bucket int, k binary, o binary")
    pairs = asked.repartition(n, "__bucket").groupBy("__bucket").applyInArrow(meet, "x long, y long, long boolean").groupBy("x", "y").agg(F.bool_or("long").alias("long"))
    known = sets.filter("n > 0")
    left = known.select(F.col("ref").alias("x"), F.col("key").alias("a"), F.col("n").alias("m"))
    right = known.select(F.col("ref").alias("y"), F.col("key").alias("b"), "n")
    near = 100 * F.least("m", "n") >= scheme.percent * F.greatest("m", "n")
    return pairs.join(left, "x").join(right, "y").filter("a != b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"), near.alias("near"), "long").groupBy("x", "y").agg(F.first("near").alias("near"), F.bool_or("long").alias("long"))


_FILTER_BITS = 1 << 28
_SEGMENT = 1 << 10
_SALTS = (U(0x8CB92BA72F3D8DD7), U(0xF1357AEA2E62A9C5))
_HISTOGRAM = 128
_BEFORE = 16
_SHORT = 16


def _filter_bits(wanted: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the keys with two hashes, as 64-bit words; at most ``_FILTER_BITS``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            p = np.concatenate([mix(keys + salt) & U(bits - 1) for salt in _SALTS])
            yield pa.RecordBatch.from_arrays([pa.array((p >> U(6)).astype(np.int64)), pa.array((U(1) << (p & U(63))).view(np.int64))], ["w", "b"])

    def filled(rows: pa.Table) -> pa.Table:
        out = np.zeros(_SEGMENT, np.int64)
        out[rows.column("w").to_numpy() % _SEGMENT] = rows.column("b").to_numpy()
        return pa.table({"s": rows.column("s").slice(0, 1), "bits": pa.array([out.tobytes()])})

    words = wanted.select("key").mapInArrow(place, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    segments = words.withColumn("s", F.shiftright("w", 10)).groupBy("s").applyInArrow(filled, "s long, bits binary")
    out = np.zeros(max(bits // 64, _SEGMENT), np.int64)
    for r in segments.collect():
        out[r["s"] * _SEGMENT : (r["s"] + 1) * _SEGMENT] = np.frombuffer(r["bits"], np.int64)
    return out


def _picked(docs: DataFrame, wanted: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """key and value of the sets whose keys are in ``wanted``, one row each; ``whole``: the packed shingles, else
    their counts by hash bucket.

    A filter of bounded size picks them where the texts are read, so texts are not shuffled; the other sets that
    it lets through do no harm.  They are few up to some ten million wanted sets; beyond that the filter fills up
    and in the end lets all sets pass, which costs a shuffle of their values.
    """
    bits = 1 << 16
    number = wanted.count()
    while bits < 16 * number and bits < _FILTER_BITS:
        bits <<= 1
    words = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = words.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                s = Sets(piece.column(0), shingle)
                rows = np.flatnonzero(s.size)
                rows = rows[np.unique(s.key[rows], return_index=True)[1]]
                for salt in _SALTS:
                    p = mix(s.key[rows] + salt) & U(bits - 1)
                    rows = rows[(filled[(p >> U(6)).astype(np.int64)].view(np.uint64) >> (p & U(63)) & U(1)).astype(bool)]
                parts = [s.values[s.first[i] : s.first[i + 1]] for i in rows]
                if not whole:
                    parts = [np.bincount((x & U(_HISTOGRAM - 1)).astype(np.int64), minlength=_HISTOGRAM).clip(max=255).astype(np.uint8) for x in parts]
                yield pa.RecordBatch.from_arrays([_signed(s.key[rows]), pa.array(s.size[rows], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["key", "n", "value"])

    return docs.select("text").mapInArrow(run, "key long, n long, value binary").dropDuplicates(["key"])


def _joined(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """x, y and their values a and b."""
    side = lambda name, value: held.select(F.col("key").alias(name), F.col("value").alias(value))
    return pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").select("x", "y", "a", "b")


def bounded(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their counts: with n shingles in all and at least ``differ`` of them in one set
    only, the similarity is at most (n - differ) / (n + differ)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, _HISTOGRAM).astype(np.int32) for i in (2, 3))
                n, differ = (a + b).sum(axis=1), np.abs(a - b).sum(axis=1)
                # counts at the end of their range give no bound
                keep = (a.max(axis=1) == 255) | (b.max(axis=1) == 255) | (100 * (n - differ) >= percent * (n + differ))
                yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return _joined(pairs, counts).mapInArrow(run, "x long, y long")


def verify(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return _joined(pairs, held).mapInArrow(run, "x long, y long")


def _across(held: DataFrame, labels: DataFrame, tested: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs of sets in different components that may link: lists of single shingles, rarest first.

    Chunks of sets and buckets of shingles grow in number with the shingles of the sets, so what one task holds does not.
    """
    n = partitions(held.sparkSession)
    size = 8 * (held.agg(F.sum("n")).first()[0] or 0)
    chunks, buckets = max(2 * n, math.ceil(size / CHUNK_BYTES)), max(n, math.ceil(size / BUCKET_BYTES[0]))
    dealt = held.select("key", "n", "value").withColumn("__chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")).repartition(n, "__chunk")

    def values_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [np.frombuffer(x, np.uint64) for x in rows.column("value").to_pylist()]
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        unique, back, count = np.unique(values, return_inverse=True, return_counts=True)
        return row, unique, back, count

    def ask(rows: pa.Table) -> pa.Table:
        chunk = rows.column("__chunk")[0].as_py()
        _, unique, _, count = values_of(rows)
        made = [(k, chunk, pack_rising(unique[i:j]), pack(count[i:j].astype(np.uint32))) for k, i, j in spans(bucket_of(unique, buckets))]
        columns = list(zip(*made, strict=True)) if made else [[]] * 4
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["__bucket", "__chunk", "k", "c"])

    def count(rows: pa.Table) -> pa.Table:
        keys = [unpack_rising(x, np.uint64) for x in rows.column("k").to_pylist()]
        number = np.concatenate([unpack(x, np.uint32) for x in rows.column("c").to_pylist()])
        unique, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.minimum(np.bincount(back, weights=number, minlength=len(unique)), 1 << 31).astype(np.uint32)[back]
        ends = np.cumsum([len(x) for x in keys])
        made = [pack(total[e - len(x) : e]) for x, e in zip(keys, ends, strict=True)]
        return pa.table({"__chunk": rows.column("__chunk"), "bucket": rows.column("__bucket"), "reply": pa.array(made, pa.binary())})

    def entries(rows: pa.Table, replies: pa.Table) -> pa.Table:
        row, unique, back, _ = values_of(rows)
        got = sorted(zip(replies.column("bucket").to_pylist(), replies.column("reply").to_pylist(), strict=True))
        total = np.concatenate([unpack(r, np.uint32) for _, r in got]) if got else np.zeros(0, np.uint32)
        total = total[back]
        order = np.lexsort((unique[back], total, row))
        size = rows.column("n").to_numpy()
        first = np.concatenate(([0], np.cumsum(size)))
        row = row[order]
        place = np.arange(len(row)) - first[row]
        low = scheme.overlap(size, np.array([-(-int(x) * scheme.percent // 100) for x in size], np.int64))
        use = (place <= (size - low)[row]) & (total[order] > 1)
        row, place, token = row[use], place[use], unique[back][order][use]
        # the entries of the same set before each one, up to 16
        at = np.arange(len(row))
        number = np.minimum(at - np.searchsorted(row, row), _BEFORE)
        ends = np.concatenate(([0], np.cumsum(number)))
        before = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(token[np.repeat(at - number - ends[:-1], number) + np.arange(ends[-1])]))
        take = lambda c: rows.column(c).to_numpy()[row]
        return pa.table({"token": _signed(token), "before": before, "key": pa.array(take("key"), pa.int64()), "n": pa.array(size[row], pa.int64()), "place": pa.array(place, pa.int64())})

    asked = dealt.groupBy("__chunk").applyInArrow(ask, "__bucket int, __chunk int, k binary, c binary")
    counted = asked.repartition(n, "__bucket").groupBy("__bucket").applyInArrow(count, "__chunk int, bucket int, reply binary")
    listed = dealt.groupBy("__chunk").cogroup(counted.repartition(n, "__chunk").groupBy("__chunk")).applyInArrow(entries, "token long, before array<long>, key long, n long, place long")
    listed = cut(listed.join(labels, listed["key"] == labels["node"], "left").select("token", "before", "key", "n", "place", F.coalesce("component", "key").alias("component")))
    p = scheme.percent
    # a scanned list holds the smaller set of a pair, whose prefix is the shorter
    index = listed.filter(f"n - place >= ceil({p} * 2 * n / {100 + p})").select(F.col("token").alias("t"), F.col("key").alias("y"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("component").alias("d"), F.col("before").alias("e"))
    fits = (F.col("token") == F.col("t")) & (F.col("component") != F.col("d")) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("y") < F.col("key"))))
    fits = fits & (F.least(F.col("n") - F.col("place"), F.col("m") - F.col("q")) * (100 + p) >= p * (F.col("n") + F.col("m")))
    # a pair is made in the first list that its sets have in common, as far as the entries before tell
    fits = fits & ~F.arrays_overlap("before", "e")
    pairs = listed.join(index, fits).select(F.col("key").alias("x"), "y").distinct()
    seen = tested.union(tested.select(F.col("y").alias("x"), F.col("x").alias("y")))
    return pairs.join(seen, ["x", "y"], "left_anti")


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The set of every row (doc_id, n, key, check), and (node, component) of the sets with links."""
    sets = cut(set_table(docs, shingle))
    scheme = Scheme(percent)
    most = scheme.limit(scheme.most_light()) + 1
    sizes = {r["n"]: r["c"] for r in sets.filter(f"n > 0 and n <= {most}").groupBy("n").agg(F.count("*").alias("c")).collect()}
    scheme = scheme.choose(sizes)
    found = cut(_stars(docs, sets, shingle, scheme))
    ends = lambda frame: frame.select(F.col("x").alias("key")).union(frame.select(F.col("y").alias("key"))).distinct()
    near = found.filter("near").select("x", "y")
    counts = cut(_picked(docs, ends(near), shingle, False))
    near = cut(bounded(near, counts, percent))
    # all pairs of short lists are among ``near``; those of long lists are left to single shingles
    crowd = cut(ends(found.filter("long")))
    held = cut(_picked(docs, ends(near).union(crowd).distinct(), shingle, True))
    links = cut(verify(sized(near, 200_000), held, percent))
    labels = components(links)
    across = cut(_across(held.join(sized(crowd, 200_000), "key", "left_semi"), labels, near, scheme))
    more = cut(verify(sized(across, 200_000), held, percent))
    if more.limit(1).count():
        labels = components(links.union(more))
    return sets, cut(labels)


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    sets, labels = join(docs, shingle, percent)
    per_set = sets.filter("n > 0").groupBy("key", "check").agg(F.min("doc_id").alias("least"))
    placed = per_set.join(labels, per_set["key"] == labels["node"], "left").select("key", "check", "least", F.coalesce("component", "key").alias("component"), F.col("component").isNotNull().alias("linked"))
    named = placed.filter("linked").groupBy("component").agg(F.min("least").alias("smallest"))
    placed = placed.join(named, "component", "left").select(F.col("key").alias("k"), F.col("check").alias("c"), F.coalesce("smallest", "least").alias("smallest"))
    rows = sets.join(placed, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c")) & (F.col("n") > 0), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("component_id"))


def keep_rows(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, and one without an id only where none has one.

    Rows are told apart by id and text: rows that share an id, or have none, are of one group only where their
    texts are.  A row without words is of no group and stays.
    """
    sets, labels = join(docs, shingle, percent)
    # nulls come first in an order, so a mark before the id puts rows without one last
    per_set = sets.filter("n > 0").groupBy("key", "check").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ref", "t")).alias("least"))
    placed = per_set.join(labels, per_set["key"] == labels["node"], "left").select("least", F.coalesce("component", "key").alias("c"), F.when(F.col("component").isNull(), F.col("check")).alias("d"))
    chosen = placed.groupBy("c", "d").agg(F.min("least").alias("least")).select(F.col("least.ref").alias("__ref"), F.col("least.t").alias("__t"))
    copies = sets.filter("n > 0").groupBy(F.col("ref").alias("__ref"), F.col("t").alias("__t")).agg(F.count("*").alias("__copies"))
    chosen = cut(chosen.join(copies, ["__ref", "__t"]))
    # narrow rows are chosen first; texts are dealt out once, and hashed against the chosen ones without a sort
    marked = docs.withColumn("__ref", _reference()).withColumn("__t", _text_hash())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = marked.join(chosen.filter("__copies = 1").hint("shuffle_hash"), ["__ref", "__t"]).select(*columns)
    repeated = chosen.filter("__copies > 1").drop("__copies")
    if repeated.limit(1).count():
        # equal rows fall together in every task before they are dealt out, however many they are
        small = sized(repeated, 200_000)
        once = marked.join(small, ["__ref", "__t"], "left_semi").dropDuplicates(["__ref", "__t"])
        kept = kept.union(once.select(*columns))
    wordless = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    return kept.union(docs.filter(wordless).select(*columns))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``keep_rows`` without the rows that have no id."""
    return keep_rows(docs, shingle, percent).filter("doc_id is not null")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
