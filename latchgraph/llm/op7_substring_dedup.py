"""Substring dedup by de Bruijn compaction.

Every window of ``window`` consecutive words is an edge of the de Bruijn graph of the corpus.  Edges
that follow each other in a document and share their minimizer (the least hash among the k-mers of
the window, leftmost on ties) form one compacted path.  Equal windows have equal minimizers, so all
occurrences of an edge lie on paths with one minimizer:

1. paths meet by (minimizer, path hash): each learns whether the same path starts earlier elsewhere,
   and whether its minimizer has other paths as well (a branching);
2. where it does not branch, the path's first coordinates decide about all its windows; only the first
   occurrences of a branching path (rows may share coordinates) are unfolded, and their windows meet by
   (window hash, minimizer);
3. coordinates (doc_id, first word) assemble the spans that are removed.

Keys are 128 bits (two independent hashes).  Chunks and buckets exchange packed keys and one-byte
answers (see ``_exchange``), so texts are shuffled once and a passage shared by a third of all
documents is one key per chunk.

Defined cases: a null or empty text has no words; rows with the same doc_id share coordinates, so of
two identical rows neither is earlier; null ids count as one document after all others; a text shorter
than a window loses nothing; an empty table gives an empty result; extra columns pass through
``remove_repeats`` whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._exchange import bucket_of, chunked, firsts, in_order, layout, pack, spans, unpack
from ._tables import partitions, table
from ._words import Words, inverse, mix, power_at, powers

WINDOW = 20
KMER = 6
_K_BASE, _PATH_BASE, _EDGE_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_REQUEST = "__bucket int, __chunk int, a binary, b binary, doc binary, start binary"
_REPLY = "__chunk int, bucket int, round int, reply binary"


def _runs(h: np.ndarray, base: int, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of h[b:b + n] for each pair."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)), dtype=np.uint64)))
    return mix((sums[begin + length] - sums[begin]) * power_at(inverse(base), begin) + length.astype(np.uint64))


class _Chunk:
    """The compacted paths of one chunk of documents."""

    def __init__(self, rows: pa.Table, window: int, kmer: int):
        self.rows = in_order(rows)
        self.window = window
        self.words = words = Words(self.rows.column("text"), lower=False)
        ids = self.rows.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False) if not self.rows.column("doc_id").null_count else np.array([np.iinfo(np.int64).max if x is None else x for x in self.rows.column("doc_id").to_pylist()], np.int64)
        self.ids = ids.astype(np.int64)
        h, counts = words.hash, words.counts
        valid = np.zeros(len(h), bool)
        number = np.maximum(counts - window + 1, 0)
        for a, n in zip(words.first[:-1][number > 0], number[number > 0], strict=True):
            valid[a : a + n] = True
        self.at = at = np.flatnonzero(valid)
        if not len(at):
            self.begin = self.length = np.zeros(0, np.int64)
            self.m = self.s = np.zeros(0, np.uint64)
        else:
            span = window - kmer + 1
            best = mix(sum((h[j : len(h) - kmer + 1 + j] * powers(_K_BASE, kmer)[j] for j in range(kmer)), np.zeros(len(h) - kmer + 1, np.uint64)))
            kmers, place, width = best, np.arange(len(best)), 1
            while width < span:
                step = min(width, span - width)
                left, right = best[:-step], best[step:]
                smaller = right < left
                place = np.where(smaller, place[step:], place[:-step])
                best = np.where(smaller, right, left)
                width += step
            place = place[at]
            head = np.flatnonzero(firsts(place))
            self.begin = at[head]
            self.length = np.diff(np.append(head, len(at)))
            self.m = kmers[place[head]]
            self.s = _runs(h, _PATH_BASE, self.begin, self.length + window - 1)
        row = np.searchsorted(words.first, self.begin, side="right") - 1
        self.doc = self.ids[row] if len(row) else np.zeros(0, np.int64)
        self.start = self.begin - words.first[row] if len(row) else np.zeros(0, np.int64)
        # entries: distinct paths with their first coordinates in this chunk
        order = np.lexsort((self.start, self.doc, self.s, self.m))
        new = firsts(self.m[order], self.s[order])
        self.entry = np.zeros(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.first = order[new]
        # of equal coordinates (rows with one doc_id) none is earlier than the other
        lead = self.first[self.entry]
        self.leads = (self.doc == self.doc[lead]) & (self.start == self.start[lead])

    def requests(self, chunk: int, buckets: int, keys: tuple[np.ndarray, np.ndarray], doc: np.ndarray, start: np.ndarray) -> list[tuple]:
        a, b = keys
        return [(k, chunk, pack(a[i:j]), pack(b[i:j]), pack(doc[i:j]), pack(start[i:j].astype(np.uint32))) for k, i, j in spans(bucket_of(a, buckets))]

    def paths(self, chunk: int, buckets: int) -> list[tuple]:
        f = self.first
        return self.requests(chunk, buckets, (self.m[f], self.s[f]), self.doc[f], self.start[f])

    def answers(self, replies: pa.Table, number: int) -> np.ndarray:
        """The bytes answered in one round; buckets ascend as the keys did."""
        got = sorted((b, r) for b, n, r in zip(*(replies.column(c).to_pylist() for c in ("bucket", "round", "reply")), strict=True) if n == number)
        return np.concatenate([np.frombuffer(r, np.uint8) for _, r in got]) if got else np.zeros(0, np.uint8)

    def unfold(self, flags: np.ndarray) -> None:
        """The windows of paths that branch and start here first, in every row that has these coordinates: keys ascending, with their coordinates."""
        chosen = np.flatnonzero(self.leads & (flags[self.entry] == 2))
        n = self.length[chosen]
        self.edge = np.repeat(self.begin[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        w = _runs(self.words.hash, _EDGE_BASE, self.edge, np.full(len(self.edge), self.window))
        m, doc = np.repeat(self.m[chosen], n), np.repeat(self.doc[chosen], n)
        start = np.repeat(self.start[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        order = np.lexsort((start, doc, m, w))
        new = firsts(w[order], m[order])
        self.edge_entry = np.zeros(len(order), np.int64)
        self.edge_entry[order] = np.cumsum(new) - 1
        self.edge_first = order[new]
        self.edge_keys = (w[self.edge_first], m[self.edge_first])
        self.edge_at = (doc[self.edge_first], start[self.edge_first])
        lead = self.edge_first[self.edge_entry]
        self.edge_late = (doc != doc[lead]) | (start != start[lead])

    def removed(self, flags: np.ndarray, edge_flags: np.ndarray) -> np.ndarray:
        """True for each word that a repeated window covers."""
        size = len(self.words.hash)
        cover = np.zeros(size + 1, np.int64)
        whole = ~self.leads | ((flags & 1).astype(bool)[self.entry] if len(flags) else False)
        np.add.at(cover, self.begin[whole], 1)
        np.add.at(cover, (self.begin + self.length + self.window - 1)[whole], -1)
        if len(self.edge):
            late = self.edge_late | (edge_flags & 1).astype(bool)[self.edge_entry]
            np.add.at(cover, self.edge[late], 1)
            np.add.at(cover, self.edge[late] + self.window, -1)
        return np.cumsum(cover[:-1]) > 0


def _answer(number: int, branching: bool):
    def run(rows: pa.Table) -> pa.Table:
        chunk, bucket = rows.column("__chunk").to_pylist(), rows.column("__bucket").to_pylist()
        parts = [[unpack(x, t) for x in rows.column(c).to_pylist()] for c, t in (("a", np.uint64), ("b", np.uint64), ("doc", np.int64), ("start", np.uint32))]
        a, b, doc, start = (np.concatenate(p) for p in parts)
        order = np.lexsort((start, doc, b, a))
        new = firsts(a[order], b[order])
        group = np.cumsum(new) - 1
        head = order[new]
        reply = np.zeros(len(order), np.uint8)
        reply[order] = (doc[order] != doc[head][group]) | (start[order] != start[head][group])
        if branching:
            key = np.cumsum(firsts(a[head])) - 1
            reply[order] |= ((np.bincount(key)[key] > 1)[group] * 2).astype(np.uint8)
        ends = np.cumsum([len(x) for x in parts[0]])
        made = [reply[e - len(x) : e].tobytes() for x, e in zip(parts[0], ends, strict=True)]
        return pa.table({"__chunk": pa.array(chunk, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "round": pa.array([number] * len(chunk), pa.int32()), "reply": pa.array(made, pa.binary())})

    return run


def _requests(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["__bucket", "__chunk", "a", "b", "doc", "start"])


def _solve(docs: DataFrame, finish, schema: str, more: list, window: int, kmer: int) -> DataFrame:
    """``finish(chunk, removed)`` makes the output table of a chunk."""
    if not 0 < kmer <= window:
        raise ValueError("kmer must be between 1 and window")
    chunks, buckets = layout(docs)
    n = partitions(docs.sparkSession)
    dealt = chunked(docs, chunks, *more)

    def first(rows: pa.Table) -> pa.Table:
        return _requests(_Chunk(rows, window, kmer).paths(rows.column("__chunk")[0].as_py(), buckets))

    def second(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _requests([])
        chunk = _Chunk(rows, window, kmer)
        chunk.unfold(chunk.answers(replies, 1))
        return _requests(chunk.requests(rows.column("__chunk")[0].as_py(), buckets, chunk.edge_keys, *chunk.edge_at))

    def third(rows: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, window, kmer)
        flags = chunk.answers(replies, 1)
        chunk.unfold(flags)
        return finish(chunk, chunk.removed(flags, chunk.answers(replies, 2)))

    asked = dealt.groupBy("__chunk").applyInArrow(first, _REQUEST)
    one = asked.repartition(n, "__bucket").groupBy("__bucket").applyInArrow(_answer(1, True), _REPLY)
    again = dealt.groupBy("__chunk").cogroup(one.repartition(n, "__chunk").groupBy("__chunk")).applyInArrow(second, _REQUEST)
    two = again.repartition(n, "__bucket").groupBy("__bucket").applyInArrow(_answer(2, False), _REPLY)
    replies = one.unionByName(two).repartition(n, "__chunk")
    return dealt.groupBy("__chunk").cogroup(replies.groupBy("__chunk")).applyInArrow(third, schema)


def digest(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()

    def finish(chunk: _Chunk, removed: np.ndarray) -> pa.Table:
        words, shas, gone = chunk.words, [], []
        data = chunk.words.data
        sizes = np.concatenate(([0], np.cumsum([len((x or "").encode()) for x in chunk.rows.column("text").to_pylist()])))
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            drop = removed[a:b]
            kept = raw[sizes[i] : sizes[i + 1]].split()
            if n := int(drop.sum()):
                kept = compress(kept, ~drop)
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            gone.append(n)
        return pa.table({"doc_id": chunk.rows.column("doc_id"), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return _solve(docs, finish, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string", [], window, kmer)


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """The documents without their repeated spans; a text that loses nothing stays as it is, one that
    loses every word goes, and n_chars (where there is one) follows the text."""
    fields = docs.schema
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")

    def finish(chunk: _Chunk, removed: np.ndarray) -> pa.Table:
        words, texts, stays = chunk.words, [], []
        raw = words.data.tobytes()
        rows = chunk.rows.column("__row").combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) and rows.num_chunks else rows
        old = rows.field("text").to_pylist() if len(rows) else []
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            drop = removed[a:b]
            if not drop.any():
                texts.append(old[i])
                stays.append(True)
                continue
            keep = np.concatenate(([0], (~drop).astype(np.int8), [0]))
            edges = np.diff(keep)
            runs = zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)
            texts.append(" ".join(raw[words.begin[a + x] : words.end[a + y - 1]].decode("utf-8") for x, y in runs))
            stays.append(bool(texts[-1]))
        made = {}
        for j, f in enumerate(fields):
            column = rows.field(j)
            if f.name == "text":
                column = pa.array(texts, column.type)
            elif f.name == "n_chars":
                column = pa.array([c if t is o else len(t) for t, o, c in zip(texts, old, column.to_pylist(), strict=True)], column.type)
            made[f.name] = column
        return pa.table(made).filter(pa.array(stays, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return _solve(docs, finish, schema, [row], window, kmer)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
