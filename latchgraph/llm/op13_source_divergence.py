"""How far sources of a language differ from one another, and by which terms.

Terms are runs of ASCII letters and of non-ASCII characters, A-Z lower-cased.  A language keeps the terms that at least
``min_docs`` of its documents have.  With the counts of kept terms in a source's documents, smoothed by ``PRIOR`` and scaled to
integers, each pair of sources of a language gets the sum over all kept terms of floor((p - q)^2 / (p + q)), and each source
its leading terms against the language as a whole.

Tasks count terms of their documents in dictionary-encoded Arrow arrays; Spark adds up the counts.  The counted rows are then
dealt by range of (language, term), about ``RANGE_ROWS`` at a time, so that a range holds all rows of its terms: it drops terms in too few
documents, keeps the sorted array of the others in chunks of at most ``CHUNK`` terms, finds each row's id by binary search and gives one
sparse vector of ids and counts per source and chunk.  Ids rise with the terms' UTF-8 order, so ties are broken by comparing (chunk, id).

Pairs: sources of a language fall into hash blocks of about ``BLOCK``; for each chunk and pair of blocks a task lays the vectors out
densely (a bincount for each source) and sums f over the chunk.  Spark adds up the chunks.  What a task holds is bounded by
blocks and chunks, however many documents, terms or sources there are; the result has a row for each ordered pair of sources by definition.

All numbers are integers of 64 bits: shares are divided in three steps of a factor 1000, exact for less than 2^53 counted terms.

Defined cases: null text, lang and source are empty texts; repeated rows and ids are documents of their own, null ids as well; a text
without terms still makes its group occur; a language without kept terms has pairs of value 0 and no terms; a language with one source
has no pairs; ties go by the item's UTF-8 order; columns other than text, lang and source are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import cut, partitions, table
from ._words import give_back, pieces

MIN_DOCS = 10
TOP = 10
PRIOR = 2
SCALE_STEPS, SCALE_STEP = 3, 1000  # 1000000000 in steps that do not overflow
CHUNK = 16_384
RANGE_ROWS = 500_000
BLOCK = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of each term and the terms, in the order of the texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, count=texts.offset + n + 1)[texts.offset :]
    raw = np.frombuffer(data, np.uint8, count=int(off[-1]))[off[0] :] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    inside = _TERM[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = off[:-1][off[:-1] < len(raw)]
    begins[starts] = inside[starts]
    at = np.flatnonzero(begins)
    # the kept bytes one after another, and where terms begin among them
    kept = np.append(np.cumsum(inside) - inside, inside.sum())
    bounds = np.append(kept[at], kept[-1])
    terms = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(_LOWER[raw[inside]]))
    return np.searchsorted(off, at, side="right") - 1, terms.dictionary_encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            groups = pa.table({"lang": piece.column(1), "source": piece.column(2)})
            names = groups.group_by(["lang", "source"], use_threads=False).aggregate([])
            code = {k: i for i, k in enumerate(zip(*(c.to_pylist() for c in names.columns), strict=True))}
            group = np.array([code[k] for k in zip(*(c.to_pylist() for c in groups.columns), strict=True)], np.int64)
            row, terms = terms_of(piece.column(0))
            size = max(1, len(terms.dictionary))
            term = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            document, times = np.unique(row * size + term, return_counts=True)
            key, place = np.unique(group[document // size] * size + document % size, return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, place, times)
            docs = np.bincount(place, minlength=len(key))
            # each group occurs, be it without terms
            at = pa.array(np.concatenate((key // size, np.arange(len(code)))))
            which = pa.array(np.concatenate((key % size, np.zeros(len(code), np.int64))), mask=np.arange(len(key) + len(code)) >= len(key))
            zeros = np.zeros(len(code), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(names.column(c).combine_chunks().take(at).cast(pa.string()) for c in ("lang", "source")),
                    terms.dictionary.take(which).cast(pa.string()),
                    pa.array(np.concatenate((n, zeros))),
                    pa.array(np.concatenate((docs, zeros))),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        give_back()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it); a row with a null term for each group."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Where rows of sorted columns begin to differ from those before, with the end."""
    n = len(columns[0])
    differs = np.zeros(max(0, n - 1), bool)
    for c in columns:
        differs |= pc.not_equal(c.slice(1), c.slice(0, max(0, n - 1))).to_numpy(zero_copy_only=False) if n > 1 else False
    return np.concatenate(([0], np.flatnonzero(differs) + 1, [n])) if n else np.zeros(1, np.int64)


def dictionary(counted: DataFrame, min_docs: int = MIN_DOCS, chunk_size: int = CHUNK) -> DataFrame:
    """Sorted chunks of each language's kept terms, and each source's counts in them.

    Rows with a null source carry a chunk's ``terms``; the others a source's ``ids`` in the chunk, their counts ``n`` and the language's counts ``all_n``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = list(batches)
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        number = 0
        out: list[tuple] = []
        if rows is not None and len(rows):
            lang, source, term = (rows.column(c).combine_chunks().cast(pa.large_binary()) for c in ("lang", "source", "term"))
            n, docs = (rows.column(c).to_numpy() for c in ("n", "docs"))
            starts = _runs([lang, term])
            kept = np.add.reduceat(docs, starts[:-1]) >= min_docs
            total = np.add.reduceat(n, starts[:-1])
            first, size = starts[:-1][kept], np.diff(starts)[kept]
            total = total[kept]
            langs = lang.take(pa.array(first))
            cuts = _runs([langs])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for lo in range(a, b, chunk_size):
                    hi = min(b, lo + chunk_size)
                    words = term.take(pa.array(first[lo:hi]))
                    name = langs[lo].as_py().decode()
                    chunk = (part << 32) + number
                    number += 1
                    out.append((name, chunk, None, hi - lo, None, None, None, words))
                    at = np.repeat(first[lo:hi] - (np.cumsum(size[lo:hi]) - size[lo:hi]), size[lo:hi]) + np.arange(size[lo:hi].sum())
                    sources = source.take(pa.array(at)).dictionary_encode()
                    # rows of the chunk in sorted order: the place of each one's term among the chunk's terms
                    ids = np.searchsorted(first[lo:hi], at, side="right") - 1
                    order = np.argsort(sources.indices.to_numpy(), kind="stable")
                    which = sources.indices.to_numpy()[order]
                    bounds = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which))
                    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        i = order[x:y]
                        out.append((name, chunk, sources.dictionary[int(which[x])].as_py().decode(), hi - lo, ids[i], n[at[i]], total[lo:hi][ids[i]], None))
                    yield made(out)
                    out = []
        give_back()

    def made(out: list[tuple]) -> pa.RecordBatch:
        long_lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in out], pa.string()),
                pa.array([r[1] for r in out], pa.int64()),
                pa.array([r[2] for r in out], pa.string()),
                pa.array([r[3] for r in out], pa.int64()),
                *(pa.array([r[i] for r in out], long_lists) for i in (4, 5, 6)),
                pa.array([r[7].cast(pa.large_string()).to_pylist() if r[7] is not None else None for r in out], pa.list_(pa.string())),
            ],
            ["lang", "chunk", "source", "size", "ids", "n", "all_n", "terms"],
        )

    rows = counted.filter("term IS NOT NULL")
    ranges = max(partitions(counted.sparkSession), rows.count() // RANGE_ROWS)
    ranged = rows.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term", "source")
    return cut(ranged.mapInArrow(run, "lang string, chunk long, source string, size long, ids array<long>, n array<long>, all_n array<long>, terms array<string>"))


def share(n: np.ndarray, total, kept) -> np.ndarray:
    """1 + floor(10^9 * (n + 2) / (total + 2 * kept)), by long division."""
    whole = np.asarray(total + PRIOR * kept, np.int64)
    rest = np.asarray(n, np.int64) + PRIOR
    out = rest // whole
    rest = rest % whole
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        out = out * SCALE_STEP + rest // whole
        rest = rest % whole
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pairs(groups: DataFrame, vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, item (another source of the language) and value.

    ``groups``: lang, source, total (of counts of kept terms), kept (the language's number of kept terms), sources (of the language).
    """
    blocks = F.ceil(F.col("sources") / block).cast("int")
    placed = groups.select("lang", "source", "total", "kept", blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("b"))
    lists = placed.groupBy("lang", "b").agg(F.collect_list(F.struct("source", "total")).alias("members"))
    # one chunk without terms for each language, so that every pair comes up
    chunks = vectors.filter("source IS NULL").select("lang", "chunk", "size").unionByName(placed.select("lang", F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("size")).distinct())
    langs = placed.select("lang", "blocks", "kept").distinct()
    chunks = chunks.join(langs, "lang").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("y", F.explode(F.sequence("x", F.col("blocks") - 1)))
    lefts, rights = (lists.select("lang", F.col("b").alias(b), F.col("members").alias(m)) for b, m in (("x", "left"), ("y", "right")))
    none = F.lit(None)
    heads = chunks.join(lefts, ["lang", "x"]).join(rights, ["lang", "y"]).select("lang", "chunk", "x", "y", "size", "kept", "left", "right", none.cast("string").alias("source"), none.cast("array<long>").alias("ids"), none.cast("array<long>").alias("n"))
    mine = vectors.filter("source IS NOT NULL").join(placed.select("lang", "source", "blocks", "b"), ["lang", "source"])
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    empty = F.lit(None).cast(lists.schema["members"].dataType)
    mine = mine.select("lang", "chunk", F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y"), "size", F.lit(None).cast("long").alias("kept"), empty.alias("left"), empty.alias("right"), "source", "ids", "n")

    def made(out: list[tuple], lang: str) -> pa.Table:
        kinds = [pa.string(), pa.string(), pa.int64()]
        return pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["lang", "source", "item", "value"])

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names = rows.column("source").to_pylist()
        if None not in names:  # one of the two blocks has no source
            return made([], "")
        head = {c: rows.column(c)[names.index(None)].as_py() for c in ("lang", "x", "y", "size", "kept", "left", "right")}
        size, kept = head["size"], head["kept"]
        place = {s: i for i, s in enumerate(names)}

        def dense(members: list[dict]) -> np.ndarray:
            """A row of shares for each source, over all terms of the chunk."""
            out = np.zeros((len(members), size), np.int64)
            for i, m in enumerate(members if size else []):
                n = out[i]
                if (at := place.get(m["source"])) is not None:
                    ids, times = (rows.column(c)[at].values.to_numpy() for c in ("ids", "n"))
                    n = np.bincount(ids, weights=times, minlength=size).astype(np.int64)
                out[i] = share(n, m["total"], kept)
            return out

        left, right = head["left"], head["right"]
        p = dense(left)
        q = p if head["x"] == head["y"] else dense(right)
        out: list[tuple] = []
        for i, m in enumerate(left):
            others = range(i + 1, len(right)) if head["x"] == head["y"] else range(len(right))
            values = distance(p[i], q[others.start :]).sum(axis=1) if size else np.zeros(len(others), np.int64)
            for j, v in zip(others, values.tolist(), strict=True):
                out += [(m["source"], right[j]["source"], v), (right[j]["source"], m["source"], v)]
        return made(out, head["lang"])

    solved = heads.unionByName(mine).groupBy("lang", "chunk", "x", "y").applyInArrow(solve, "lang string, source string, item string, value long")
    return solved.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def leading_terms(groups: DataFrame, langs: DataFrame, vectors: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item (a term that the source has more often than the language), value and rank up to ``top``."""
    rows = vectors.filter("source IS NOT NULL").join(groups.select("lang", "source", "total", "kept"), ["lang", "source"]).join(langs.select("lang", "lang_total"), "lang")
    rows = rows.select("lang", "source", "chunk", "ids", "n", "all_n", "total", "kept", "lang_total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(len(batch)):
                ids, n, all_n = (batch.column(c)[i].values.to_numpy() for c in ("ids", "n", "all_n"))
                lang, source, chunk, total, kept, lang_total = (batch.column(c)[i].as_py() for c in ("lang", "source", "chunk", "total", "kept", "lang_total"))
                p, q = share(n, total, kept), share(all_n, lang_total, kept)
                f = distance(p, q)
                more = np.flatnonzero(p > q)
                best = more[np.lexsort((ids[more], -f[more]))[:top]]
                out += [(lang, source, chunk, int(ids[j]), int(f[j])) for j in best]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["lang", "source", "chunk", "id", "value"])

    best = rows.mapInArrow(run, "lang string, source string, chunk long, id long, value long")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "chunk", "id"))).filter(F.col("rank") <= top)
    words = vectors.filter("source IS NULL").select("chunk", F.posexplode("terms").alias("id", "item")).withColumn("id", F.col("id").cast("long"))
    return best.join(words, ["chunk", "id"]).select("lang", "source", "item", "value", "rank")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, chunk_size: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    counted = cut(counts(docs))
    vectors = dictionary(counted, min_docs, chunk_size)
    sums = vectors.filter("source IS NOT NULL").groupBy("lang", "source").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    kept = vectors.filter("source IS NULL").groupBy("lang").agg(F.sum("size").alias("kept"))
    nought = F.lit(0).cast("long")
    groups = counted.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources")).join(kept, "lang", "left")
    groups = cut(groups.join(langs, "lang").select("lang", "source", F.coalesce("total", nought).alias("total"), F.coalesce("lang_total", nought).alias("lang_total"), F.coalesce("kept", nought).alias("kept"), "sources"))
    langs = groups.select("lang", "lang_total").distinct()
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    both = pairs(groups, vectors, block).withColumn("rank", rank)
    terms = leading_terms(groups, langs, vectors, top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return both.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
