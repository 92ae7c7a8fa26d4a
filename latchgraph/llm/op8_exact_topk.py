"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are grouped by their nearest pivot (pivots: a bounded, hash-ordered sample of the distinct
vectors).  Each group is summed up by its pivot, its radius and its number of vectors.  For a query q
and a group (pivot p, radius r), Cauchy-Schwarz bounds every score from both sides by q.p -/+ |q| r.
The lower bounds of enough vectors, and the real scores of the pivots (as many more as the query's id has
rows, which are no candidates of it), give a threshold per query; a query is replicated only to groups whose
upper bound (that one, or |q| times the group's greatest length) reaches it.  Groups are split into blocks of bounded size by a hash of the id, so a
vector that a third of all rows share is no large task; blocks are solved as matrix products, and the
block results of a query are merged by a bounded top-k.

Scores are products of integers floor(scale * x).  They are computed in doubles, in limbs where a
product could pass 2**53, so all are exact; a score beyond 64 bits raises an error.

Defined cases: a vector that is null, empty or holds null or non-finite components takes no part;
vectors of different lengths do not meet; ties go to the smaller vec_id; a row without an id takes no
part; rows with one id are candidates of their own, a query excludes all rows with its id, and each
distinct query vector of an id gets a list; an empty table gives an empty result; columns other than
vec_id and embedding are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import sized
from ._tables import cut, partitions, table

SCALE = 256
TOP = 5
PIVOTS = (64, 1024)
PER_PIVOT = 1024
BLOCK = 2048
_EXACT = 1 << 53


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(finite & (F.size(embedding) > 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer-valued doubles, exactly, as int64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    if max(abs(int(x)) for x in whole.ravel()) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return whole.astype(np.int64)


class Groups(NamedTuple):
    """Summaries of groups: pivot, distance and length of the furthest and longest vector, rows, rows equal to the pivot."""

    pivots: np.ndarray
    radius: np.ndarray
    length: np.ndarray
    number: np.ndarray
    equal: np.ndarray


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest pivot and the distance to it."""
    square = (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    at = square.argmin(axis=1)
    return at, np.sqrt(((vectors - pivots[at]) ** 2).sum(axis=1))


def _reached(scores: np.ndarray, number: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per query the score that ``wanted`` rows reach at least, if ``number[j]`` rows score ``scores[:, j]`` or more."""
    order = np.argsort(-scores, axis=1)
    enough = np.cumsum(number[order], axis=1) >= wanted
    at = np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1)
    return np.where(enough.any(axis=1), np.take_along_axis(scores, at, 1)[:, 0], -np.inf)


def _needed(query: np.ndarray, groups: Groups, top: int, own: np.ndarray | int = 1) -> np.ndarray:
    """True for each query and group that may hold one of the query's ``top`` best; ``own``: the rows of each query's id."""
    middle = query @ groups.pivots.T
    size = np.sqrt((query**2).sum(axis=1))[:, None]
    spread = size * groups.radius[None, :]
    # rounding errors of the bounds, generously
    slack = 1e-9 * (np.abs(middle) + spread + 1)
    upper = np.minimum(middle + spread, size * groups.length[None, :]) + slack
    # the rows of the query's id may all be among the rows counted, so as many more are asked for
    wanted = top + np.reshape(own, (-1, 1))
    # a pivot is a vector of the data, so its scores are real ones
    threshold = np.maximum(_reached(middle - spread - slack, groups.number, wanted), _reached(middle - slack, groups.equal, wanted))
    return upper >= threshold[:, None]


def search(vectors: DataFrame, is_query: Column, top: int = TOP, scale: int = SCALE, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's best; ``vectors`` has vec_id and embedding, other columns are
    not looked at.  ``pivots``: by default one for ``PER_PIVOT`` vectors, within ``PIVOTS``."""
    spark = vectors.sparkSession
    n = partitions(spark)
    # a double of 2**53 or more is whole already, and might not fit the long that floor() returns
    whole = lambda y: F.when(F.abs(y) < float(_EXACT), F.floor(y).cast("double")).otherwise(y)
    scaled = F.transform("embedding", lambda x: whole(F.lit(float(scale)) * x.cast("double")))
    used = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    used = used.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).withColumn("size", F.size("v"))
    lengths = used.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()
    parts = [_search(used.filter(F.col("size") == r["size"]), top, pivots or min(PIVOTS[1], max(PIVOTS[0], r["n"] // PER_PIVOT)), block, n) for r in lengths]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search(used: DataFrame, top: int, pivots: int, block: int, n: int) -> DataFrame:
    sample = used.select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(pivots).collect()
    centre = np.array([r["v"] for r in sample], np.float64)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, distance = _nearest(_matrix(batch.column(1)), centre)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(distance, pa.float64())], ["vec_id", "v", "q", "g", "d"])

    grouped = cut(used.select("vec_id", "v", "q").mapInArrow(group, "vec_id long, v array<double>, q boolean, g int, d double"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    summary = grouped.groupBy("g").agg(F.max("d").alias("r"), F.max(length).alias("m"), F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("e")).orderBy("g").collect()
    filled = np.array([s["g"] for s in summary], np.int64)
    column = lambda name: np.array([s[name] for s in summary])
    groups = Groups(centre[filled], column("r") * (1 + 1e-12), column("m") * (1 + 1e-12), column("n"), column("e"))
    number = np.zeros(len(centre), np.int64)
    number[filled] = groups.number
    blocks = np.maximum(1, -(-number // block))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block that a batch of queries needs, with the queries packed together."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                query, ids, marks, own = _matrix(piece.column(1)), *(piece.column(c).to_numpy() for c in (0, 2, 3))
                need = _needed(query, groups, top, own)
                rows = [(int(g), s, ids[need[:, j]].tobytes(), marks[need[:, j]].tobytes(), query[need[:, j]].tobytes()) for j, g in enumerate(filled) if need[:, j].any() for s in range(int(blocks[g]))]
                if rows:
                    g, s, i, m, v = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(s, pa.int32()), pa.array(i, pa.binary()), pa.array(m, pa.binary()), pa.array(v, pa.binary())], ["g", "s", "ids", "marks", "queries"])

    def solve(data: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if data.num_rows and queries.num_rows:
            vectors, ids = _matrix(data.column("v")), data.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            vectors, ids = vectors[order], ids[order]
            for i, m, v in zip(*(queries.column(c).to_pylist() for c in ("ids", "marks", "queries")), strict=True):
                of, marks = np.frombuffer(i, np.int64), np.frombuffer(m, np.int64)
                scores = products(np.frombuffer(v, np.float64).reshape(len(of), -1), vectors)
                for q, mark, row in zip(of, marks, scores, strict=True):
                    other = np.flatnonzero(ids != q)
                    s = row[other]
                    if len(s) > 4 * top:
                        # everything at or above the top-th score, then ties by id (ids ascend)
                        least = np.partition(s, len(s) - top)[len(s) - top]
                        keep = s >= least
                        other, s = other[keep], s[keep]
                    best = np.lexsort((ids[other], -s))[:top]
                    found += [(int(q), int(mark), int(ids[other[b]]), int(s[b])) for b in best]
        q, m, i, s = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "mark": pa.array(m, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    counts = F.array(*[F.lit(int(b)) for b in blocks])
    data = grouped.withColumn("s", F.pmod(F.xxhash64("vec_id", F.hash("v")), F.get(counts, F.col("g"))).cast("int")).select("g", "s", "vec_id", "v")
    repeated = grouped.groupBy("vec_id").agg(F.count("*").alias("own"), F.max("q").alias("q")).filter("q and own > 1").select("vec_id", "own")
    asked = grouped.filter("q").select("vec_id", "v", F.xxhash64("v").alias("mark")).dropDuplicates(["vec_id", "mark"])
    asked = asked.join(sized(cut(repeated), 200_000), "vec_id", "left").select("vec_id", "v", "mark", F.coalesce("own", F.lit(1)).alias("own"))
    queries = asked.mapInArrow(replicate, "g int, s int, ids binary, marks binary, queries binary")
    solved = data.repartition(n, "g", "s").groupBy("g", "s").cogroup(queries.repartition(n, "g", "s").groupBy("g", "s")).applyInArrow(solve, "query_id long, mark long, vec_id long, score long")
    # the rank filter cuts every task's rows to `top` per query before they are dealt out
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = solved.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0)
