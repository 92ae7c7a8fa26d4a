"""A compact exchange between text chunks and hash buckets.

Jobs that compare word runs across a corpus have far more runs than Spark rows should be made for.
Here documents are dealt into chunks of a few megabytes; a chunk sends each hash bucket one row that
holds its distinct keys as packed arrays, the bucket answers with one byte per key in the order of
the request, and the chunk reads the answers beside its documents.  A chunk sends a key once however
often it has it, so a run that a third of all documents share meets as many rows as there are chunks.

Chunks and buckets grow in number with the text, so what one task holds does not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import partitions
from ._words import U, give_back

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = (2 << 20, 16 << 20)
BUCKETS = 2048


def pack(a: np.ndarray) -> bytes:
    """The bytes of an array, plane by plane, so that the shuffle's compression finds the even ones."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not data:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_rising(a: np.ndarray) -> bytes:
    """``pack`` of the steps of an ascending array."""
    return pack(np.diff(a, prepend=a[:1] * 0))


def unpack_rising(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def layout(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int]:
    """Numbers of chunks and buckets for the size of the text.

    A chunk sends up to one row per bucket, so small inputs get few of both.  Up to ``BUCKETS`` buckets rows grow with
    the text alone, as do buckets then, up to the larger of ``BUCKET_BYTES``; beyond that rows per chunk grow again.
    """
    n = partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(n, math.ceil(total / chunk_bytes)), max(n, math.ceil(total / min(BUCKET_BYTES[1], max(BUCKET_BYTES[0], total // BUCKETS))))


def chunked(docs: DataFrame, chunks: int, *more) -> DataFrame:
    """doc_id, text, __h (a hash of the text), __chunk and ``more``, dealt by chunk."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more).withColumn("__h", F.xxhash64("text"))
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", "__h"), F.lit(chunks)).cast("int"))
    return rows.repartition(partitions(docs.sparkSession), "__chunk")


def in_order(rows: pa.Table) -> pa.Table:
    """The rows of a chunk in an order that does not depend on how they came."""
    give_back()
    return rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("__h", "ascending")])).combine_chunks()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, by its highest bits: sorted keys have sorted buckets."""
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int32)


def spans(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run."""
    if not len(sorted_buckets):
        return []
    cuts = np.flatnonzero(np.diff(sorted_buckets)) + 1
    begins = np.concatenate(([0], cuts))
    ends = np.append(cuts, len(sorted_buckets))
    return [(int(sorted_buckets[a]), int(a), int(b)) for a, b in zip(begins, ends, strict=True)]


def firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column."""
    n = len(sorted_columns[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
        for c in sorted_columns:
            out[1:] |= c[1:] != c[:-1]
    return out
