"""Bottom-k fingerprints of five-word shingles.

A fingerprint is the ascending list of the ``SIZE`` smallest 64-bit hashes of a text's distinct
shingles (words lower-cased A-Z; fewer than five words make one shingle), written in base 64.
Fingerprints of parts merge into that of the whole, and estimate resemblance, containment and the
number of distinct shingles; with up to ``SIZE`` shingles all three are exact.

The query needs each document's successor by doc_id.  Documents go to ranges of (doc_id, text hash): ids are cut at
quantiles, and ids with very many rows, or rows without an id, are split by the hash (only rows equal in both stay together).  The first document of each range is sent to the range before as well, so texts are shuffled
once and every pair of neighbours meets in one sorted partition.

Defined cases: a null or empty text has the empty fingerprint; two empty fingerprints are alike (1),
an empty and a filled one are not (0); texts of any length are taken whole; columns other than doc_id and text are
not looked at; rows with the same doc_id follow each other by text hash, then
as they come; null ids stand last; the only row of a table is its own successor; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import partitions, table
from ._words import Words

SIZE = 128
WORDS = 5


def sketch(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The ``size`` smallest distinct hashes, ascending."""
    if len(hashes) > 8 * size:
        # among the 4k smallest there are k distinct ones unless shingles repeat a lot
        least = np.unique(np.partition(hashes, 4 * size)[: 4 * size])
        if len(least) >= size:
            return least[:size]
    return np.unique(hashes)[:size]


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, size)
    both = np.intersect1d(a, b, assume_unique=True)
    return len(np.intersect1d(union, both, assume_unique=True)) / len(union)


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    return float(len(a)) if len(a) < size else (size - 1) * 2.0**64 / float(a[size - 1])


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The estimated part of a's shingles that b has too."""
    if not len(a):
        return 1.0
    union = merge(a, b, size)
    scale = distinct(union, size) / len(union)
    both = len(np.intersect1d(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True))
    return min(1.0, both * scale / distinct(a, size))


def write(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    hashes, first = Words(texts, lower=True).shingles(WORDS)
    return [sketch(hashes[a:b], size) for a, b in zip(first[:-1], first[1:], strict=True)]


def fingerprint(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id and fingerprint of every text, without a shuffle."""
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [write(s) for s in sketches(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fingerprint string")


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds __range and __ahead (true for a copy of the next range's first row); the order of keys wraps around."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    found = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges), F.count("*"), F.count("doc_id")).first()
    # an id that is several quantiles at once has as many ranges, and so have rows without an id: they are split by their text's hash
    cuts = sorted(Counter(found[0] or []).items())
    limits = [c for c, _ in cuts]
    widths = [1, *(m for _, m in cuts)]
    bases = [sum(widths[:i]) for i in range(len(widths))]
    nulls = max(1, math.ceil((found[1] - found[2]) * ranges / max(1, found[1])))
    part = F.col("__h") / float(1 << 64) + 0.5  # where the hash lies between the least and the greatest
    split = lambda m: F.least(F.floor(part * m), m - 1)
    # the number of cuts at or below an id, by a search over a literal of at most `ranges` numbers
    at = F.size(F.filter(F.array(*[F.lit(c) for c in limits]), lambda x: x <= F.col("doc_id"))) if limits else F.lit(0)
    rows = rows.withColumn("__at", at)
    width = F.get(F.array(*[F.lit(m) for m in widths]), F.col("__at"))
    inner = F.when(F.get(F.array(*[F.lit(c) for c in limits]), F.col("__at") - 1) == F.col("doc_id"), split(width)).otherwise(width - 1) if limits else F.lit(0)
    number = F.when(F.col("doc_id").isNull(), sum(widths) + split(F.lit(nulls))).otherwise(F.get(F.array(*[F.lit(b) for b in bases]), F.col("__at")) + inner).cast("int")
    rows = rows.withColumn("__range", number).drop("__at")
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__h")
    heads = rows.groupBy("__range").agg(F.min(key).alias("k")).orderBy("__range").collect()
    if not heads:
        return rows.withColumn("__ahead", F.lit(False))
    before = {h["__range"]: heads[i - 1]["__range"] for i, h in enumerate(heads)}
    nth = F.create_map(*[F.lit(x) for h in heads for x in (h["__range"], h["k"]["__h"])])
    ids = F.create_map(*[F.lit(x) for h in heads if h["k"]["doc_id"] is not None for x in (h["__range"], h["k"]["doc_id"])]) if any(h["k"]["doc_id"] is not None for h in heads) else None
    head_id = F.try_element_at(ids, F.col("__range")) if ids is not None else F.lit(None)
    is_head = (F.col("__h") == F.try_element_at(nth, F.col("__range"))) & F.col("doc_id").eqNullSafe(head_id)
    previous = F.try_element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("__range"))
    places = F.array_compact(F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("a")), F.when(is_head, F.struct(previous.alias("r"), F.lit(True).alias("a")))))
    rows = rows.withColumn("__place", F.explode(places))
    return rows.select("doc_id", "text", "__h", F.col("__place.r").alias("__range"), F.col("__place.a").alias("__ahead"))


def compare_with_edits(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text and of its edited text, with the likenesses to that and to the next text."""
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()
    n = partitions(docs.sparkSession)
    rows = _ranged(docs, 4 * n).repartition(n, "__range").sortWithinPartitions("__range", "__ahead", F.col("doc_id").asc_nulls_last(), "__h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows that wait for their successor
        size_held = 0
        kind = None

        def solve(group: list[tuple]) -> pa.RecordBatch:
            """All but the last row of ``group``, whose members follow each other in one range."""
            todo = [i for i in range(len(group) - 1) if not group[i][3] and group[i][2] == group[i + 1][2]]
            texts = [g[1] for g in group]
            edited = []
            for i in todo:
                m = len(texts[i]) // 4
                edited.append(texts[i][: len(texts[i]) - m] + texts[i + 1][:m])
            own = sketches(pa.array(texts, pa.large_string()), size)
            other = sketches(pa.array(edited, pa.large_string()), size)
            near = [resemblance(own[i], e, size) for i, e in zip(todo, other, strict=True)]
            after = [resemblance(own[i], own[i + 1], size) for i in todo]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([group[i][0] for i in todo], kind),
                    pa.array([len(texts[i]) for i in todo], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
                    pa.array([write(own[i]) for i in todo], pa.string()),
                    pa.array([write(e) for e in other], pa.string()),
                    pa.array(near, pa.float64()),
                    pa.array(after, pa.float64()),
                ],
                names,
            )

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__range", "__ahead")), strict=True):
                held.append(row)
                size_held += len(row[1])
                if size_held > 1 << 20 and len(held) > 1:
                    yield solve(held)
                    held, size_held = [row], len(row[1])
        if len(held) > 1:
            yield solve(held)

    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
