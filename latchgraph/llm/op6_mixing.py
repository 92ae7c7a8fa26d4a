"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight and a schedule: its intensity over training time [0, 1], given at equally
spaced knots and linear between them.  The weights share a token budget; a target stops at ``cap``
times its source's size and the excess is shared anew by weight, which is a water level over
cap / weight.  Within a source documents stand in hash order.  Cumulative token demand along that
order is inverted through the integral of the schedule, which gives each copy its training position;
documents are range-sorted by position.

Running sums are taken in two levels of about sqrt(N) rows each (hash bucket within source, then
bucket totals), so a source with a third of all rows never meets in one task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows of
size 0 are never taken; texts of any length are counted whole; rows of equal hash stand in the order of their
keys and sizes; repeated rows are documents of their own; an empty table gives an empty result; extra columns pass through ``mix_documents`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import cut, partitions, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Intensity at equally spaced times; the k-th source (code point order) has schedule k modulo their number.
SCHEDULES = ((1.0, 1.0), (1.6, 1.0, 0.4), (0.4, 1.0, 1.6))
_WHITE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null gives 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` has one row per source (__source, __total); adds __order, __weight and __target.

    The two windows have one row per source and no more.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    order = F.row_number().over(by_name) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("__order", order).withColumn("__weight", F.get(cycle, F.col("__order") % len(weights)))
    ranked = ranked.withColumn("__cap", F.col("__total") * cap).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    rising = Window.orderBy("__ratio", "__order")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("__ratio", "__order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("__total").over(everything) * share - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(after)
    leveled = ranked.withColumn("__level", level)
    # the first source whose cap lies above the level that it would set fixes the level
    final = F.min(F.when(F.col("__level") < F.col("__ratio"), F.struct("__ratio", "__order", "__level"))).over(everything)["__level"]
    return leveled.withColumn("__target", F.least("__cap", F.coalesce(final * F.col("__weight"), F.col("__cap")))).select("__source", "__total", "__order", "__target")


def demand(knots: Sequence[float]) -> list[float]:
    """The integral of a piecewise linear schedule up to each of its knots."""
    upto = [0.0]
    for a, b in zip(knots, knots[1:], strict=False):
        upto.append(upto[-1] + (a + b) / 2 / (len(knots) - 1))
    return upto


def _inverse_demand(part: Column, knots: Column, upto: Column) -> Column:
    """The time at which the integral of a schedule reaches ``part`` of its whole; ``upto`` is its ``demand``."""
    n = F.size(knots) - 1
    wanted = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * F.get(upto, n)
    at = F.least(F.size(F.filter(upto, lambda x: x <= wanted)) - 1, n - 1)
    left, right = F.get(knots, at), F.get(knots, at + 1)
    rest = wanted - F.get(upto, at)
    root = F.sqrt(F.greatest(left * left + 2 * (right - left) * n * rest, F.lit(0.0)))
    step = F.when(left + root > 0, 2 * rest / (left + root)).otherwise(0.0)
    return F.least(at / n + step, F.lit(1.0))


def plan(docs: DataFrame, key: Sequence[Column], source: Column, size: Column, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """Adds to each row of ``docs`` __size, __total, __target, __copies and __positions (one time per copy)."""
    rows = docs.withColumns({"__source": source, "__size": size, "__hash": F.xxhash64(*key)})
    # sizes are counted once for all sums, in narrow rows
    narrow = cut(rows.select("__source", "__size", "__hash"))
    goals = targets(narrow.groupBy("__source").agg(F.sum("__size").alias("__total")), weights, share, cap)
    half = math.ceil(math.log2(max(2, narrow.count())) / 2)
    bucket = F.shiftrightunsigned("__hash", 64 - half)
    rows = rows.withColumn("__bucket", bucket)
    sums = narrow.groupBy("__source", bucket.alias("__bucket")).agg(F.sum("__size").alias("__in"))
    below = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__below", F.coalesce(F.sum("__in").over(below), F.lit(0))).drop("__in")
    spread = lambda lists: F.get(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in lists]), F.col("__order") % len(schedules))
    sums = sums.withColumnRenamed("__source", "__s").join(goals, F.col("__s").eqNullSafe(F.col("__source"))).drop("__s")
    sums = sums.withColumn("__knots", spread(schedules)).withColumn("__upto", spread([demand(x) for x in schedules]))
    sums = cut(sums.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__below", "__total", "__target", "__knots", "__upto"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__hash", *key, "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.repartition(partitions(docs.sparkSession), "__source", "__bucket").withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).drop("__s", "__b")
    middle = F.col("__below") + F.col("__before") + F.col("__size") / 2
    last = math.ceil(cap) - 1
    taken = [F.when((F.col("__size") > 0) & (middle + F.col("__total") * j <= F.col("__target")), _inverse_demand((middle + F.col("__total") * j) / F.col("__target"), F.col("__knots"), F.col("__upto"))) for j in range(last + 1)]
    rows = rows.withColumn("__positions", F.filter(F.array(*taken), lambda x: x.isNotNull()))
    return rows.withColumn("__copies", F.size("__positions").cast("long")).drop("__hash", "__bucket", "__before", "__below", "__knots", "__upto")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order, each as often as the mix takes it; the columns of ``docs``."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    row = F.col("__row")
    key = [row["doc_id"].alias("k0"), F.xxhash64(row["text"])]
    planned = plan(wrapped, key, row["source"], word_count(row["text"]), **options)
    copies = planned.select("__row", F.explode("__positions").alias("__position"))
    ordered = copies.repartitionByRange(partitions(docs.sparkSession), "__position", row["doc_id"]).sortWithinPartitions("__position", row["doc_id"])
    return ordered.select("__row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text's hash tells rows without an id, or with a repeated one, apart: they spread over the buckets
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    planned = plan(docs, [F.col("doc_id"), F.col("text_hash")], F.col("source"), F.col("size"))
    return planned.select(
        "doc_id",
        "size",
        F.col("__total").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("size")).alias("taken"),
        F.get("__positions", F.lit(0)).alias("first_position"),
        F.get("__positions", F.lit(1)).alias("second_position"),
    )
