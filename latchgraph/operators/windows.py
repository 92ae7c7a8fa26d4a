"""First-wins, last-wins, numbering and neighbour operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key.  The rank filter is pushed below the shuffle, so hot keys stay small."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_wins(rows, keys, [F.desc(c) for c in order])


def dense_ids(rows: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """0-based ids in total order without gathering all rows in one task: range partitions, then offsets."""
    return numbered(*ranged(rows, order), order, name)


def ranged(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows stored by ranges of the order with their ``__part``, and (__part, __before): the number of rows in the ranges before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return placed, counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def numbered(placed: DataFrame, offsets: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(offsets, "__part").withColumn(name, inside - 1 + F.col("__before")).drop("__part", "__before")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, last: bool = False) -> DataFrame:
    """Adds the greatest (``last``: the latest) non-null ``value`` of the key's rows up to and with each row.

    Rows are dealt by range of key and order, so a key with very many rows lies in several ranges; each range then
    takes over what the key's earlier ranges end with.  Rows that tie in the order see each other or not as they come.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    aggregate = (lambda c: F.last(c, ignorenulls=True)) if last else F.max
    combined = (lambda a, b: F.coalesce(b, a)) if last else F.greatest
    placed = written(rows.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.withColumn("__run", aggregate(F.col(value)).over(inside))
    # one row per key and range: what the range ends with, and what the ranges before it end with
    ends = within.groupBy("__part", *keys).agg(F.max_by("__run", F.struct(*order, "__run")).alias("__end") if last else F.max("__run").alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__part", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], aggregate(F.col("__end")).over(earlier).alias("__before"))
    on = within["__part"] == ends["__part"]
    for i, k in enumerate(keys):
        on = on & within[k].eqNullSafe(F.col(f"__k{i}"))
    return within.join(ends, on).select(*[within[c] for c in rows.columns], combined(F.col("__before"), F.col("__run")).alias(name))


def transitions(rows: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Rows where ``flag`` holds and does not for the next row of the key."""
    following = F.lead(flag).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__next", following).filter(flag & ~F.col("__next")).drop("__next")
