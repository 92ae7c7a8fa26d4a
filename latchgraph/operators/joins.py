"""Joins of the analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dotted_prefixes
from .windows import running


def contained(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: tuple[str, str], span: tuple[str, str]) -> DataFrame:
    """Adds ``inside``: whether one of the key's ranges holds the point's whole span.

    A sweep: starts and points stand in one order, and a point lies inside iff the furthest end among the ranges that have
    begun reaches its end.  The work is linear in both sides, also where one key has very many of both.  Null keys hold nothing.
    """
    a, b = span
    known = ranges.dropna(subset=[*keys, a, b]).groupBy(*keys, a).agg(F.max(b).alias(b))
    whole = F.struct(*points.columns)
    begun = known.select(*keys, F.col(a).cast("long").alias("__at"), F.lit(0).alias("__turn"), F.col(b).cast("long").alias("__reach"), F.lit(None).cast(points.select(whole.alias("w")).schema["w"].dataType).alias("__row"))
    asked = points.select(*keys, F.col(point[0]).cast("long").alias("__at"), F.lit(1).alias("__turn"), F.lit(None).cast("long").alias("__reach"), whole.alias("__row"))
    swept = running(begun.unionByName(asked), keys, ["__at", "__turn"], "__reach", "__furthest").filter("__turn = 1")
    return swept.select("__row.*", F.coalesce(F.col("__furthest") >= F.col(f"__row.{point[1]}"), F.lit(False)).alias("inside"))


def last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, place: str, value: str, name: str, strict: bool = True) -> DataFrame:
    """The rows of ``left`` with the ``value`` of the key's last ``right`` row whose ``place`` lies before ``at`` (or, not ``strict``, at it).

    An as-of join: both sides stand in one order and the latest value is carried along, so no pairs are made.
    Rows without such a value, and rows with a null key or place, go.  Of right rows at one place the greatest value counts.
    """
    whole = F.struct(*left.columns)
    known = right.dropna(subset=[*keys, place, value]).groupBy(*keys, F.col(place).alias("__at")).agg(F.max(value).alias("__value"))
    known = known.withColumn("__turn", F.lit(1 if strict else 0)).withColumn("__row", F.lit(None).cast(left.select(whole.alias("w")).schema["w"].dataType))
    asked = left.dropna(subset=[*keys, at]).select(*keys, F.col(at).alias("__at"), F.lit(None).cast(known.schema["__value"].dataType).alias("__value"), F.lit(0 if strict else 1).alias("__turn"), whole.alias("__row"))
    carried = running(known.unionByName(asked), keys, ["__at", "__turn"], "__value", "__last", last=True)
    return carried.filter("__row is not null and __last is not null").select("__row.*", F.col("__last").alias(name))


def module_prefix(names: DataFrame, name: str, prefixes: DataFrame, prefix: str, keys: Sequence[str] = ()) -> DataFrame:
    """The rows whose dotted name equals a prefix or continues it after a dot (as an equi join over a name's own prefixes)."""
    exploded = names.withColumn("__prefix", F.explode(dotted_prefixes(F.col(name))))
    right = prefixes.select(*keys, F.col(prefix).alias("__prefix")).distinct()
    return exploded.join(right, [*keys, "__prefix"], "left_semi").drop("__prefix").distinct()


def first_match(aliases: DataFrame, keys: Sequence[str], alias: str, known: DataFrame, name: str) -> DataFrame:
    """Per key the least alias that is known."""
    return aliases.join(known.select(F.col(name).alias(alias)).distinct(), alias, "left_semi").groupBy(*keys).agg(F.min(alias).alias(alias))


def manifest_diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key and change: ``removed``, ``added`` or ``changed``."""
    old = before.select(F.col(key), F.col(content).alias("__old"))
    new = after.select(F.col(key), F.col(content).alias("__new"))
    change = F.when(F.col("__new").isNull(), "removed").when(F.col("__old").isNull(), "added").when(F.col("__old") != F.col("__new"), "changed")
    return old.join(new, key, "full_outer").select(key, change.alias("change")).filter(F.col("change").isNotNull())


def split_by(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys are known (hits) and the rest (misses)."""
    return rows.join(known, [*keys], "left_semi"), rows.join(known, [*keys], "left_anti")


def by_priority(rows: DataFrame, keys: Sequence[str], ranked: Sequence[tuple[DataFrame, str]], name: str, default: Column | None = None) -> DataFrame:
    """The first value that the ranked tables (key columns and one value each) have for a row."""
    values = []
    for i, (frame, column) in enumerate(ranked):
        rows = rows.join(frame.select(*keys, F.col(column).alias(f"__v{i}")), [*keys], "left")
        values.append(F.col(f"__v{i}"))
    if default is not None:
        values.append(default)
    return rows.withColumn(name, F.coalesce(*values)).drop(*[f"__v{i}" for i in range(len(ranked))])
