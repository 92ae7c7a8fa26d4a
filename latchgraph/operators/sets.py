"""Set operations over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import first_wins


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` put over those of equal key."""
    both = changes.withColumn("__order", F.lit(0)).unionByName(base.withColumn("__order", F.lit(1)))
    return first_wins(both, keys, ["__order"]).drop("__order")


def effective(builtin: DataFrame, removed: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(built-in without removed) with additions put over it: an addition wins over a removal."""
    return upsert(builtin.join(removed.select(*keys), [*keys], "left_anti"), added, keys)


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), [*keys], "left_anti")
