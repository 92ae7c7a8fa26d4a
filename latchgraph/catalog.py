"""All queries of the library by name, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import generated, sources, tables  # noqa: F401  (sources adds its queries to the tables' own)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return tables.QUERIES | {"ana_generated_project": generated.generated_project_report}


def oracle_sql() -> dict[str, str]:
    return tables.SQL | {"ana_generated_project": generated.SQL}
