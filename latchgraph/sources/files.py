"""Source files of projects as a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import excluded, module_of, relative_path
from .config import Config

COLUMNS = "project string, path string, module string, is_package boolean, is_stub boolean, is_first_party boolean, content_hash string, content binary, full string, root string"


_ROOTS = "project string, root string, order int, first_party boolean, exclude array<string>"
_LISTED = f"{_ROOTS}, path string"


def _listed(spark: SparkSession, roots: list[tuple]) -> DataFrame:
    """The ``.py`` and ``.pyi`` files under each root, with the root's columns.

    Spark's readers pass over names that begin with an underscore, such as ``__init__.py``.  Roots without a
    scheme are therefore listed and read by the executors, which must share the mount, one task for every root at
    most; one with a scheme goes through the ``binaryFile`` reader.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                paths = sorted(os.path.join(folder, f) for folder, _, names in os.walk(row["root"]) for f in names if f.endswith((".py", ".pyi")))
                for at in range(0, len(paths), 4096):
                    some = paths[at : at + 4096]
                    yield pa.RecordBatch.from_pylist([row | {"path": p} for p in some], schema=batch.schema.append(pa.field("path", pa.string())))

    near, far = [r for r in roots if "://" not in r[1]], [r for r in roots if "://" in r[1]]
    found = spark.createDataFrame(near, _ROOTS).repartition(max(1, min(len(near), 10_000)), "root").mapInArrow(walk, _LISTED)
    for project, root, order, first_party, exclude in far:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py*").load(root).select("path")
        fixed = F.lit(project).alias("project"), F.lit(root).alias("root"), F.lit(order).alias("order"), F.lit(first_party).alias("first_party"), F.array(*[F.lit(x) for x in exclude]).cast("array<string>").alias("exclude")
        found = found.unionByName(names.select(*fixed, "path"))
    return found


def contents(files: DataFrame) -> DataFrame:
    """``files`` (with the column ``full``) and the content of each."""
    near = files.filter(~F.col("full").contains("://"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                piece = batch.slice(row, 1)
                with open(piece.column("full")[0].as_py(), "rb") as f:
                    yield piece.append_column("content", pa.array([f.read()], pa.binary()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema)
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = near.repartition(n, "project", "path").mapInArrow(run, f"{schema}, content binary")
    roots = [r["root"] for r in files.filter(F.col("full").contains("://")).select("root").distinct().collect()] if _any_remote(files) else []
    for root in roots:  # one reader for each root with a scheme
        held = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py*").load(root).select(F.col("path").alias("full"), "content")
        read = read.unionByName(files.filter(F.col("root") == root).join(held, "full"))
    return read


def _any_remote(files: DataFrame) -> bool:
    return bool(files.filter(F.col("full").contains("://")).limit(1).count())


def listed(spark: SparkSession, configs: Sequence[Config]) -> DataFrame:
    """One row per ``.py`` file of a source root and per ``.pyi`` file of a source or stub root.

    ``path`` is relative to the project.  Of a path found under several roots the last one counts; a stub
    root comes after source roots.  Exclusions apply before anything is read.
    """
    roots = [
        (c.root, root, order, first_party, list(c.exclude))
        for c in configs
        for order, (root, first_party) in enumerate([(r, True) for r in c.roots] + [(r, False) for r in c.stub_paths])
    ]
    return chosen(_listed(spark, roots))


def chosen(rows: DataFrame) -> DataFrame:
    """The files that count of what was found under each root, classified."""
    whole = F.regexp_replace("path", "^file:/+", "/")
    rows = rows.select(
        "project", "root", "order", "exclude",
        relative_path(whole, F.col("project")).alias("path"),
        module_of(relative_path(whole, F.col("root"))).alias("module"),
        whole.endswith("/__init__.py").alias("is_package"),
        whole.endswith(".pyi").alias("is_stub"),
        F.col("first_party").alias("is_first_party"),
        whole.alias("full"),
    )
    wanted = F.col("is_stub") | (F.col("is_first_party") & F.col("path").endswith(".py"))
    rows = rows.filter(wanted & ~excluded(F.col("path"), F.col("exclude")))
    last = F.row_number().over(Window.partitionBy("project", "path").orderBy(F.desc("order")))
    return rows.withColumn("__n", last).filter("__n = 1").drop("__n", "order", "exclude")


def read(spark: SparkSession, configs: Sequence[Config]) -> DataFrame:
    """``listed`` files with their contents and hashes."""
    if not configs:
        return spark.createDataFrame([], COLUMNS)
    return contents(listed(spark, configs)).select("project", "path", "module", "is_package", "is_stub", "is_first_party", F.sha2("content", 256).alias("content_hash"), "content", "full", "root")


def from_texts(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Files from (project, path, text) tuples, all first-party unless they end in ``.pyi``."""
    frame = spark.createDataFrame([(p, f, t.encode()) for p, f, t in rows], "project string, path string, content binary")
    return frame.select("project", "path", module_of(F.col("path")).alias("module"), F.col("path").endswith("__init__.py").alias("is_package"), F.col("path").endswith(".pyi").alias("is_stub"), (~F.col("path").endswith(".pyi")).alias("is_first_party"), F.sha2("content", 256).alias("content_hash"), "content")
