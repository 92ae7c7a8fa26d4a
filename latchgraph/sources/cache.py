"""What runs leave for later ones: facts by content hash, and whole results by the hashes of files and configuration.

Every version of a project's cache is a folder of its own with ``facts``, ``manifest``, ``diagnostics`` and
``warnings``; the file ``current`` names the version that is complete, and is written last.  A run that dies before
leaves the former version in force.
"""

from __future__ import annotations

import hashlib
import shutil
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import storage_key
from ..names import VERSION
from ..operators import joins
from . import files as source_files
from .config import Config
from .facts import read_facts

FORMAT = f"3-{VERSION}"
_KEYS = ["project", "path", "module", "content_hash"]


def _remote(where: str) -> bool:
    return "://" in where


def delete(spark: SparkSession, where: str) -> None:
    if _remote(where):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    else:
        shutil.rmtree(where, ignore_errors=True)


def current(spark: SparkSession, where: str) -> str | None:
    """The complete version in ``where``."""
    if not _remote(where):
        path = Path(where, "current")
        return path.read_text().strip() if path.is_file() else None
    try:
        return (spark.read.text(f"{where}/current").first() or [None])[0]
    except AnalysisException:
        return None


def _switch(spark: SparkSession, where: str, version: str) -> None:
    if _remote(where):
        spark.range(1, numPartitions=1).select(F.lit(version).alias("value")).write.mode("overwrite").text(f"{where}/current")
    else:
        new = Path(where, "current.new")
        new.write_text(version)
        new.replace(Path(where, "current"))


def _load(spark: SparkSession, where: str, name: str) -> DataFrame | None:
    version = current(spark, where)
    try:
        return None if version is None else spark.read.parquet(f"{where}/{version}/{name}")
    except AnalysisException:
        return None


def clear(where: str) -> None:
    delete(SparkSession.active(), where)


def digests(files: DataFrame) -> DataFrame:
    """(project, digest, sourced): a digest of every project's paths and contents, and whether there is anything to analyse."""
    cells = F.xxhash64(*_KEYS), F.xxhash64(F.lit(1), *_KEYS)
    parts = F.concat_ws("-", F.count("*"), F.sum(cells[0].cast("decimal(20,0)")), F.bit_xor(cells[1]))
    return files.groupBy("project").agg(parts.alias("digest"), F.bool_or(F.col("is_first_party") & ~F.col("is_stub")).alias("sourced"))


def version(digest: str, config: Config, *bounds: object) -> str:
    return hashlib.sha256(repr((FORMAT, digest, config.hash(), *bounds)).encode()).hexdigest()[:32]


def results(spark: SparkSession, where: str, wanted: str) -> tuple[DataFrame, DataFrame] | None:
    """Stored diagnostics and warnings, if the complete version is the wanted one."""
    if current(spark, where) != wanted:
        return None
    found = _load(spark, where, "diagnostics"), _load(spark, where, "warnings")
    return None if any(x is None for x in found) else found


def diff(spark: SparkSession, files: DataFrame, where: str) -> DataFrame | None:
    """What changed since the cache was written: (path, change), or None without a cache."""
    manifest = _load(spark, where, "manifest")
    return None if manifest is None else joins.manifest_diff(manifest, files.select("path", "content_hash"), "path", "content_hash")


def facts(files: DataFrame, where: str) -> DataFrame:
    """The facts of ``files`` (without contents): kept ones as far as hashes agree, the rest read anew."""
    spark = files.sparkSession
    manifest, kept = _load(spark, where, "manifest"), _load(spark, where, "facts")
    if manifest is None or kept is None or manifest.filter(F.col("format") == FORMAT).limit(1).count() == 0:
        return read_facts(source_files.contents(files))
    hits, misses = joins.split_by(files, manifest.filter(F.col("format") == FORMAT).select(*_KEYS), _KEYS)
    old = kept.join(hits.select("project", "path"), ["project", "path"], "left_semi")
    return read_facts(source_files.contents(misses)).unionByName(old)


def store(where: str, wanted: str, files: DataFrame, found: DataFrame, diagnostics: DataFrame, warnings: DataFrame) -> None:
    spark = files.sparkSession
    before = current(spark, where)
    manifest = files.select(*_KEYS, storage_key(F.col("path")).alias("artifact"), F.lit(FORMAT).alias("format"))
    for name, frame in (("facts", found), ("manifest", manifest), ("diagnostics", diagnostics), ("warnings", warnings)):
        frame.write.mode("overwrite").parquet(f"{where}/{wanted}/{name}")
    _switch(spark, where, wanted)
    if before not in (None, wanted):
        delete(spark, f"{where}/{before}")
