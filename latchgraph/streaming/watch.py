"""Continuous analysis: an extension beyond batch runs.

A Structured Streaming file source picks up new and changed files; each micro-batch is put over the kept
files (by project and path) and the analysis runs again on the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import module_of
from ..operators import sets, windows
from ..plans.analyze import Options, Outcome, analyze_facts
from ..session import cut
from ..sources import cache
from ..sources.config import Config
from ..sources.facts import read_facts

SCHEMA = "project string, path string, text string"


def watch(spark: SparkSession, folder: str, configs: Sequence[Config], state: str, report: Callable[[Outcome], None], options: Options = Options()) -> StreamingQuery:  # noqa: B008
    """Reads JSON lines (project, path, text) that arrive in ``folder``; ``state`` keeps the latest files.

    Of several versions of a file in one batch the one in the last written file counts, and within a file the last line.  The states of the
    last two batches are kept: a batch that is delivered again starts from the one before it.
    """
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("place")
    arriving = spark.readStream.schema(SCHEMA).json(folder).select("*", place)

    def run(batch: DataFrame, number: int) -> None:
        # ``batch`` may be empty, and may be delivered again after a failure: putting it over again changes nothing
        session = batch.sparkSession
        path = f"{state}/{number:012d}"
        before = f"{state}/{number - 1:012d}"
        numbered = batch.withColumn("line", F.monotonically_increasing_id())
        latest = windows.last_wins(numbered, ["project", "path"], ["place", "line"]).select("project", "path", "text")
        if number:
            latest = sets.upsert(session.read.parquet(before), latest, ["project", "path"])
        cut(latest).write.mode("overwrite").parquet(path)
        if number > 1:
            cache.delete(session, f"{state}/{number - 2:012d}")
        files = session.read.parquet(path).select(
            "project", "path", module_of(F.col("path")).alias("module"), F.col("path").endswith("__init__.py").alias("is_package"), F.col("path").endswith(".pyi").alias("is_stub"), F.encode("text", "UTF-8").alias("content")
        )
        report(analyze_facts(cut(read_facts(files)), configs, options))

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
