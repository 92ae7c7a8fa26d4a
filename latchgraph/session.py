"""Session settings and shipping of this package's code to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def build(app: str = "latchgraph", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # files of rounds that nothing refers to any more
    } | conf
    return builder.config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most: what stands in JVM buffers and Python workers at once stays small beside the heap."""
    digits = spark.conf.get(ARROW_BATCH, str(64 << 20)).removesuffix("b")
    if not digits.isdigit() or not 0 < int(digits) <= ARROW_BYTES:
        spark.conf.set(ARROW_BATCH, str(ARROW_BYTES))


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, through Spark's own file distribution, once per application."""
    bound_batches(spark)
    context = spark.sparkContext
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SHIPPED:
        return spark
    _SHIPPED.add(context.applicationId)
    path = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    return spark


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the session names; sets one only where there is none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(frame: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows go to the shared checkpoint folder and survive lost executors."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(True)


def written(frame: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the checkpoint folder.

    Its size is known from its files.  A checkpointed frame keeps the estimate of its plan, and where a loop joins what it
    made before, estimates multiply round by round until planning alone takes longer than the jobs.
    """
    spark = frame.sparkSession
    checkpoint_dir(spark)
    where = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    frame.write.parquet(where)
    return spark.read.schema(frame.schema).parquet(where)


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all tasks.  Rows that are small to read and dear to work on otherwise stay in the few tasks that read them."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small(frame: DataFrame, rows: int, most: int = 50_000) -> DataFrame:
    """Marks a frame whose number of rows is known for broadcasting if it has at most ``most``."""
    return F.broadcast(frame) if rows <= most else frame


def sized(frame: DataFrame, rows: int = 50_000) -> DataFrame:
    """Marks a computed frame for broadcasting if it has no more than ``rows`` rows; a larger one is shuffled as usual."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame
