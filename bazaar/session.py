"""Settings a job wants, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# AQE is what turns a skewed shuffle join into split reads and a small
# shuffled side into a broadcast, with sizes it has measured.  Sizes guessed
# from files before a run decide only about truly small tables.
RECOMMENDED = {
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # The JVM never compiles methods of more bytes: the code of wide rows is cut into small ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prefer(spark: SparkSession, name: str) -> None:
    """A recommended setting, unless the session has one of its own."""
    if name not in spark.conf.getAll:
        spark.conf.set(name, RECOMMENDED[name])


# Folders of the runs that are under way, the innermost last.
_runs: list[str] = []


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for what a run stores on the way, removed when the run ends.

    Results have to be written elsewhere before that: a frame that is only
    planned may still need to read its intermediates.
    """
    folder = f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}"
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it.

    A local session without one gets a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    if _runs:
        return _runs[-1]
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="bazaar-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: Spark removes those of a write when it has ended.

    Otherwise they stay on disk until the driver happens to collect its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_turns(df: DataFrame | Sequence[DataFrame]) -> list[DataFrame]:
    """The frames of a table that is worked on in turns, or the one that is all of it."""
    return [df] if isinstance(df, DataFrame) else list(df)


def settle(df: DataFrame, *partition_by: str, **options: str) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder; the stored table and its row count.

    Used where later steps read an intermediate more than once and must see
    the very same rows each time, also after an executor is lost.  Read back
    as Parquet, its columns can be pruned and its size is known to Spark.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    with shuffles_removed(df.sparkSession):
        counted.write.partitionBy(*partition_by).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]
