"""Whole results published at once: readers see all tables of a run, or those of the run before.

A run writes into a folder of its own.  Only when all its tables are stored is
one file added that names them; Spark moves it into place in a single step.  A
run that fails leaves a folder that nothing names, and the former tables as they
were.  Tables of former runs stay readable by those who hold their paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PUBLISHED = "table string, path string, rows long, version long, release string, published_at timestamp"


def _log(spark: SparkSession, out_dir: str) -> DataFrame:
    path = f"{out_dir}/published"
    # An empty addition makes the folder on the first use, and changes nothing later.
    spark.createDataFrame([], _PUBLISHED).write.mode("append").parquet(path)
    return spark.read.schema(_PUBLISHED).parquet(path)


def publish(spark: SparkSession, out_dir: str, make: Callable[[str], DataFrame]) -> DataFrame:
    """Let ``make`` store tables below a folder and return their manifest, then make them the current ones."""
    release = uuid.uuid4().hex
    made = make(f"{out_dir}/releases/{release}")
    version = (_log(spark, out_dir).agg(F.max("version")).first()[0] or 0) + 1
    named = made.select(
        "table", "path", F.col("rows").cast("long"), F.lit(version).cast("long").alias("version"),
        F.lit(release).alias("release"), F.current_timestamp().alias("published_at"),
    )
    named.coalesce(1).write.mode("append").parquet(f"{out_dir}/published")
    return current(spark, out_dir)


def current(spark: SparkSession, out_dir: str, version: int | None = None) -> DataFrame:
    """The tables of the last release, or of the one numbered ``version``; no rows if there is none.

    Of two that were published at the same time under one number the later counts.
    """
    log = _log(spark, out_dir)
    chosen = log if version is None else log.where(F.col("version") == version)
    last = chosen.agg(F.max_by("release", F.struct("version", "published_at", "release"))).first()[0]
    return log.where(F.col("release") == F.lit(last))


def read_current(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """One table of the last release."""
    found = current(spark, out_dir).where(F.col("table") == table).select("path").first()
    if found is None:
        raise ValueError(f"{out_dir} has no published table {table}")
    return spark.read.parquet(found["path"])
