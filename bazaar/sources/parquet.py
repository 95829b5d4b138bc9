"""Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaar.operators.clean import cast_numeric
from bazaar.schema import FEATURE_COLUMNS


def scan_parquet(spark: SparkSession, uri: str, numeric: list[str] | None = None) -> DataFrame:
    """Read a Parquet dataset, local or on any Hadoop file system.

    ``numeric`` columns (the six features and ``udi_match`` by default) are
    taken as doubles when the dataset has them.
    """
    wanted = [*FEATURE_COLUMNS, "udi_match"] if numeric is None else numeric
    return cast_numeric(spark.read.parquet(uri), wanted)
