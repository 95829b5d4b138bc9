"""All combinations of two tables, for results that have a row for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def every_pair(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Every row with every one of ``values``: each row meets the values block by block."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64(*values.columns), F.lit(blocks)).cast("int").alias("_block")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    return rows.select("*", every).join(values.select("*", block), "_block").drop("_block")
