"""Writers for result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.numeric import no_nan
from bazaar.session import in_turns, shuffles_removed

# Rows of a compressed CSV file, which no reader can split.
_ROWS_A_FILE = 500_000


def sink_parquet(
    df: DataFrame | Sequence[DataFrame], path: str, *partition_by: str, together: bool = False
) -> int:
    """Overwrite a Parquet dataset; the row count comes from the write itself.

    Several frames are written one after the other, so that the disk holds
    the shuffles of one at a time.

    Rows of a partition are brought together first, or each task would add a
    small file to each; a partition too large for one task is split.  Say so if
    they are ``together`` already: wide rows are better brought together before
    their columns are derived.
    """
    rows = 0
    for turn, part in enumerate(in_turns(df)):
        if partition_by and not together:
            part = part.hint("rebalance", *partition_by)
        seen = Observation()
        counted = part.observe(seen, F.count(F.lit(1)).alias("rows"))
        with shuffles_removed(part.sparkSession):
            counted.write.mode("append" if turn else "overwrite").partitionBy(*partition_by).parquet(path)
        rows += seen.get["rows"]
    return rows


def emit_table(df: DataFrame, name: str, path: str) -> tuple[DataFrame, int]:
    """Store a derived table and register it as a view under its name.

    What is returned reads the stored rows, so nothing downstream works the
    table out a second time.
    """
    rows = sink_parquet(df, path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.createOrReplaceTempView(name)
    return stored, rows


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sorted by columns; those named with a minus highest first, missing values last."""
    by = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order]
    return df.orderBy(*by) if by else df


def snapshot_rows(df: DataFrame, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows as JSON can hold them: doubles for decimals, null for NaN; sorted, then cut."""

    def plain(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return no_nan(F.col(f.name).cast("double")).alias(f.name)
        return F.col(f.name)

    ordered = in_order(df, order)
    out = ordered if limit is None else ordered.limit(limit)
    return out.select([plain(f) for f in df.schema.fields])


def sink_json_snapshot(
    df: DataFrame, path: str, limit: int | None = None, order: Sequence[str] = ()
) -> None:
    """Write rows as JSON lines in UTF-8, nulls spelled out.

    A table that was stored has no order of its own any more: name the ``order``
    of the rows, or a cut is any ``limit`` of them.
    """
    snapshot_rows(df, limit, order).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def sink_csv_export(
    df: DataFrame | Sequence[DataFrame], path: str, bom: bool = False, compression: str | None = None
) -> None:
    """Write CSV with a header, doubled quotes, and empty fields for nulls.

    Several frames are written one after the other, so that the disk holds
    the shuffles of one at a time.  A compressed file is read by one task,
    so with ``compression`` files end after some rows.

    With ``bom`` every file begins with a byte order mark, by which spreadsheets
    know UTF-8: it is written as the begin of the first name.
    """
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}
    if compression:
        options |= {"compression": compression, "maxRecordsPerFile": _ROWS_A_FILE}
    for turn, part in enumerate(in_turns(df)):
        named = part.toDF(f"\ufeff{part.columns[0]}", *part.columns[1:]) if bom else part
        with shuffles_removed(part.sparkSession):
            named.write.mode("append" if turn else "overwrite").options(**options).csv(path)


def insights_manifest(
    spark: SparkSession, tables: dict[str, tuple[str, int]], **facts: str | int
) -> DataFrame:
    """One row per stored table: name, path, rows, and facts about the run, as typed as given."""
    rows = [(name, path, count) for name, (path, count) in tables.items()]
    manifest = spark.createDataFrame(rows, "table string, path string, rows long")
    return manifest.select(
        "*", F.current_timestamp().alias("generated_at"),
        *[F.lit(v).alias(k) for k, v in facts.items()],
    )
