"""CSV scans: text columns, wrong-length lines, charset detection."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.schema import NA_TOKENS
from bazaar.session import prefer
from bazaar.sources.csv_records import Survey, decodable, scan_records, survey

_RAW_LINE = "_raw_line"


def _lines(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.text(uri).select(F.col("value").cast("binary").alias("line"))


def detect_charset(spark: SparkSession, uri: str, preferred: str | None = None) -> str:
    """``preferred`` if it can decode the data, else UTF-8, else GB18030; else an error.

    GB18030 contains GBK, so one fallback covers both.  Every line is tried
    with all of them in one reading; only the names of those that fail come back.
    """
    chain = list(dict.fromkeys([*([preferred] if preferred else []), "UTF-8", "GB18030"]))

    def failing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = list(chain)
        for batch in batches:
            data = b"\n".join(batch.column("line").to_pylist())
            for charset in list(left):
                try:
                    data.decode(charset)
                except UnicodeDecodeError:
                    left.remove(charset)
        failed = [c for c in chain if c not in left]
        yield pa.RecordBatch.from_arrays([pa.array(failed, pa.string())], names=["charset"])

    found = _lines(spark, uri).mapInArrow(failing, "charset string").distinct().collect()
    failed = {r["charset"] for r in found}
    return decodable(chain, failed, uri)


def _plain(spark: SparkSession, uri: str, preferred: str | None) -> bool:
    """Is it UTF-8 without any quote?  Told by Spark alone, so most files need no closer reading."""
    if preferred and preferred.lower().replace("-", "") != "utf8":
        return False
    odd = ~F.is_valid_utf8("value") | F.col("value").contains('"')
    return spark.read.text(uri).agg(F.bool_or(odd)).first()[0] is False


def _field_count(line: Column) -> Column:
    """Fields of one raw line: commas outside quotes, plus one.

    A doubled quote reads as the end of one quoted part and the begin of the
    next, so the pattern needs no alternative, and no stack for long fields.
    """
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _decoded(spark: SparkSession, uri: str, charset: str) -> DataFrame:
    """Lines that are not in UTF-8, as text; blank ones are left out."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [x.decode(charset).rstrip("\r") for x in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    return _lines(spark, uri).mapInArrow(decode, "line string").where(F.trim("line") != "")


def _parsed(spark: SparkSession, uri: str, charset: str) -> tuple[list[str], DataFrame]:
    """Names and rows of a CSV in another charset than UTF-8; lines equal to the header are none."""
    lines = _decoded(spark, uri, charset)
    header = lines.first()["line"]
    names = next(csv.reader([header]))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RAW_LINE]])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW_LINE}
    record = F.from_csv("line", schema.toDDL(), options)
    data = lines.where(F.col("line") != header)
    return names, data.select(record.alias("r")).select("r.*")


def scan_csv(
    spark: SparkSession,
    uri: str,
    encoding: str | None = None,
    multi_line: bool | None = None,
    na_tokens: list[str] | None = None,
    detect: bool = True,
    known: Survey | None = None,
) -> DataFrame:
    """Read a CSV with a header row; every column is text.

    Lines with more fields than the header are left out, shorter ones are
    padded with nulls, and the usual missing-value tokens become null.

    ``multi_line`` says whether fields in quotes may hold line breaks; by default
    the reading that finds out the encoding looks for some, unless a quick one
    has found UTF-8 without quotes.  Files are split
    between tasks either way, in any of the charsets.  With ``detect=False`` the
    encoding is taken as given, the file is not read to find it out, and records
    are lines unless ``multi_line`` is set.  A survey made before is used as ``known``.
    """
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    prefer(spark, "spark.sql.codegen.hugeMethodLimit")
    if known is None and multi_line is None and detect and _plain(spark, uri, encoding):
        charset = "UTF-8"
    elif known or multi_line or (multi_line is None and detect):
        known = known or survey(spark, uri, encoding)
        if multi_line or (multi_line is None and known.broken):
            return _without(scan_records(spark, uri, known), tokens)
        charset = known.charset
    else:
        charset = detect_charset(spark, uri, encoding) if detect else encoding or "UTF-8"
    if charset.upper() != "UTF-8":
        names, rows = _parsed(spark, uri, charset)
    else:
        reader = spark.read.options(header=True, quote='"', escape='"')
        names = reader.csv(uri).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RAW_LINE]])
        # Column pruning would hide the number of fields a line really has.
        rows = (
            reader.schema(schema)
            .options(mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW_LINE, columnPruning=False)
            .csv(uri)
        )
    raw = F.col(_RAW_LINE)
    # Spark refuses to read raw lines alone; the last test, never true, keeps
    # a field beside them in every plan.
    never = F.length(F.col(f"`{names[0]}`")) < 0
    kept = rows.where(raw.isNull() | (_field_count(raw) <= len(names)) | never)
    return _without(kept.select([f"`{c}`" for c in names]), tokens)


def _without(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """Null for the tokens that stand for a missing value."""
    return rows.select([F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) for c in rows.columns])
