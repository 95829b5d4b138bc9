"""Reports kept up month by month: sums that merge, and sets of doctors as bitmaps.

A month is worked out from its own rows, and stored; the report over all months
is merged from what is stored, without reading a listing again.  Averages are
kept as sum and count.  Different doctors are kept as bitmaps over a stored
dictionary of their names, so a doctor who is in several months counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaar.functions.numeric import all_present
from bazaar.functions.ordering import ordered_prefix
from bazaar.operators.trend import MEASURES, available_sections, key_columns, parts_of, sections_of
from bazaar.schema import DEFAULT_ROLES, Roles
from bazaar.session import settle

MONTH = "_month"
# Where rows without a month are kept.
NO_MONTH = "none"

_DOCTOR_MEASURES = {"total_sales": "monthly_sales", "avg_rating": "rating", "avg_actual_price": "actual_price"}


def _month(roles: Roles) -> Column:
    return F.coalesce(F.nullif(F.col(*roles.of("stats_month")).cast("string"), F.lit("")), F.lit(NO_MONTH)).alias(MONTH)


def _sums(roles_read: Sequence[str], roles: Roles) -> list[Column]:
    """Sum and number of values of each column read."""
    columns = zip(roles_read, roles.of(*roles_read), strict=True)
    return [made for r, c in columns for made in (F.sum(c).alias(f"sum_{r}"), F.count(c).alias(f"n_{r}"))]


def _measured(measures: dict[str, str], averaged: Sequence[str]) -> list[Column]:
    """Measures from sums of sums and counts."""
    def of(name: str, role: str) -> Column:
        total, n = F.sum(f"sum_{role}"), F.sum(f"n_{role}")
        return (total / F.nullif(n, F.lit(0)) if name in averaged else total).alias(name)

    return [of(name, role) for name, role in measures.items()]


def put_months(partials: DataFrame, path: str) -> None:
    """Store the months of ``partials``; months that are there already are replaced, others are left alone."""
    partials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def stored_months(spark: SparkSession, path: str, kinds: DataFrame) -> DataFrame:
    """The months stored at ``path``, with the columns and types of ``kinds``."""
    return spark.read.schema(kinds.schema).parquet(path).select(kinds.columns)


def trend_partials(df: DataFrame, names: Sequence[str] | None = None, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """What the trend report needs of each month, from one scan."""
    names = list(names or available_sections(df, roles))
    key_sets, keys, measures = parts_of(names)
    read = list(dict.fromkeys(MEASURES[m][1] for m in measures))
    rows = df.select(_month(roles), *key_columns(keys, roles), *[F.col(c) for c in roles.of(*read)])
    sets = [[*(f"_key_{k}" for k in s), MONTH] for s in key_sets]
    return rows.groupingSets(sets, *[f"_key_{k}" for k in keys], MONTH).agg(
        # The month is in every set, and its bit the last.
        F.shiftright(F.grouping_id(), 1).alias("_set"), F.count(F.lit(1)).alias("row_cnt"), *_sums(read, roles)
    )


def trend_report_of(partials: DataFrame, names: Sequence[str]) -> DataFrame:
    """The trend report over all months of ``partials``, which hold exactly the sections ``names``."""
    _, keys, measures = parts_of(names)
    averaged = [m for m in measures if MEASURES[m][0] is F.avg]
    merged = partials.groupBy("_set", *[f"_key_{k}" for k in keys]).agg(
        F.sum("row_cnt").alias("row_cnt"), *_measured({m: MEASURES[m][1] for m in measures}, averaged)
    )
    return sections_of(merged, names)


def known_doctors(df: DataFrame, path: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """The dictionary of doctors' names (``doctor, id``) at ``path``, after new ones of ``df`` are added.

    Names keep their numbers, which run from 1 without gaps, so bitmaps stay
    dense.  One run at a time may add names.
    """
    spark = df.sparkSession
    names = df.select(F.col(*roles.of("doctor_name")).cast("string").alias("doctor")).where("doctor is not null").distinct()
    schema = "doctor string, id long"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path)
    last = known.agg(F.max("id")).first()[0] or 0
    fresh, rows = settle(names.join(known, "doctor", "left_anti"))
    if rows:
        numbered = ordered_prefix(fresh, [F.asc("doctor")])
        numbered.select("doctor", (F.col("position") + last).alias("id")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def doctor_partials(df: DataFrame, doctors: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Per month, segment and title the sums of its listings, and its doctors as bitmaps.

    A bitmap holds those of 32,768 numbers, its ``bucket``; rows without a bucket hold the sums.
    A doctor who is in a set twice is one bit of it, so no set of names is kept beside the bitmaps.
    """
    cluster, title, name = roles.of("cluster", "doctor_title", "doctor_name")
    read = list(_DOCTOR_MEASURES.values())
    known = df.where(all_present([cluster, title])).select(
        _month(roles), F.col(cluster).alias("cluster"), F.col(title).alias("doctor_title"),
        F.col(name).cast("string").alias("doctor"), *[F.col(c) for c in roles.of(*read)],
    )
    by = [MONTH, "cluster", "doctor_title"]
    sums = known.groupBy(*by).agg(F.count(F.lit(1)).alias("row_cnt"), *_sums(read, roles))
    numbered = known.select(*by, "doctor").join(doctors, "doctor")
    sets = numbered.groupBy(*by, F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("doctors")
    )
    return sums.unionByName(sets, allowMissingColumns=True)


def doctor_matching_of(partials: DataFrame) -> DataFrame:
    """``cluster_doctor_matching`` over all months of ``partials``."""
    by = ["cluster", "doctor_title"]
    sums = partials.where("bucket is null").groupBy(*by).agg(
        F.sum("row_cnt").alias("project_count"), *_measured(_DOCTOR_MEASURES, ["avg_rating", "avg_actual_price"])
    )
    sets = partials.where("bucket is not null").groupBy(*by, "bucket").agg(F.bitmap_or_agg("doctors").alias("doctors"))
    counts = sets.groupBy(*by).agg(F.sum(F.bitmap_count("doctors")).alias("doctor_count"))
    rank = F.rank().over(Window.partitionBy("cluster").orderBy(F.desc_nulls_last("total_sales"))).cast("long")
    found = sums.join(counts, by, "left").fillna(0, subset=["doctor_count"])
    return found.withColumn("title_rank_in_cluster", rank).orderBy("cluster", "title_rank_in_cluster", "doctor_title")
