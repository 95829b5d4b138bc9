"""Shapes a report asks for: month filter, key figures, pivots, classes.

Pivots keep to long rows (one per cell, zero filled), so that the schema does
not depend on the data; ``to_wide`` turns them into columns.  They are fed by
the small theme tables, never by listings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.pairs import every_pair
from bazaar.operators.trend import trend_report
from bazaar.operators.structure import concentration_level
from bazaar.operators.warehouse import BANDS
from bazaar.schema import DEFAULT_ROLES, UNKNOWN, Roles

ALL_MONTHS = ("", "all", "全部")


def filter_month(df: DataFrame, month: str | None, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Rows of one month; blank or a word for all keeps every row."""
    wanted = (month or "").strip()
    if wanted.lower() in ALL_MONTHS:
        return df
    return df.where(F.col(*roles.of("stats_month")) == wanted)


def analytics_for_month(
    df: DataFrame,
    month: str | None = None,
    names: Sequence[str] | None = None,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """All trend sections of one month, or of all months, from one scan."""
    return trend_report(filter_month(df, month, roles), names, roles)


def month_options(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Months that can be picked, with their row counts."""
    (month,) = roles.of("stats_month")
    return (
        df.where(F.col(month).isNotNull() & ~F.col(month).isin("", UNKNOWN))
        .groupBy(F.col(month).alias("stats_month"))
        .agg(F.count(F.lit(1)).alias("row_cnt"))
        .orderBy("stats_month")
    )


def overview_kpis(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Totals and averages with the number of cities, categories and channels.

    Rows are first reduced to sums per city, category and channel; the three
    distinct counts then run over those few, not over every listing.
    """
    keys = ["city", "category", "channel"]
    averaged = {
        "avg_rating": "rating", "avg_actual_price": "actual_price",
        "avg_list_price": "list_price", "avg_discount": "discount_rate",
        "avg_review_count": "review_count",
    }
    columns = roles.of(*keys)
    cells = df.groupBy(*[F.col(c).alias(k) for c, k in zip(columns, keys)]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(*roles.of("monthly_sales")).alias("sales"),
        *[F.sum(*roles.of(r)).alias(f"{n}_sum") for n, r in averaged.items()],
        *[F.count(*roles.of(r)).alias(f"{n}_n") for n, r in averaged.items()],
    )
    return cells.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_cnt"),
        F.sum("sales").alias("total_sales"),
        *[
            (F.sum(f"{n}_sum") / F.nullif(F.sum(f"{n}_n"), F.lit(0))).alias(n) for n in averaged
        ],
        F.count_distinct("city").alias("city_count"),
        F.count_distinct("category").alias("category_count"),
        F.count_distinct("channel").alias("channel_count"),
    )


def _segments(table: DataFrame) -> Column:
    """All segments of a table as one sorted array; there are as many as clusters were asked for."""
    return table.agg(F.array_sort(F.collect_set("cluster"))).scalar()


def fill_grid(
    cells: DataFrame, rows: DataFrame, row_key: str, column_key: str, *values: str
) -> DataFrame:
    """A cell for each row key with each value of the column key, zero if absent."""
    known = cells.where(F.col(column_key).isNotNull()).select(column_key).distinct()
    grid = every_pair(rows.select(row_key), known)
    return grid.join(cells, [row_key, column_key], "left").fillna(0.0, subset=list(values))


def to_wide(cells: DataFrame, row_key: str, column_key: str, value: str) -> DataFrame:
    """Long cells to one column per value of the column key."""
    return cells.groupBy(row_key).pivot(column_key).agg(F.first(value)).orderBy(row_key)


def city_spread_top10(city_rank: DataFrame, n: int = 10) -> DataFrame:
    """Cities whose sales differ most between segments, a cell per segment.

    Takes the segment city table.  A segment absent from a city counts as zero.
    """
    clusters = _segments(city_rank)
    sales = F.coalesce(F.col("total_sales"), F.lit(0.0))
    cities = (
        city_rank.where(F.col("city") != "")
        .groupBy("city")
        .agg(
            F.sum(sales).alias("city_sales"),
            F.max(sales).alias("_high"),
            F.min(sales).alias("_low"),
            F.count(F.lit(1)).alias("_present"),
        )
        .withColumn("_missing", F.col("_present") < F.size(clusters))
        .withColumn(
            "spread",
            F.greatest("_high", F.when(F.col("_missing"), 0.0))
            - F.least("_low", F.when(F.col("_missing"), 0.0)),
        )
    )
    top = (
        cities.orderBy(F.desc("spread"), F.desc("city_sales"), "city")
        .limit(n)
        .select("city", "city_sales", "spread")
    )
    cells = city_rank.select("city", "cluster", F.col("total_sales").alias("cluster_sales"))
    grid = top.select("*", F.explode(clusters).alias("cluster"))
    return (
        grid.join(cells, ["city", "cluster"], "left")
        .fillna(0.0, subset=["cluster_sales"])
        .select("city", "spread", "city_sales", "cluster", "cluster_sales")
        .orderBy(F.desc("spread"), F.desc("city_sales"), "city", "cluster")
    )


def lift_heatmap(preference: DataFrame, n: int = 4) -> DataFrame:
    """Lift of the categories that are among some segment's ``n`` highest, in every segment."""
    highest = Window.partitionBy("cluster").orderBy(
        F.desc(F.coalesce("preference_lift", F.lit(0.0))), "category"
    )
    chosen = (
        preference.withColumn("_rn", F.row_number().over(highest))
        .where(F.col("_rn") <= n)
        .select("category")
        .distinct()
    )
    grid = chosen.select("category", F.explode(_segments(preference)).alias("cluster"))
    cells = preference.select(
        "cluster", "category", F.round("preference_lift", 2).alias("lift")
    )
    return (
        grid.join(cells, ["cluster", "category"], "left")
        .select("cluster", "category", "lift")
        .orderBy("category", "cluster")
    )


def band_pivot(price_band: DataFrame) -> DataFrame:
    """Sales of each segment in each discount band, bands as columns in order."""
    return (
        price_band.groupBy("cluster")
        .pivot("discount_band", BANDS)
        .agg(F.sum("total_sales"))
        .fillna(0.0)
        .orderBy("cluster")
    )


def month_pivot(month_delta: DataFrame) -> DataFrame:
    """Sales of each segment in each month, with growth in percent."""
    cells = month_delta.select(
        "cluster", "stats_month", "total_sales",
        F.round(F.col("sales_growth_rate") * 100, 1).alias("growth_pct"),
    )
    segments = cells.select("cluster").distinct()
    return fill_grid(cells, segments, "cluster", "stats_month", "total_sales").orderBy(
        "cluster", "stats_month"
    )


def channel_pivot(channel_efficiency: DataFrame) -> DataFrame:
    """Weighted sales of each segment in each channel."""
    cells = channel_efficiency.select("cluster", "channel", "weighted_sales")
    segments = cells.select("cluster").distinct()
    return fill_grid(cells, segments, "cluster", "channel", "weighted_sales").orderBy(
        "cluster", "channel"
    )


def doctor_title_pivot(doctor_matching: DataFrame, n: int = 8) -> DataFrame:
    """Sales of each segment for the ``n`` doctor titles that sell most."""
    top = (
        doctor_matching.where(F.col("doctor_title") != "")
        .groupBy("doctor_title")
        .agg(F.sum("total_sales").alias("title_sales"))
        .orderBy(F.desc_nulls_last("title_sales"), "doctor_title")
        .limit(n)
    )
    grid = top.select(
        "doctor_title", "title_sales",
        F.explode(_segments(doctor_matching)).alias("cluster"),
    )
    cells = doctor_matching.select("cluster", "doctor_title", "total_sales")
    return (
        grid.join(cells, ["cluster", "doctor_title"], "left")
        .fillna(0.0, subset=["total_sales"])
        .select("cluster", "doctor_title", "title_sales", "total_sales")
        .orderBy(F.desc("title_sales"), "doctor_title", "cluster")
    )


def top_n_cities(by_city: DataFrame, n: int | None = 15) -> DataFrame:
    """The first ``n`` rows of the city section, or all."""
    ordered = by_city.orderBy(F.desc_nulls_last("total_sales"), "city")
    return ordered if n is None else ordered.limit(n)


def elasticity_class(elasticity: DataFrame) -> DataFrame:
    """Name the sign and strength of each category's elasticity."""
    slope = F.col("elasticity")
    kind = F.when(slope < -1, "elastic").when(slope < 0, "negative").when(slope >= 0, "non-negative")
    return elasticity.select("category", "elasticity", kind.alias("elasticity_class"))


def concentration_class(hhi: DataFrame, by: str) -> DataFrame:
    """Name the concentration of each group from its index."""
    return hhi.select(by, "hhi", concentration_level(F.col("hhi")).alias("concentration_class"))
