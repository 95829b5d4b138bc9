"""Segment theme tables: profile, rankings, lift, efficiency, bands, deltas.

Windows here run over already grouped rows: one per segment and city, category
and so on, so a window partition holds as many rows as the dimension has
values.  Where the dimension is open-ended (projects), only a top few per
segment are kept, which Spark cuts before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.numeric import all_present, ratio
from bazaar.operators.trend import measure
from bazaar.schema import DEFAULT_ROLES, UNKNOWN, Roles


def _grouped(
    df: DataFrame, key: str | None, measures: list[str], roles: Roles, *more: Column
) -> DataFrame:
    """``measures`` per segment, and per ``key`` where given; null keys left out."""
    keys = ["cluster"] + ([key] if key else [])
    columns = roles.of(*keys)
    known = df.where(all_present(columns))
    return known.groupBy(*[F.col(c).alias(k) for c, k in zip(columns, keys)]).agg(
        *[measure(m, roles) for m in measures], *more
    )


def _rank(partition: str | None, by: Column) -> Column:
    window = Window.partitionBy(partition) if partition else Window.partitionBy()
    return F.rank().over(window.orderBy(by)).cast("long")


def cluster_profile(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Averages per segment with a business label and a discount level."""
    profile = _grouped(
        df, None,
        ["project_count", "total_sales", "avg_list_price", "avg_actual_price", "avg_discount",
         "avg_monthly_sales", "avg_review_count", "avg_rating"],
        roles,
    )
    price, sales = F.col("avg_list_price"), F.col("avg_monthly_sales")
    # Windows over all segments: as many rows as there are segments.
    ranked = profile.withColumns(
        {
            "price_rank": _rank(None, price.desc_nulls_last()),
            "sales_rank": _rank(None, sales.desc_nulls_last()),
            "_cheapest": _rank(None, price.asc_nulls_first()),
            "_slowest": _rank(None, sales.asc_nulls_first()),
        }
    )
    # Labels and cuts.
    label = (
        F.when(F.col("price_rank") == 1, "高端精品型")
        .when(F.col("sales_rank") == 1, "大众爆款型")
        .when((F.col("_cheapest") == 1) & (F.col("_slowest") == 1), "长尾引流型")
        .otherwise("中端主力型")
    )
    level = (
        F.when(F.col("avg_discount") < 0.7, "深折促销")
        .when(F.col("avg_discount") < 0.85, "中度折扣")
        .otherwise("高折扣/原价")
    )
    return (
        ranked.withColumns({"cluster_label": label, "discount_level": level})
        .drop("_cheapest", "_slowest")
        .orderBy("cluster")
    )


def cluster_city_rank(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Cities ranked within a segment, and segments within a city, by sales."""
    cities = _grouped(
        df, "city", ["total_sales", "project_count", "avg_actual_price", "avg_rating"], roles
    )
    most = F.desc_nulls_last("total_sales")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(most, "city")).cast("long")
    return cities.withColumns(
        {"rank_in_cluster": place, "cluster_rank_in_city": _rank("city", most)}
    ).orderBy("cluster", "rank_in_cluster")


def cluster_category_preference(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Lift: a category's share of a segment's sales over its share of all sales.

    Segment and grand totals include rows without a category or segment, so
    they are taken over the grouped rows before those are left out; the table
    itself is read and shuffled once.
    """
    cluster, category, sales = roles.of("cluster", "category", "monthly_sales")
    cells = df.groupBy(F.col(cluster).alias("cluster"), F.col(category).alias("category")).agg(
        F.sum(sales).alias("cat_sales"), F.count(F.lit(1)).alias("cat_count")
    )
    total = F.sum("cat_sales")
    totals = cells.withColumns(
        {
            "_in_category": total.over(Window.partitionBy("category")),
            "_in_cluster": total.over(Window.partitionBy("cluster")),
            "_grand": cells.agg(total).scalar(),
        }
    ).where(all_present(["cluster", "category"]))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))

    shares = totals.withColumns(
        {
            "cluster_share": share("cat_sales", "_in_cluster"),
            "global_share": share("_in_category", "_grand"),
        }
    )
    return shares.select(
        "cluster", "category", "cat_sales", "cat_count", "cluster_share", "global_share",
        F.when(F.col("global_share") > 0, F.col("cluster_share") / F.col("global_share"))
        .alias("preference_lift"),
        _rank("cluster", F.desc_nulls_last("cat_sales")).alias("cat_rank_in_cluster"),
    ).orderBy("cluster", F.desc_nulls_last("preference_lift"), "category")


def cluster_channel_efficiency(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Sales weighted by rating, per listing, ranked both ways."""
    sales, rating = roles.of("monthly_sales", "rating")
    weighted = F.sum(F.col(sales) * F.col(rating)).alias("weighted_sales")
    channels = _grouped(
        df, "channel", ["total_sales", "project_count", "avg_rating", "avg_actual_price"],
        roles, weighted,
    )
    most = F.desc_nulls_last("weighted_sales")
    return channels.select(
        "cluster", "channel", "total_sales", "project_count", "avg_rating", "weighted_sales",
        "avg_actual_price",
        (F.col("weighted_sales") / F.col("project_count")).alias("efficiency_score"),
        _rank("cluster", most).alias("channel_rank_in_cluster"),
        _rank("channel", most).alias("cluster_rank_in_channel"),
    ).orderBy("cluster", "channel_rank_in_cluster", "channel")


# The discount bands of the theme tables, in their usual order.
BANDS = ["深折(<0.6)", "中折(0.6-0.75)", "浅折(0.75-0.9)", "原价(>=0.9)", UNKNOWN]


def segment_band(roles: Roles = DEFAULT_ROLES) -> Column:
    """The discount band of the theme tables."""
    paid = F.col(*roles.of("discount_rate"))
    return (
        F.when(paid.isNull(), BANDS[4])
        .when(paid < 0.6, BANDS[0])
        .when(paid < 0.75, BANDS[1])
        .when(paid < 0.9, BANDS[2])
        .otherwise(BANDS[3])
    )


def cluster_price_band(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Discount bands per segment with rank and percent rank by sales."""
    cluster, actual = roles.of("cluster", "actual_price")
    bands = (
        df.where(F.col(cluster).isNotNull())
        .groupBy(F.col(cluster).alias("cluster"), segment_band(roles).alias("discount_band"))
        .agg(
            measure("project_count", roles),
            measure("total_sales", roles),
            measure("avg_monthly_sales", roles).alias("avg_sales"),
            measure("avg_rating", roles),
            F.avg(actual).alias("avg_price"),
        )
    )
    rising = Window.partitionBy("cluster").orderBy(F.asc_nulls_first("total_sales"))
    return bands.withColumns(
        {
            "sales_pct_in_cluster": F.percent_rank().over(rising),
            "band_rank_in_cluster": _rank("cluster", F.desc_nulls_last("total_sales")),
        }
    ).orderBy("cluster", "band_rank_in_cluster", "discount_band")


def cluster_top_projects(df: DataFrame, roles: Roles = DEFAULT_ROLES, n: int = 5) -> DataFrame:
    """The ``n`` projects with most sales in each segment."""
    projects = _grouped(
        df, "project_name", ["total_sales", "avg_actual_price", "avg_rating", "listing_count"],
        roles,
    )
    best = Window.partitionBy("cluster").orderBy(F.desc_nulls_last("total_sales"), "project_name")
    return (
        projects.withColumn("rn", F.row_number().over(best))
        .where(F.col("rn") <= n)
        .withColumn("rn", F.col("rn").cast("long"))
        .orderBy("cluster", "rn")
    )


def cluster_doctor_matching(
    df: DataFrame, roles: Roles = DEFAULT_ROLES, approximate: bool = False
) -> DataFrame:
    """Doctor titles per segment with the number of different doctors."""
    (name,) = roles.of("doctor_name")
    doctors = F.approx_count_distinct(name) if approximate else F.count_distinct(name)
    titles = _grouped(
        df, "doctor_title", ["project_count", "total_sales", "avg_rating", "avg_actual_price"],
        roles, doctors.alias("doctor_count"),
    )
    rank = _rank("cluster", F.desc_nulls_last("total_sales"))
    return titles.withColumn("title_rank_in_cluster", rank).orderBy(
        "cluster", "title_rank_in_cluster", "doctor_title"
    )


def cluster_month_delta(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Sales per segment and month against the month listed before it."""
    month, actual = roles.of("stats_month", "actual_price")
    months = _grouped(
        df.where(F.col(month) != UNKNOWN), "stats_month", ["total_sales", "project_count"], roles,
        F.avg(actual).alias("avg_price"),
    )
    previous = Window.partitionBy("cluster").orderBy("stats_month")
    sales, before = F.col("total_sales"), F.col("prev_sales")
    return (
        months.withColumns(
            {
                "prev_sales": F.lag("total_sales").over(previous),
                "prev_count": F.lag("project_count").over(previous),
            }
        )
        .withColumns(
            {
                "sales_delta": sales - F.coalesce(before, F.lit(0.0)),
                "sales_growth_rate": ratio(sales - before, before),
            }
        )
        .orderBy("cluster", "stats_month")
    )


# Theme table -> (operator, rows its snapshot shows).
THEME_TABLES = {
    "cluster_profile": (cluster_profile, None),
    "cluster_city_rank": (cluster_city_rank, 150),
    "cluster_category_preference": (cluster_category_preference, 200),
    "cluster_channel_efficiency": (cluster_channel_efficiency, None),
    "cluster_price_band": (cluster_price_band, None),
    "cluster_top_projects": (cluster_top_projects, None),
    "cluster_doctor_matching": (cluster_doctor_matching, 100),
    "cluster_month_delta": (cluster_month_delta, None),
}

# The columns a theme table is shown, and cut, in the order of; highest first with a minus.
THEME_ORDER = {
    "cluster_profile": ("cluster",),
    "cluster_city_rank": ("cluster", "rank_in_cluster"),
    "cluster_category_preference": ("cluster", "-preference_lift", "category"),
    "cluster_channel_efficiency": ("cluster", "channel_rank_in_cluster", "channel"),
    "cluster_price_band": ("cluster", "band_rank_in_cluster", "discount_band"),
    "cluster_top_projects": ("cluster", "rn"),
    "cluster_doctor_matching": ("cluster", "title_rank_in_cluster", "doctor_title"),
    "cluster_month_delta": ("cluster", "stats_month"),
}
