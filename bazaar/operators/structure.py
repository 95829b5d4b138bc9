"""Market structure: concentration, Pareto curve, similarity of cities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.numeric import all_present, ratio
from bazaar.functions.ordering import ordered_prefix
from bazaar.functions.pairs import every_pair
from bazaar.schema import DEFAULT_ROLES, Roles
from bazaar.session import settle

BREAKPOINTS = (0.5, 0.8, 0.95)
# Columns a wide table may have.
MAX_COLUMNS = 1_000


def _sales_by(df: DataFrame, *by: str, roles: Roles, total: str) -> DataFrame:
    columns, (sales,) = roles.of(*by), roles.of("monthly_sales")
    known = df.where(all_present(columns))
    return known.groupBy(*[F.col(c).alias(b) for c, b in zip(columns, by)]).agg(
        F.sum(sales).alias(total)
    )


def concentration_level(hhi: Column) -> Column:
    """Competitive, moderately or highly concentrated."""
    # Cuts and labels.
    return F.when(hhi < 1500, "竞争充分").when(hhi < 2500, "中度集中").otherwise("高度集中")


def hhi_overall(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Concentration of sales over institutions, in one row.

    The index needs only the sum and the sum of squares; the leading shares
    come from a sorted cut of ten rows, joined to them by addition.
    """
    shops = _sales_by(df, "institution", roles=roles, total="ss")
    top = shops.orderBy(F.desc_nulls_last("ss"), "institution").limit(10)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("ss"), "institution"))
    leaders = top.select("ss", place.alias("rn")).agg(
        F.lit(None).cast("double").alias("ss"),
        F.lit(None).cast("double").alias("squares"),
        F.lit(0).cast("long").alias("shops"),
        F.sum("ss").alias("top10"),
        F.sum(F.when(F.col("rn") <= 5, F.col("ss"))).alias("top5"),
    )
    whole = shops.agg(
        F.sum("ss").alias("ss"),
        F.sum(F.col("ss") * F.col("ss")).alias("squares"),
        F.count(F.lit(1)).alias("shops"),
        F.lit(None).cast("double").alias("top10"),
        F.lit(None).cast("double").alias("top5"),
    )
    total = F.sum("ss")
    return whole.unionByName(leaders).agg(
        (ratio(F.sum("squares"), total * total) * 10000).alias("hhi"),
        ratio(F.sum("top10"), total).alias("cr10"),
        ratio(F.sum("top5"), total).alias("cr5"),
        F.sum("shops").alias("institution_count"),
        total.alias("total_sales"),
    )


def _hhi_within(df: DataFrame, by: str, roles: Roles) -> DataFrame:
    """Concentration within each ``by`` group.

    The ten largest of a group are picked before anything is shuffled, and then
    from at most ten of each task, so a group holding most institutions is never
    one task's work.  Sums and leaders are joined by addition.
    """
    shops = _sales_by(df, by, "institution", roles=roles, total="ss")
    largest = Window.partitionBy(by).orderBy(F.desc_nulls_last("ss"), "institution")
    leaders = shops.withColumn("rn", F.row_number().over(largest)).where(F.col("rn") <= 10)
    sums = shops.groupBy(by).agg(
        F.sum("ss").alias("ss"),
        F.sum(F.col("ss") * F.col("ss")).alias("squares"),
        F.count(F.lit(1)).alias("shops"),
        F.lit(None).cast("double").alias("top10"),
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ss", "double"), ("squares", "double"), ("shops", "long"))]
    both = sums.unionByName(leaders.groupBy(by).agg(F.sum("ss").alias("top10")).select(by, *none, "top10"))
    total = F.sum("ss")
    return both.groupBy(by).agg(
        (ratio(F.sum("squares"), total * total) * 10000).alias("hhi"),
        ratio(F.sum("top10"), total).alias("cr10"),
        F.sum("shops").alias("institution_count"),
        total.alias("total_sales"),
    )


def hhi_by_city(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return (
        _hhi_within(df, "city", roles)
        .withColumn("concentration_level", concentration_level(F.col("hhi")))
        .orderBy(F.desc_nulls_last("hhi"), "city")
    )


def hhi_by_category(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return (
        _hhi_within(df, "category", roles)
        .drop("total_sales")
        .orderBy(F.desc_nulls_last("hhi"), "category")
    )


def _pareto(df: DataFrame, roles: Roles, slices: int | None = None) -> DataFrame:
    projects = _sales_by(df, "project_name", roles=roles, total="total_sales")
    placed = ordered_prefix(
        projects,
        [F.desc_nulls_last("total_sales"), F.asc("project_name")],
        running={"cum_sales": "total_sales"},
        slices=slices,
    )
    return placed.select(
        "project_name",
        "total_sales",
        F.col("position").alias("rn"),
        "cum_sales",
        ratio(F.col("cum_sales"), F.col("cum_sales_total")).alias("cum_share"),
        (F.col("position") / F.col("rows_total")).alias("project_share"),
        "rows_total",
    )


def pareto_projects(
    df: DataFrame, roles: Roles = DEFAULT_ROLES, slices: int | None = None
) -> DataFrame:
    """Projects by falling sales with running sales and shares."""
    return _pareto(df, roles, slices).drop("rows_total").orderBy("rn")


def breakpoints_of(pareto: DataFrame, thresholds: Sequence[float] = BREAKPOINTS) -> DataFrame:
    """Break points read off a curve that is there already."""
    reached = F.filter(
        F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("cum_share") >= t
    )
    return (
        pareto.select(F.explode(reached).alias("cum_share_threshold"), "rn", "project_share")
        .groupBy("cum_share_threshold")
        .agg(F.min_by("project_share", "rn").alias("project_share"), F.min("rn").alias("rn"))
    )


def pareto_breakpoints(
    df: DataFrame, thresholds: Sequence[float] = BREAKPOINTS, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """The first project at which the running share reaches each threshold."""
    return breakpoints_of(_pareto(df, roles), thresholds).orderBy("cum_share_threshold")


def sample_of(pareto: DataFrame, rows: Column, points: int = 500) -> DataFrame:
    """Every so-many-th of the ``rows`` of a curve that is there already."""
    step = F.greatest(F.lit(1), F.floor(rows / points))
    return pareto.where((F.col("rn") - 1) % step == 0)


def pareto_sample(
    df: DataFrame, points: int = 500, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """Every so-many-th row of the curve, enough for a chart."""
    return sample_of(_pareto(df, roles), F.col("rows_total"), points).drop("rows_total").orderBy("rn")


def pareto_points(df: DataFrame, points: int = 500, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Chart coordinates in percent; break points carry their threshold."""
    curve, _ = settle(_pareto(df, roles).select("rn", "project_share", "cum_share", "rows_total"))

    def percent(c: str) -> Column:
        return F.round(F.col(c) * 100, 2)

    line = sample_of(curve, F.col("rows_total"), points).select(
        F.lit("point").alias("kind"), "rn",
        percent("project_share").alias("project_pct"), percent("cum_share").alias("cum_pct"),
    )
    marks = breakpoints_of(curve).select(
        F.lit("mark").alias("kind"), "rn", percent("project_share").alias("project_pct"),
        percent("cum_share_threshold").alias("cum_pct"),
    )
    return line.unionByName(marks).orderBy("kind", "rn", "cum_pct")


def city_category_sales(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Sales per city and category, long form."""
    return _sales_by(df, "city", "category", roles=roles, total="total_sales")


def city_category_matrix(
    df: DataFrame, roles: Roles = DEFAULT_ROLES, categories: Sequence[str] | None = None
) -> DataFrame:
    """Cities by categories, one column per category, zero where nothing sold.

    ``categories`` names the columns; without it they are looked up, and a table
    of more than ``MAX_COLUMNS`` is refused.
    """
    cells = city_category_sales(df, roles)
    if categories is None:
        known = cells.select("category").distinct().limit(MAX_COLUMNS + 1).collect()
        if len(known) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} categories; name the ones to show")
        categories = sorted(r["category"] for r in known)
    wide = cells.groupBy("city").pivot("category", list(categories)).sum("total_sales")
    return wide.fillna(0.0).orderBy("city")


def _unit_cells(cells: DataFrame) -> DataFrame:
    """Each city's category sales as a vector of length 1; zeros are left out."""
    norms = cells.groupBy("city").agg(
        F.sqrt(F.sum(F.col("total_sales") * F.col("total_sales"))).alias("_norm")
    )
    scaled = cells.where(F.col("total_sales") != 0).join(norms.where("_norm > 0"), "city")
    return scaled.select("city", "category", (F.col("total_sales") / F.col("_norm")).alias("v"))


def _shared(cells: DataFrame) -> DataFrame:
    """Cosine of every ordered pair of cities that share a category: only cells meet that multiply."""
    unit = _unit_cells(cells)
    a = unit.select("category", F.col("city").alias("city_a"), F.col("v").alias("x"))
    b = unit.select("category", F.col("city").alias("city_b"), F.col("v").alias("y"))
    product = F.sum(F.col("x") * F.col("y")).alias("similarity")
    return a.join(b, "category").groupBy("city_a", "city_b").agg(product)


def city_similarity(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Cosine of category sales for every ordered pair of cities, self included.

    The result has a row per pair, zeros too: ask for it only where cities are
    few.  ``city_similarity_top`` needs no such table.
    """
    cells = city_category_sales(df, roles)
    cities = cells.select("city").distinct()
    # Pairs without a common category too.
    pairs = every_pair(cities.withColumnRenamed("city", "city_a"), cities.withColumnRenamed("city", "city_b"))
    zeros = pairs.select("city_a", "city_b", F.lit(0.0).alias("similarity"))
    both = _shared(cells).unionByName(zeros)
    return both.groupBy("city_a", "city_b").agg(F.sum("similarity").alias("similarity")).orderBy(
        "city_a", "city_b"
    )


# Bands of partial norms, and what rounding may take from a bound.
_BANDS = 64
_MARGIN = 1e-9
# Heaviest categories of a city whose leaders are looked at first.
_HEAVIEST = 3


def _cosines(unit: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with their exact ``similarity``."""
    a = unit.select(F.col("city").alias("city_a"), "category", F.col("v").alias("x"))
    b = unit.select(F.col("city").alias("city_b"), "category", F.col("v").alias("y"))
    both = pairs.join(a, "city_a").join(b, ["city_b", "category"])
    return both.groupBy("city_a", "city_b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))


def close_pairs(unit: DataFrame, n: int) -> DataFrame:
    """Pairs that hold the ``n`` others of greatest cosine of each city, from unit vectors in long form.

    A few leaders of a city's heaviest categories give its ``n``-th best cosine so
    far.  Categories are then taken in one order for all cities, rare ones first:
    two cities whose first common category is ``c`` have at most the product of
    the norms of what each holds from ``c`` on, so they meet over ``c`` only if that
    reaches the best so far.  Norms are cut into bands, so that those too small
    are not even looked at.  Fewer than ``n`` leaders bound nothing.
    """
    popular = unit.groupBy("category").agg(F.count(F.lit(1)).alias("cities"))
    onwards = Window.partitionBy("city").orderBy("cities", "category").rowsBetween(0, Window.unboundedFollowing)
    left = F.sqrt(F.sum(F.col("v") * F.col("v")).over(onwards)).alias("left")
    placed, _ = settle(unit.join(popular, "category").select("city", "category", "v", left))

    heavy = Window.partitionBy("city").orderBy(F.desc(F.abs("v")), "category")
    lead = Window.partitionBy("category").orderBy(F.desc("v"), "city")
    mine = placed.withColumn("rn", F.row_number().over(heavy)).where(F.col("rn") <= _HEAVIEST)
    best = placed.withColumn("rn", F.row_number().over(lead)).where(F.col("rn") <= n + 1)
    first = mine.select("category", F.col("city").alias("city_a")).join(
        best.select("category", F.col("city").alias("city_b")), "category"
    )
    first, _ = settle(first.where(F.col("city_a") != F.col("city_b")).select("city_a", "city_b").distinct())
    nearest = Window.partitionBy("city_a").orderBy(F.desc("similarity"))
    reached = _cosines(placed, first).withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") == n)
    reached = reached.select(F.col("city_a").alias("city"), (F.col("similarity") - _MARGIN).alias("least"))

    def band(norm: Column) -> Column:
        return F.least(F.floor(norm * _BANDS), F.lit(_BANDS)).cast("int")

    asked = placed.join(reached, "city", "left").withColumn("least", F.greatest(F.coalesce("least", F.lit(0.0)), F.lit(0.0)))
    asked = asked.where(F.col("left") >= F.col("least")).select(
        "category", F.col("city").alias("city_a"), F.col("left").alias("norm_a"), "least",
        F.explode(F.sequence(band(F.col("least") / F.col("left")), F.lit(_BANDS))).alias("band"),
    )
    offered = placed.select(
        "category", F.col("city").alias("city_b"), F.col("left").alias("norm_b"), band(F.col("left")).alias("band")
    )
    met = asked.join(offered, ["category", "band"]).where(
        (F.col("city_a") != F.col("city_b")) & (F.col("norm_a") * F.col("norm_b") >= F.col("least"))
    )
    pairs = met.select("city_a", "city_b").unionByName(first).distinct()
    return _cosines(placed, pairs)


def city_similarity_top(df: DataFrame, n: int = 5, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """The ``n`` other cities most like each city, as an array of structs.

    Only pairs that can be among them are formed (``close_pairs``).  Where fewer
    have a category in common, cities of similarity zero fill up, first by name:
    a few names are enough for all.
    """
    cells = city_category_sales(df, roles)
    cities = cells.select("city").distinct()
    few = cities.orderBy("city").limit(2 * n + 1).agg(F.collect_list("city")).scalar()
    zeros = cities.select(
        F.col("city").alias("city_a"), F.explode(few).alias("city_b"), F.lit(0.0).alias("similarity")
    )
    unit, _ = settle(_unit_cells(cells))
    both = close_pairs(unit, n).unionByName(zeros).groupBy("city_a", "city_b")
    return closest_of(both.agg(F.sum("similarity").alias("similarity")), n)


def closest_of(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The closest others of each city, from pairs that are there already."""
    closest = Window.partitionBy("city_a").orderBy(F.desc("similarity"), "city_b")
    others = pairs.where(F.col("city_a") != F.col("city_b"))
    best = others.withColumn("rn", F.row_number().over(closest)).where(F.col("rn") <= n)
    entry = F.struct("rn", F.col("city_b").alias("city"), "similarity")
    return (
        best.groupBy(F.col("city_a").alias("city"))
        .agg(F.array_sort(F.collect_list(entry)).alias("found"))
        .select(
            "city",
            F.transform("found", lambda e: F.struct(e["city"].alias("city"),
                                                    e["similarity"].alias("similarity")))
            .alias("top_similar"),
        )
        .orderBy("city")
    )
