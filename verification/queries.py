"""Every operator as a named query over the star-schema tables.

Results are rounded here, and only here, so that two engines adding up in
different orders agree on the digits compared.  A nudge far below the last
digit settles exact ties the same way in both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar import sinks
from bazaar.operators import clean, compliance, increments, segment, stats, structure, trend, views, warehouse
from bazaar.plans import jobs
from bazaar.schema import FEATURE_COLUMNS
from bazaar.session import checkpoint_folder, settle
from bazaar.sources.csv import detect_charset, scan_csv
from bazaar.sources.parquet import scan_parquet
from bazaar.sources.star import LISTING_COLUMNS, load_dirty, load_sales, load_segmented, rule_segment, turns

Query = Callable[[SparkSession, str], DataFrame]

# Decimals compared, by column; six where not named.
DIGITS = {
    "list_price": 4, "actual_price": 4, "price": 4, "avg_list_price": 4, "avg_actual_price": 4,
    "avg_price": 4, "mu": 4, "sd": 4, "hhi": 4, "total_sales": 2, "weighted_sales": 3,
    "avg_monthly_sales": 5, "avg_review_count": 5, "avg_sales": 5, "efficiency_score": 4,
}


def rounded(df: DataFrame) -> DataFrame:
    def shown(c: str) -> Column:
        digits = DIGITS.get(c, 6)
        return F.round(F.col(f"`{c}`") + 10.0 ** -(digits + 3), digits)

    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: shown(c) for c in doubles})


def _on_sales(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf: rounded(operator(load_sales(spark, sf, *columns)))


def _on_segments(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf: rounded(operator(load_segmented(spark, sf, *columns)))


def _on_risk(operator: Callable[..., DataFrame], *columns: str) -> Query:
    """The price baseline needs line items only, not the joins of the listing."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        baseline = compliance.price_baseline(load_sales(spark, sf, "actual_price"))
        return rounded(operator(load_sales(spark, sf, *columns), baseline=baseline))

    return run


def _on_dirty(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf: rounded(operator(load_dirty(spark, sf, *columns)))


def _on_stored(load: Query, operator: Callable[[DataFrame], DataFrame]) -> Query:
    """For operators that read their rows several times: joins and conversions run once."""
    return lambda spark, sf: rounded(operator(settle(load(spark, sf))[0]))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources and sinks -------------------------------------------------------

def _scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "raw_csv")
    rows = [load_dirty(spark, sf, turn=turn) for turn in turns(spark, sf)]
    sinks.sink_csv_export(rows, path, compression="gzip")
    # Numbers are compared as numbers: engines spell large ones differently.
    return rounded(clean.parse_dates(clean.coerce_numeric(scan_csv(spark, path))))


def _scan_csv_records(spark: SparkSession, sf: str) -> DataFrame:
    """Real texts, with the line breaks they have, through a CSV in a charset of two bytes a character."""
    path = _folder(spark, "records_csv")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    note = F.concat_ws("\n", "o_orderstatus", F.concat(F.lit('say "城", '), "o_orderpriority"), F.lit(""))
    rows = orders.select("o_orderkey", note.alias("note"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("cust"))
    options = {"header": True, "encoding": "GB18030", "escape": '"', "ignoreTrailingWhiteSpace": False}
    with_charsets(spark, lambda: rows.write.options(**options).csv(path))
    found = scan_csv(spark, path)
    return found.select(F.col("o_orderkey").cast("long"), "note", F.col("cust").cast("long"))


def with_charsets(spark: SparkSession, write: Callable[[], None]) -> None:
    """Write in a charset that Spark has only on request."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    write()
    spark.conf.set(name, before)


def _charset_fallback(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "gb_csv")
    rows = load_sales(spark, sf, "city", "approval_no")
    with_charsets(spark, lambda: rows.write.options(header=True, encoding="GB18030").csv(path))
    charset = detect_charset(spark, path)
    found = scan_csv(spark, path, charset).groupBy("city", "approval_no").count()
    return found.withColumn("encoding_used", F.lit(charset))


def _sink_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "parquet")
    by = "stats_month"
    rows = [load_sales(spark, sf, *LISTING_COLUMNS, together=by, turn=turn) for turn in turns(spark, sf)]
    sinks.sink_parquet(rows, path, by, together=True)
    return rounded(scan_parquet(spark, path).select(LISTING_COLUMNS))


def _emit_table(spark: SparkSession, sf: str) -> DataFrame:
    table = warehouse.cluster_city_rank(
        load_segmented(spark, sf, "city", "monthly_sales", "actual_price", "rating")
    )
    stored, _ = sinks.emit_table(table, "cluster_city_rank", _folder(spark, "emit"))
    return rounded(spark.table("cluster_city_rank").select(stored.columns))


def _sink_json_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "json")
    table = trend.trend_section(
        load_sales(spark, sf, "city", "monthly_sales", "rating", "actual_price", "discount_rate"),
        "by_city",
    )
    sinks.sink_json_snapshot(table, path, 30)
    return rounded(spark.read.schema(table.schema).json(path))


def _sink_csv_export(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "csv")
    table = trend.trend_section(
        load_sales(spark, sf, "project_name", "monthly_sales", "actual_price", "rating"),
        "top_projects",
    )
    sinks.sink_csv_export(table, path)
    return rounded(spark.read.schema(table.schema).csv(path, header=True))


def _insights_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = load_segmented(spark, sf, "city", "channel", "monthly_sales", "actual_price", "rating")
    written = {}
    for name in ("cluster_city_rank", "cluster_channel_efficiency"):
        path = _folder(spark, name)
        operator, _ = warehouse.THEME_TABLES[name]
        written[name] = (path, sinks.emit_table(operator(rows), name, path)[1])
    manifest = sinks.insights_manifest(spark, written, k=3)
    return manifest.select("table", F.col("rows").alias("row_cnt"), "k")


# -- cleaning ------------------------------------------------------------------

_NUMBERS = ("city", "list_price", "monthly_sales")
_DATES = ("city", "collection_date")
_SPLIT = ("institution", "project_name", "city", "list_price", "doctor_name", "stats_month")


def _single_month(df: DataFrame) -> DataFrame:
    """All listings under one month, the input on which the month split acts."""
    return df.withColumn("stats_month", F.lit("1998-06"))


def _numeric(df: DataFrame) -> DataFrame:
    return clean.coerce_numeric(df)


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _numeric(load_dirty(spark, sf, *_NUMBERS))


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("city", "category", "institution", "district", "list_price", "monthly_sales",
               "collection_date")
    return rounded(clean.clean(load_dirty(spark, sf, *columns), names=columns))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """All raw columns, with their numbers and dates."""
    return clean.parse_dates(clean.coerce_numeric(load_dirty(spark, sf)))


def _standardize(df: DataFrame) -> DataFrame:
    names = ["town", "kind", "spare"]
    return clean.standardize_columns(df, names)


# -- segmentation ----------------------------------------------------------------


def _assign_nearest(df: DataFrame) -> DataFrame:
    """Nearest of the three rule segments' centres, in standardised units."""
    scaling = segment.fit_scaling(df)
    means = (
        rule_segment(df).groupBy("cluster").agg(*[F.avg(f).alias(f) for f in FEATURE_COLUMNS])
        .orderBy("cluster").collect()
    )
    centers = [
        [(row[f] - m) / s for f, m, s in zip(FEATURE_COLUMNS, scaling.mean, scaling.std)]
        for row in means
    ]
    return segment.assign_nearest_center(df, centers, scaling)


def _given_model(spark: SparkSession, sf: str) -> segment.Segmentation:
    """The means of the three rule segments as a model, numbered by rising first feature."""
    rows = load_segmented(spark, sf, *FEATURE_COLUMNS)
    scaling = segment.fit_scaling(rows)
    means = rows.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in FEATURE_COLUMNS]).collect()
    centers = [tuple((r[f] - m) / s for f, m, s in zip(FEATURE_COLUMNS, scaling.mean, scaling.std)) for r in means]
    return segment.Segmentation(scaling, tuple(sorted(centers)))


def _kmeans_profile(spark: SparkSession, sf: str) -> DataFrame:
    listings = load_sales(spark, sf, *FEATURE_COLUMNS)
    return rounded(warehouse.cluster_profile(segment.kmeans_cluster(listings)))


def _centers(spark: SparkSession, sf: str) -> DataFrame:
    model = segment.fit_segments(load_sales(spark, sf, *FEATURE_COLUMNS))
    return segment.cluster_centers(spark, model)


# -- whole jobs --------------------------------------------------------------------


# Jobs take a stored table, of which each of their tables reads the columns it needs.
_THEME_COLUMNS = (*FEATURE_COLUMNS, "city", "category", "channel", "project_name", "doctor_title", "doctor_name",
                  "stats_month")
_REPORT_COLUMNS = (*FEATURE_COLUMNS, "city", "category", "institution", "project_name", "udi_match", "approval_no")


def _build_warehouse(spark: SparkSession, sf: str) -> DataFrame:
    listings, _ = settle(load_segmented(spark, sf, *_THEME_COLUMNS))
    manifest = jobs.build_warehouse(listings, _folder(spark, "dws"))
    return manifest.select("table", F.col("rows").alias("row_cnt"), "k")


def _advanced_report(spark: SparkSession, sf: str) -> DataFrame:
    listings, _ = settle(load_sales(spark, sf, *_REPORT_COLUMNS))
    manifest = jobs.advanced_report(listings, _folder(spark, "ads"))
    return manifest.select("table", F.col("rows").alias("row_cnt"))


def _by_months(df: DataFrame, path: str, partials: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Partial results stored in two runs, the second adding months to the first."""
    early = F.col("stats_month") < "1995-01"
    made = [partials(df.where(early)), partials(df.where(~early))]
    for part in made:
        increments.put_months(part, path)
    return increments.stored_months(df.sparkSession, path, made[0])


def _trend_by_months(spark: SparkSession, sf: str) -> DataFrame:
    df = load_segmented(spark, sf, *LISTING_COLUMNS)
    stored = _by_months(df, _folder(spark, "trend_months"), increments.trend_partials)
    return rounded(increments.trend_report_of(stored, trend.available_sections(df)))


def _doctors_by_months(spark: SparkSession, sf: str) -> DataFrame:
    df, _ = settle(load_segmented(
        spark, sf, "doctor_title", "doctor_name", "monthly_sales", "actual_price", "rating", "stats_month"
    ))
    names = _folder(spark, "doctors")

    def partials(rows: DataFrame) -> DataFrame:
        return increments.doctor_partials(rows, increments.known_doctors(rows, names))

    return rounded(increments.doctor_matching_of(_by_months(df, _folder(spark, "doctor_months"), partials)))


def _similarity_pairs(df: DataFrame) -> DataFrame:
    """The nested result as flat rows, for comparison."""
    return structure.city_similarity_top(df).select(
        "city", F.posexplode("top_similar").alias("pos", "entry")
    ).select(
        "city", (F.col("pos") + 1).cast("long").alias("rn"),
        F.col("entry.city").alias("similar_city"), "entry.similarity",
    )


def _segmented_theme(name: str, view: Callable[[DataFrame], DataFrame]) -> Callable:
    operator, _ = warehouse.THEME_TABLES[name]
    return lambda df: view(operator(df))


def build() -> dict[str, Query]:
    sales, price, rating = "monthly_sales", "actual_price", "rating"
    known: dict[str, Query] = {
        "scan_csv": _scan_csv,
        "scan_csv_records": _scan_csv_records,
        "charset_fallback": _charset_fallback,
        "scan_parquet": lambda spark, sf: rounded(
            scan_parquet(spark, f"{sf}/lineitem.parquet", ["l_linenumber"])
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
        ),
        "sink_parquet": _sink_parquet,
        "emit_table": _emit_table,
        "sink_json_snapshot": _sink_json_snapshot,
        "insights_manifest": _insights_manifest,
        "sink_csv_export": _sink_csv_export,
        "standardize_columns": _on_sales(_standardize, "city", "category"),
        "coerce_numeric": _on_dirty(_numeric, *_NUMBERS),
        "parse_dates": _on_dirty(clean.parse_dates, *_DATES),
        "derive_stats_month": _on_dirty(
            lambda df: clean.derive_stats_month(clean.parse_dates(df)).drop("collection_date"), *_DATES
        ),
        "drop_duplicates": _on_dirty(
            lambda df: clean.drop_duplicate_rows(clean.parse_dates(_numeric(df))), *_NUMBERS,
            "institution", "collection_date",
        ),
        "fill_median": _on_stored(_numbers, clean.fill_median),
        "fill_unknown": _on_dirty(clean.fill_unknown, "city", "district"),
        "remove_outliers_iqr": _on_stored(_numbers, clean.remove_outliers_iqr),
        "remove_outliers_simultaneous": _on_stored(
            _numbers, lambda df: clean.remove_outliers_iqr(df, sequential=False)
        ),
        "split_single_month": _on_stored(
            lambda spark, sf: load_sales(spark, sf, *_SPLIT), lambda df: clean.split_single_month(_single_month(df))
        ),
        "clean": _clean,
        # The same over all raw columns and all nine numbers.
        "clean_all_columns": lambda spark, sf: rounded(clean.clean(
            [load_dirty(spark, sf, turn=turn) for turn in turns(spark, sf)]
        )),
        "coerce_all_columns": lambda spark, sf: rounded(_typed(spark, sf)),
        "fill_median_all_columns": _on_stored(_typed, clean.fill_median),
        "remove_outliers_all_columns": _on_stored(_typed, clean.remove_outliers_iqr),
        "cast_numeric_cols": _on_dirty(
            lambda df: clean.cast_numeric(df, ["monthly_sales"]), "city", "monthly_sales"
        ),
        "drop_null_features": _on_dirty(lambda df: clean.drop_null_features(_numeric(df)), *_NUMBERS),
        "validate_storage": _on_sales(clean.validate_storage, "city", "category", sales, "stats_month"),
        "month_distribution": _on_dirty(
            lambda df: clean.month_distribution(clean.derive_stats_month(clean.parse_dates(df))), *_DATES
        ),
        "assemble_features": lambda spark, sf: segment.assemble_features(
            load_sales(spark, sf, *FEATURE_COLUMNS)
        ).select(vector_to_array("features").alias("features")),
        "standardize_features": _on_sales(segment.standardize_features, *FEATURE_COLUMNS),
        "kmeans_cluster": _kmeans_profile,
        "cluster_centers": _centers,
        "elbow_sweep": lambda spark, sf: segment.elbow_sweep(load_sales(spark, sf, *FEATURE_COLUMNS)),
        "assign_nearest_center": _on_sales(_assign_nearest, *FEATURE_COLUMNS),
        "centers_table": lambda spark, sf: segment.centers_table(_centers(spark, sf)),
        # The same from given centres, which SQL can follow.
        "cluster_centers_given": lambda spark, sf: rounded(segment.cluster_centers(spark, _given_model(spark, sf))),
        "centers_table_given": lambda spark, sf: rounded(
            segment.centers_table(segment.cluster_centers(spark, _given_model(spark, sf)))
        ),
        "assemble_features_given": lambda spark, sf: rounded(segment.assemble_features(
            load_sales(spark, sf, *FEATURE_COLUMNS)
        ).select(*[vector_to_array("features")[i].alias(f) for i, f in enumerate(FEATURE_COLUMNS)])),
        "trend_report": _on_segments(trend.trend_report, *LISTING_COLUMNS),
        "trend_report_by_months": _trend_by_months,
        "cluster_doctor_matching_by_months": _doctors_by_months,
        "build_warehouse": _build_warehouse,
        "pearson_matrix": _on_sales(stats.pearson_matrix, *FEATURE_COLUMNS),
        "spearman_matrix": _on_sales(stats.spearman_matrix, *FEATURE_COLUMNS),
        "spearman_matrix_average": _on_sales(
            lambda df: stats.spearman_matrix(df, ties="average"), *FEATURE_COLUMNS
        ),
        # The same in many small steps, as on large tables.
        "spearman_matrix_sliced": _on_sales(
            lambda df: stats.spearman_matrix(df, slices=23), *FEATURE_COLUMNS
        ),
        "pareto_projects_sliced": _on_sales(
            lambda df: structure.pareto_projects(df, slices=23), "project_name", sales
        ),
        "remove_outliers_iqr_narrowed": _on_stored(_numbers, clean.remove_outliers_iqr),
        "price_elasticity": _on_sales(stats.price_elasticity, "category", price, sales),
        "rating_sales_corr_by_city": _on_sales(stats.rating_sales_corr_by_city, "city", rating, sales),
        "rating_sales_corr_by_category": _on_sales(
            stats.rating_sales_corr_by_category, "category", rating, sales
        ),
        "hhi_overall": _on_sales(structure.hhi_overall, "institution", sales),
        "hhi_by_city": _on_sales(structure.hhi_by_city, "city", "institution", sales),
        "hhi_by_category": _on_sales(structure.hhi_by_category, "category", "institution", sales),
        "pareto_projects": _on_sales(structure.pareto_projects, "project_name", sales),
        "pareto_breakpoints": _on_sales(structure.pareto_breakpoints, "project_name", sales),
        "pareto_sample": _on_sales(structure.pareto_sample, "project_name", sales),
        "city_category_matrix": _on_sales(structure.city_category_matrix, "city", "category", sales),
        "city_similarity": _on_sales(structure.city_similarity, "city", "category", sales),
        "city_similarity_top": _on_sales(_similarity_pairs, "city", "category", sales),
        "price_baseline": _on_sales(compliance.price_baseline, price),
        "advanced_report": _advanced_report,
        "analytics_for_month": _on_sales(
            lambda df: views.analytics_for_month(df, "1998-06"), *LISTING_COLUMNS
        ),
        "month_options": _on_sales(views.month_options, "stats_month"),
        "overview_kpis": _on_sales(views.overview_kpis, "city", "category", "channel", *FEATURE_COLUMNS),
        "top_n_cities": _on_sales(
            lambda df: views.top_n_cities(trend.trend_section(df, "by_city")),
            "city", sales, rating, price, "discount_rate",
        ),
        "all_cities": _on_sales(
            lambda df: views.top_n_cities(trend.trend_section(df, "by_city", limit=None), None),
            "city", sales, rating, price, "discount_rate",
        ),
        "elasticity_class": _on_sales(
            lambda df: views.elasticity_class(stats.price_elasticity(df)), "category", price, sales
        ),
        "concentration_class": _on_sales(
            lambda df: views.concentration_class(structure.hhi_by_city(df), "city"),
            "city", "institution", sales,
        ),
        "pareto_points": _on_sales(structure.pareto_points, "project_name", sales),
    }
    compliance_columns = ("udi_match", "approval_no", rating, price, sales)
    known["compliance_metrics"] = _on_risk(compliance.compliance_metrics, *compliance_columns)
    for operator, key in [
        (compliance.institution_risk, "institution"),
        (compliance.institution_risk_top, "institution"),
        (compliance.institution_risk_bottom, "institution"),
        (compliance.institution_risk_distribution, "institution"),
        (compliance.category_risk, "category"),
        (compliance.city_risk, "city"),
    ]:
        known[operator.__name__] = _on_risk(operator, key, *compliance_columns)
    known["institution_risk_sliced"] = _on_risk(
        lambda df, baseline: compliance.institution_risk(df, baseline=baseline, slices=23),
        "institution", *compliance_columns,
    )
    for name, section in trend.SECTIONS.items():
        columns = trend.inputs(section) or [sales]
        load = _on_segments if "cluster" in section.keys else _on_sales
        known[name] = load(
            lambda df, name=name: trend.trend_section(df, name), *[c for c in columns if c != "cluster"]
        )
    themes = {
        "cluster_profile": FEATURE_COLUMNS,
        "cluster_city_rank": ["city", sales, price, rating],
        "cluster_category_preference": ["category", sales],
        "cluster_channel_efficiency": ["channel", sales, price, rating],
        "cluster_price_band": ["discount_rate", sales, price, rating],
        "cluster_top_projects": ["project_name", sales, price, rating],
        "cluster_doctor_matching": ["doctor_title", "doctor_name", sales, price, rating],
        "cluster_month_delta": ["stats_month", sales, price],
    }
    for name, columns in themes.items():
        known[name] = _on_segments(warehouse.THEME_TABLES[name][0], *columns)
    for name, theme, view in [
        ("city_spread_top10", "cluster_city_rank", views.city_spread_top10),
        ("lift_heatmap", "cluster_category_preference", views.lift_heatmap),
        ("band_pivot", "cluster_price_band", views.band_pivot),
        ("month_pivot", "cluster_month_delta", views.month_pivot),
        ("channel_pivot", "cluster_channel_efficiency", views.channel_pivot),
        ("doctor_title_pivot", "cluster_doctor_matching", views.doctor_title_pivot),
    ]:
        known[name] = _on_segments(_segmented_theme(theme, view), *themes[theme])
    return known
