"""Whole jobs: from a raw file to stored tables, one function per layer.

Each job stores what it makes and hands on the stored tables.  Inputs are not
cached: a theme table reads a few columns of a Parquet table, and holding all
columns of all rows in the executors costs more than reading those again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bazaar.operators import compliance, stats, structure
from bazaar.operators.clean import cast_numeric, clean, validate_storage
from bazaar.operators.segment import (
    DEFAULT_K,
    assign_segments,
    centers_table,
    cluster_centers,
    fit_segments,
)
from bazaar.operators.trend import SECTIONS, available_sections, trend_report
from bazaar.operators.warehouse import THEME_ORDER, THEME_TABLES
from bazaar.schema import DEFAULT_ROLES, FEATURE_COLUMNS, Roles
from bazaar.session import settle
from bazaar.sinks import emit_table, insights_manifest, sink_json_snapshot, sink_parquet
from bazaar.sources.csv import scan_csv
from bazaar.sources.csv_records import survey

# Table -> operator over (listings, roles, price baseline).
ADVANCED_TABLES = {
    "stat_pearson": lambda df, roles, _: stats.pearson_matrix(df, roles.of(*FEATURE_COLUMNS)),
    "stat_spearman": lambda df, roles, _: stats.spearman_matrix(df, roles.of(*FEATURE_COLUMNS)),
    "stat_price_elasticity": lambda df, roles, _: stats.price_elasticity(df, roles),
    "stat_rating_sales_by_city": lambda df, roles, _: stats.rating_sales_corr_by_city(df, roles),
    "stat_rating_sales_by_category": lambda df, roles, _: stats.rating_sales_corr_by_category(df, roles),
    "struct_hhi_overall": lambda df, roles, _: structure.hhi_overall(df, roles),
    "struct_hhi_by_city": lambda df, roles, _: structure.hhi_by_city(df, roles),
    "struct_hhi_by_category": lambda df, roles, _: structure.hhi_by_category(df, roles),
    "struct_pareto_projects": lambda df, roles, _: structure.pareto_projects(df, roles),
    "struct_city_similarity_top": lambda df, roles, _: structure.city_similarity_top(df, roles=roles),
    "comp_institution_risk": lambda df, roles, base: compliance.institution_risk(
        df, roles=roles, baseline=base
    ),
    "comp_category_risk": lambda df, roles, base: compliance.category_risk(df, roles, base),
    "comp_city_risk": lambda df, roles, base: compliance.city_risk(df, roles, base),
}

# The columns each is shown in the order of; highest first with a minus.
ADVANCED_ORDER = {
    "stat_pearson": ("feature_a", "feature_b"),
    "stat_spearman": ("feature_a", "feature_b"),
    "stat_price_elasticity": ("elasticity", "category"),
    "stat_rating_sales_by_city": ("-corr_rating_sales", "city"),
    "stat_rating_sales_by_category": ("-corr_rating_sales", "category"),
    "struct_hhi_by_city": ("-hhi", "city"),
    "struct_hhi_by_category": ("-hhi", "category"),
    "struct_city_similarity_top": ("city",),
    "comp_category_risk": ("-udi_mismatch_rate", "category"),
    "comp_city_risk": ("-udi_mismatch_rate", "city"),
    "pareto_projects": ("rn",),
    "pareto_breakpoints": ("cum_share_threshold",),
    "institution_risk_top": ("risk_rank", "institution"),
    "institution_risk_bottom": ("risk_rank", "institution"),
}


def clean_job(
    spark: SparkSession, csv_uri: str, out_uri: str, encoding: str | None = None,
    remove_outliers: bool = True, split_month: bool = False, multi_line: bool | None = None,
) -> dict:
    """Raw CSV to a clean Parquet table by month; says how many rows went in and out."""
    known = survey(spark, csv_uri, encoding)
    seen = Observation()
    # Cleaning reads the raw rows once more, and counts them on the way.
    raw = scan_csv(spark, csv_uri, multi_line=multi_line, known=known).observe(seen, F.count(F.lit(1)).alias("rows"))
    after = sink_parquet(clean(raw, remove_outliers, split_month), out_uri, DEFAULT_ROLES.stats_month)
    return {
        "total_before": seen.get["rows"], "total_after": after,
        "output_path": out_uri, "encoding_used": known.charset,
    }


def cluster_job(
    spark: SparkSession, clean_uri: str, out_dir: str, k: int = DEFAULT_K
) -> tuple[DataFrame, DataFrame]:
    """Fit segments, store the table with its ``cluster`` and the centres."""
    listings = spark.read.parquet(clean_uri)
    model = fit_segments(listings, k)
    clustered, _ = emit_table(
        assign_segments(listings, model), "sales_clustered", f"{out_dir}/clustered_data.parquet"
    )
    centers = cluster_centers(spark, model)
    sink_json_snapshot(centers, f"{out_dir}/cluster_centers")
    sink_json_snapshot(centers_table(centers, model.scaling.features), f"{out_dir}/centers_table")
    return clustered, centers


def trend_job(df: DataFrame, out_dir: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """All trend sections from one scan, stored, and a snapshot of each."""
    report, _ = emit_table(
        trend_report(df, roles=roles), "trend_report", f"{out_dir}/trend_report.parquet"
    )
    # The report has all keys as text; they get their types back, and so their order.
    kinds = {role: df.schema[c].dataType for role, c in zip(("cluster",), roles.of("cluster")) if c in df.columns}
    for name in available_sections(df, roles):
        section = SECTIONS[name]
        rows = report.where(F.col("section") == name).select(
            *[F.col(f"key_{i + 1}").cast(kinds.get(k, "string")).alias(k) for i, k in enumerate(section.keys)],
            *[F.col(m if m in report.columns else "row_cnt").alias(m) for m in section.measures],
        )
        if section.keys:
            rows = rows.orderBy(*section.order())
        sink_json_snapshot(rows, f"{out_dir}/trend_stats/{name}", section.limit)
    return report


def build_warehouse(
    df: DataFrame, out_dir: str, roles: Roles = DEFAULT_ROLES, centers: DataFrame | None = None
) -> DataFrame:
    """Store the eight theme tables, their snapshots, the centres if given, and a manifest."""
    (cluster,) = roles.of("cluster")
    if cluster not in df.columns:
        raise ValueError(f"the table has no {cluster} column; assign segments first")
    spark = df.sparkSession
    typed = cast_numeric(df).withColumn(cluster, F.col(cluster).cast("int"))
    written = {}
    for name, (operator, limit) in THEME_TABLES.items():
        path = f"{out_dir}/cluster_tables/{name}.parquet"
        table, rows = emit_table(operator(typed, roles), name, path)
        sink_json_snapshot(table, f"{out_dir}/cluster_insights/{name}", limit, THEME_ORDER[name])
        written[name] = (path, rows)
    rows = spark.table("cluster_profile").agg(F.sum("project_count")).first()[0] or 0
    manifest = insights_manifest(spark, written, k=written["cluster_profile"][1], total_rows=rows)
    if centers is not None:
        sink_json_snapshot(centers, f"{out_dir}/cluster_insights/_centers", order=("cluster", "feature"))
    sink_json_snapshot(manifest, f"{out_dir}/cluster_insights/_manifest", order=("table",))
    return manifest


def advanced_report(
    df: DataFrame, out_dir: str, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """Store the statistics, structure and compliance tables, snapshots and a manifest.

    Snapshots are cut from the stored tables, not worked out again.
    """
    spark = df.sparkSession
    typed = cast_numeric(cast_numeric(df), roles.of("udi_match"))
    baseline, _ = settle(compliance.price_baseline(typed, roles))
    written, tables = {}, {}
    for name, operator in ADVANCED_TABLES.items():
        path = f"{out_dir}/advanced_tables/{name}.parquet"
        tables[name], rows = emit_table(operator(typed, roles, baseline), name, path)
        written[name] = (path, rows)

    pareto, risk = tables["struct_pareto_projects"], tables["comp_institution_risk"]
    projects = F.lit(written["struct_pareto_projects"][1])
    cut = ("struct_pareto_projects", "comp_institution_risk")
    snapshots = {name: table for name, table in tables.items() if name not in cut}
    snapshots |= {
        "pareto_projects": structure.sample_of(pareto, projects),
        "pareto_breakpoints": structure.breakpoints_of(pareto),
        "price_baseline": baseline,
        "institution_risk_top": risk.orderBy("risk_rank", "institution").limit(50),
        "institution_risk_bottom": compliance.bottom_of(risk),
        "institution_risk_distribution": compliance.distribution_of(risk),
    }
    for name, table in snapshots.items():
        sink_json_snapshot(table, f"{out_dir}/advanced_insights/{name}", order=ADVANCED_ORDER.get(name, ()))
    manifest = insights_manifest(spark, written)
    sink_json_snapshot(manifest, f"{out_dir}/advanced_insights/_manifest", order=("table",))
    return manifest


def run_all(
    spark: SparkSession, csv_uri: str, out_dir: str, k: int = DEFAULT_K,
    encoding: str | None = None,
) -> DataFrame:
    """Every layer in turn; returns the manifest of all stored tables."""
    clean_uri = f"{out_dir}/clean_data.parquet"
    clean_job(spark, csv_uri, clean_uri, encoding)
    stored = spark.read.parquet(clean_uri)
    state = validate_storage(stored, clean_uri)
    sink_json_snapshot(state, f"{out_dir}/storage_state")
    if missing := state.first()["missing_required_columns"]:
        raise ValueError(f"the clean table lacks {missing}")
    clustered, centers = cluster_job(spark, clean_uri, out_dir, k)
    trend_job(clustered, out_dir)
    themes = build_warehouse(clustered, out_dir, centers=centers)
    advanced = advanced_report(spark.read.parquet(clean_uri), out_dir)
    return themes.drop("k", "total_rows").unionByName(advanced)
