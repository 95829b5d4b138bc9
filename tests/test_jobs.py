"""From a raw file to all stored tables."""

import json

import pytest
from pyspark.sql import functions as F

from bazaar.plans import jobs
from bazaar.operators.warehouse import THEME_TABLES
from bazaar.sinks import sink_csv_export
from bazaar.sources.star import load_dirty
from verification import queries


def test_run_all(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    sink_csv_export(load_dirty(spark, "/root/testdata/sf0.001"), raw)
    facts = jobs.clean_job(spark, raw, str(tmp_path / "clean"))
    doubled = spark.read.csv(raw, header=True).count()
    assert facts["total_before"] == doubled > facts["total_after"] and facts["encoding_used"] == "UTF-8"
    manifest = jobs.run_all(spark, raw, out)
    tables = {r["table"]: r for r in manifest.collect()}
    assert set(tables) == {*THEME_TABLES, *jobs.ADVANCED_TABLES}
    for row in tables.values():
        assert spark.read.parquet(row["path"]).count() == row["rows"] > 0
    profile = tmp_path / "out" / "cluster_insights" / "cluster_profile"
    lines = [json.loads(x) for p in sorted(profile.glob("part-*")) for x in p.read_text().splitlines()]
    assert [r["cluster"] for r in lines] == [0, 1, 2]
    insights = f"{out}/advanced_insights"
    assert spark.read.json(f"{insights}/pareto_breakpoints").count() == 3
    levels = spark.read.json(f"{insights}/institution_risk_distribution")
    assert levels.agg({"count": "sum"}).first()[0] == tables["comp_institution_risk"]["rows"]
    similar = spark.read.json(f"{insights}/struct_city_similarity_top").selectExpr("size(top_similar) AS n")
    assert {r["n"] for r in similar.collect()} == {5}
    months = spark.read.json(f"{out}/trend_stats/available_months")
    assert months.agg({"row_cnt": "sum"}).first()[0] == spark.read.parquet(f"{out}/clean_data.parquet").count()


def test_warehouse_needs_segments(spark):
    with pytest.raises(ValueError, match="cluster"):
        jobs.build_warehouse(spark.createDataFrame([(1.0,)], "monthly_sales double"), "/nowhere")


def test_snapshots_are_cut_in_order(spark, tmp_path):
    cities = [(f"c{i:04}", k, float(i)) for i in range(60) for k in range(12)]
    df = spark.createDataFrame(cities, "city string, cluster int, monthly_sales double").withColumns(
        {c: F.lit(1.0) for c in ("rating", "actual_price", "list_price", "discount_rate", "review_count")}
    )
    from bazaar.operators.warehouse import THEME_ORDER, cluster_city_rank
    from bazaar.sinks import emit_table, sink_json_snapshot

    table, _ = emit_table(cluster_city_rank(df), "ranked", f"{tmp_path}/ranked.parquet")
    sink_json_snapshot(table, f"{tmp_path}/cut", 150, THEME_ORDER["cluster_city_rank"])
    shown = spark.read.json(f"{tmp_path}/cut").collect()
    wanted = [(k, r) for k in range(3) for r in range(1, 61)][:150]
    assert sorted((r["cluster"], r["rank_in_cluster"]) for r in shown) == wanted
    jobs.trend_job(df, f"{tmp_path}/trends")
    by_cluster = spark.read.json(f"{tmp_path}/trends/trend_stats/cluster_summary")
    assert dict(by_cluster.dtypes)["cluster"] == "bigint"
    lines = [r["cluster"] for p in sorted((tmp_path / "trends/trend_stats/cluster_summary").glob("part-*"))
             for r in map(json.loads, p.read_text().splitlines())]
    assert lines == list(range(12))


@pytest.mark.parametrize("name", ["advanced_report", "build_warehouse"])
def test_jobs_get_listings_that_are_joined_once(spark, monkeypatch, name):
    given, job = [], getattr(jobs, name)
    monkeypatch.setattr(jobs, name, lambda df, *rest: (given.append(df), job(df, *rest))[1])
    assert queries.build()[name](spark, "/root/testdata/sf0.001").count() > 0
    (listings,) = given
    assert "Join" not in listings._jdf.queryExecution().optimizedPlan().toString()
