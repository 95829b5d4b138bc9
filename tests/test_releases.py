"""A run that fails midway leaves the former tables readable."""

import pytest
from pyspark.sql import functions as F

from bazaar.operators.warehouse import THEME_TABLES
from bazaar.plans import jobs
from bazaar.sinks import releases
from bazaar.sources.star import LISTING_COLUMNS, load_segmented


def test_former_tables_outlive_a_failed_run(spark, tmp_path, rows, monkeypatch):
    out = str(tmp_path)
    df = load_segmented(spark, "/root/testdata/sf0.001", *LISTING_COLUMNS)
    assert releases.current(spark, out).isEmpty()
    with pytest.raises(ValueError, match="cluster_profile"):
        releases.read_current(spark, out, "cluster_profile")

    first = releases.publish(spark, out, lambda folder: jobs.build_warehouse(df, folder))
    assert {r["table"] for r in first.collect()} == set(THEME_TABLES)
    before = {name: rows(releases.read_current(spark, out, name)) for name in THEME_TABLES}

    def broken(df, roles):
        return df.select(F.raise_error(F.lit("midway")).alias("x"))

    with monkeypatch.context() as patch:
        name = list(THEME_TABLES)[4]
        patch.setitem(THEME_TABLES, name, (broken, None))
        with pytest.raises(Exception, match="midway"):
            releases.publish(spark, out, lambda folder: jobs.build_warehouse(df.limit(50), folder))
    assert len(list((tmp_path / "releases").iterdir())) == 2
    assert {name: rows(releases.read_current(spark, out, name)) for name in THEME_TABLES} == before

    few = df.where("cluster = 2")
    releases.publish(spark, out, lambda folder: jobs.build_warehouse(few, folder))
    assert releases.read_current(spark, out, "cluster_profile").count() == 1
    assert {r["version"] for r in releases.current(spark, out).collect()} == {2}
    former = releases.current(spark, out, version=1).where("table = 'cluster_profile'").first()["path"]
    assert rows(spark.read.parquet(former)) == before["cluster_profile"]
