import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaar.operators import segment, trend, views, warehouse
from bazaar.schema import FEATURE_COLUMNS, UNKNOWN, Roles

LISTING = ("cluster int, city string, category string, channel string, stats_month string, "
           "discount_rate double, monthly_sales double, list_price double, actual_price double, "
           "review_count double, rating double, project_name string, doctor_name string, doctor_title string")


def _row(cluster=0, city="x", category="k", channel="w", month="2025-01", paid=0.5, sales=1.0, price=10.0,
         project="p", title="t"):
    return (cluster, city, category, channel, month, paid, sales, price, price, 1.0, 4.0, project, "d", title)


@pytest.fixture
def listings(spark):
    return lambda *rows: spark.createDataFrame(list(rows), LISTING)


def test_labels(listings):
    rows = [_row(0, price=100.0, sales=5.0), _row(1, price=50.0, sales=9.0), _row(2, price=10.0, sales=1.0),
            _row(3, price=20.0, sales=2.0, paid=0.8), _row(None, price=999.0)]
    found = {r["cluster"]: r for r in warehouse.cluster_profile(listings(*rows)).collect()}
    assert [found[c]["cluster_label"] for c in range(4)] == ["高端精品型", "大众爆款型", "长尾引流型", "中端主力型"]
    assert found[0]["discount_level"] == "深折促销" and found[3]["discount_level"] == "中度折扣"


def test_one_segment_is_premium(listings):
    (row,) = warehouse.cluster_profile(listings(_row(), _row(paid=1.0))).collect()
    assert row["cluster_label"] == "高端精品型" and row["discount_level"] == "中度折扣"


def test_lift_totals_include_rows_without_keys(listings):
    df = listings(_row(0, category="a", sales=4.0), _row(0, category=None, sales=4.0),
                  _row(None, category="a", sales=8.0), _row(1, category="b", sales=0.0))
    found = {(r["cluster"], r["category"]): r for r in warehouse.cluster_category_preference(df).collect()}
    assert set(found) == {(0, "a"), (1, "b")}
    assert found[0, "a"]["cluster_share"] == 0.5 and found[0, "a"]["global_share"] == 0.75
    assert found[0, "a"]["preference_lift"] == pytest.approx(0.5 / 0.75)
    assert found[1, "b"]["cluster_share"] is None and found[1, "b"]["preference_lift"] is None


def test_month_delta_uses_the_month_listed_before(listings):
    df = listings(_row(month="2025-01", sales=0.0), _row(month="2025-03", sales=4.0), _row(month="2025-04", sales=6.0),
                  _row(month=UNKNOWN), _row(month=None))
    found = [(r["stats_month"], r["prev_sales"], r["sales_delta"], r["sales_growth_rate"])
             for r in warehouse.cluster_month_delta(df).collect()]
    assert found == [("2025-01", None, 0.0, None), ("2025-03", 0.0, 4.0, None), ("2025-04", 4.0, 2.0, 0.5)]


def test_bands(listings):
    cuts = [0.59, 0.6, 0.75, 0.9, 1.2, None]
    found = {r["discount_band"]: r["project_count"]
             for r in warehouse.cluster_price_band(listings(*[_row(paid=p) for p in cuts])).collect()}
    assert found == {"深折(<0.6)": 1, "中折(0.6-0.75)": 1, "浅折(0.75-0.9)": 1, "原价(>=0.9)": 2, UNKNOWN: 1}
    cuts = [0.69, 0.7, 0.85, 1.0, 1.1, None]
    found = {r["discount_band"]: r["project_count"]
             for r in trend.trend_section(listings(*[_row(paid=p) for p in cuts]), "discount_band_stats").collect()}
    assert found == {"低折扣(<0.7)": 1, "中折扣(0.7-0.85)": 1, "高折扣(>=0.85)": 2, "其它": 1, UNKNOWN: 1}


def test_trend_keeps_the_missing_key(listings):
    df = listings(_row(city=None, sales=5.0), _row(city="x", sales=2.0))
    assert [r["city"] for r in trend.trend_section(df, "by_city").collect()] == [None, "x"]


def test_report_equals_its_sections(listings):
    rng = np.random.default_rng(5)
    rows = [_row(int(rng.integers(3)), ["x", "y", None][rng.integers(3)], "ab"[rng.integers(2)], "w",
                 sales=float(rng.integers(9)), paid=float(rng.choice([0.6, 0.8, 1.0]))) for _ in range(80)]
    df = listings(*rows)
    report = trend.trend_report(df)
    assert set(trend.available_sections(df)) == {r["section"] for r in report.select("section").distinct().collect()}
    for name in trend.available_sections(df):
        section = trend.SECTIONS[name]
        part = report.where(F.col("section") == name).select(
            *[F.col(f"key_{i + 1}").alias(k) for i, k in enumerate(section.keys)],
            *[F.col(m if m in report.columns else "row_cnt").alias(m) for m in section.measures])
        whole = trend.trend_section(df, name)
        whole = whole.withColumns({k: F.col(k).cast("string") for k in section.keys})
        assert sorted(map(str, map(tuple, part.collect()))) == sorted(map(str, map(tuple, whole.collect())))


def test_roles_rename_columns(spark):
    roles = Roles(city="town", monthly_sales="sold", rating="stars", actual_price="paid", discount_rate=None)
    df = spark.createDataFrame([("x", 2.0, 4.0, 9.0)], "town string, sold double, stars double, paid double")
    with pytest.raises(ValueError):
        trend.trend_section(df, "by_city", roles)
    assert "by_city" not in trend.available_sections(df, roles)
    from bazaar.operators import stats
    row = stats.rating_sales_corr(df, "city", roles=roles).first()
    assert row["city"] == "x" and row["corr_rating_sales"] is None


def test_spread_counts_absent_segments_as_zero(listings):
    df = listings(_row(0, "x", sales=9.0), _row(1, "y", sales=7.0), _row(0, "y", sales=5.0), _row(1, "z", sales=3.0))
    out = views.city_spread_top10(warehouse.cluster_city_rank(df), n=2).collect()
    assert [(r["city"], r["spread"], r["cluster"], r["cluster_sales"]) for r in out] == [
        ("x", 9.0, 0, 9.0), ("x", 9.0, 1, 0.0), ("z", 3.0, 0, 0.0), ("z", 3.0, 1, 3.0)]


def test_month_filter(listings):
    df = listings(_row(month="2025-01"), _row(month="2025-02"), _row(month=UNKNOWN))
    assert views.filter_month(df, "2025-01").count() == 1
    for everything in (None, "", " ALL ", "全部"):
        assert views.filter_month(df, everything).count() == 3
    assert [r["stats_month"] for r in views.month_options(df).collect()] == ["2025-01", "2025-02"]


def test_wide_pivots(listings):
    cells = warehouse.cluster_channel_efficiency(listings(_row(0, channel="w"), _row(1, channel="v")))
    wide = views.to_wide(views.channel_pivot(cells), "cluster", "channel", "weighted_sales").collect()
    assert [tuple(r) for r in wide] == [(0, 0.0, 4.0), (1, 4.0, 0.0)]


def _blobs(spark, n=300):
    rng = np.random.default_rng(6)
    middle = np.repeat([[0.0] * 6, [50.0] * 6, [100.0] * 6], n // 3, axis=0)
    points = (middle + rng.normal(size=(n, 6))).round(3)
    return spark.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{f} double" for f in FEATURE_COLUMNS))


def test_kmeans_finds_blobs_and_repeats(spark):
    df = _blobs(spark)
    model = segment.fit_segments(df)
    again = segment.fit_segments(df.repartition(3))
    assert np.allclose(model.centers, again.centers)
    out = segment.assign_segments(df, model).toPandas()
    assert sorted(out["cluster"].value_counts()) == [100, 100, 100]
    assert out.groupby("cluster")["list_price"].mean().is_monotonic_increasing
    table = segment.centers_table(segment.cluster_centers(spark, model)).collect()
    assert [tuple(r)[1:] for r in table] == [tuple(c) for c in model.centers]


def test_elbow_falls(spark):
    costs = [r["wcss"] for r in segment.elbow_sweep(_blobs(spark), ks=(2, 3)).collect()]
    assert costs[0] > 10 * costs[1]


def test_constant_and_missing_features(spark):
    df = _blobs(spark, 60).withColumn("rating", F.lit(3.0))
    df = df.unionByName(df.limit(1).withColumn("rating", F.lit(None).cast("double")))
    z = segment.standardize_features(df).toPandas()
    assert len(z) == 60 and set(z["rating"]) == {0.0}
    assert np.allclose(z["list_price"].std(), 1) and np.allclose(z["list_price"].mean(), 0)
    assert segment.kmeans_cluster(df).count() == 60
    assert segment.assemble_features(df).count() == 60
