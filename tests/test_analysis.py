import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazaar.operators import compliance, stats, structure


def _matrix(df):
    return {(r["feature_a"], r["feature_b"]): r["corr"] for r in df.collect()}


def test_pearson_pairs_and_constants(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"list_price": rng.normal(size=60), "rating": rng.normal(size=60), "discount_rate": 1.0})
    frame["actual_price"] = -frame["list_price"] * 2
    frame.loc[:9, "rating"] = None
    features = ["list_price", "actual_price", "discount_rate", "rating"]
    df = spark.createDataFrame(frame[features].astype(object).where(frame[features].notna(), None),
                               ", ".join(f"{f} double" for f in features))
    found, expected = _matrix(stats.pearson_matrix(df)), frame[features].corr()
    assert len(found) == 16
    for (a, b), value in found.items():
        assert value == found[b, a]
        if a == b:
            assert value == 1.0
        elif "discount_rate" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(expected.loc[a, b], abs=1e-12)


@pytest.mark.parametrize("ties", ["min", "average"])
@pytest.mark.parametrize("slices", [1, 9])
def test_spearman_ties(spark, ties, slices):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({
        "list_price": rng.integers(0, 5, 200).astype(float),
        "rating": np.where(rng.random(200) < 0.4, 1.0, rng.normal(size=200)),
        "monthly_sales": rng.normal(size=200),
    })
    found = _matrix(stats.spearman_matrix(spark.createDataFrame(frame), ties=ties, slices=slices))
    expected = frame.rank(method=ties).corr()
    for (a, b), value in found.items():
        assert value == pytest.approx(expected.loc[a, b], abs=1e-12)


@pytest.mark.parametrize("ties", ["min", "average"])
def test_ranks_of_values_come_without_a_window_over_them(spark, ties):
    df = spark.range(2_000).selectExpr(
        "CAST(id % 7 AS DOUBLE) AS a", "CAST(id * id % 1009 AS DOUBLE) AS b", "IF(id = 3, 1D, NULL) AS c"
    )
    ranks = stats._value_ranks(stats._value_counts(df, ["a", "b", "c"]), ties, 5)
    assert "Window" not in ranks._jdf.queryExecution().executedPlan().toString()
    found = {(r["feature"], r["value"]): r["rank"] for r in ranks.collect()}
    frame = df.toPandas()
    expected = frame.rank(method=ties)
    assert found == {
        (i, v): r for i, f in enumerate(frame) for v, r in zip(frame[f], expected[f], strict=True) if v == v
    }
    empty = df.where("a < 0")
    assert _matrix(stats.spearman_matrix(empty, ("a", "b"), ties, slices=3))["a", "b"] is None


def test_elasticity_recovers_a_power_law(spark):
    data = [("c", p, 50 * p ** -1.5) for p in (1.0, 2.0, 3.0, 8.0)] + [("c", 0.0, 5.0), (None, 1.0, 1.0)]
    row = stats.price_elasticity(
        spark.createDataFrame(data, "category string, actual_price double, monthly_sales double")
    ).collect()
    assert len(row) == 1 and row[0]["n"] == 4
    assert row[0]["elasticity"] == pytest.approx(-1.5) and row[0]["r2"] == pytest.approx(1.0)


def test_small_groups_are_left_out_by_city_only(spark):
    data = [("big", float(i % 7), float(i)) for i in range(30)] + [("small", 1.0, float(i)) for i in range(29)]
    df = spark.createDataFrame(data, "city string, rating double, monthly_sales double")
    assert [r["city"] for r in stats.rating_sales_corr_by_city(df).collect()] == ["big"]
    by = stats.rating_sales_corr_by_category(df.withColumnRenamed("city", "category")).collect()
    assert [(r["category"], r["corr_rating_sales"] is None) for r in by] == [("big", False), ("small", True)]


SHOPS = "city string, institution string, monthly_sales double"


def test_concentration(spark):
    data = [("one", "a", 10.0), ("even", "a", 5.0), ("even", "b", 5.0), ("zero", "a", 0.0),
            (None, "a", 3.0), ("one", None, 9.0)]
    found = {r["city"]: r for r in structure.hhi_by_city(spark.createDataFrame(data, SHOPS)).collect()}
    assert set(found) == {"one", "even", "zero"}
    assert found["one"]["hhi"] == 10000 and found["even"]["hhi"] == 5000
    assert found["zero"]["hhi"] is None and found["even"]["institution_count"] == 2


def test_concentration_of_many_in_one_city(spark):
    df = spark.range(5000).selectExpr("'hot' AS city", "concat('i', id) AS institution", "id + 1D AS monthly_sales")
    shares = np.arange(1, 5001) / np.arange(1, 5001).sum()
    row = structure.hhi_by_city(df).first()
    assert row["hhi"] == pytest.approx((shares ** 2).sum() * 1e4)
    assert row["cr10"] == pytest.approx(shares[-10:].sum())
    whole = structure.hhi_overall(df).first()
    assert whole["hhi"] == pytest.approx(row["hhi"]) and whole["cr5"] == pytest.approx(shares[-5:].sum())


def test_pareto(spark):
    df = spark.createDataFrame([(f"p{i:04}", float(i % 10)) for i in range(1100)],
                               "project_name string, monthly_sales double")
    curve = structure.pareto_projects(df).toPandas()
    assert list(curve["rn"]) == list(range(1, 1101))
    assert curve["cum_share"].is_monotonic_increasing and curve["cum_share"].iloc[-1] == pytest.approx(1)
    breaks = structure.pareto_breakpoints(df).collect()
    for b in breaks:
        first = curve[curve["cum_share"] >= b["cum_share_threshold"]].iloc[0]
        assert (b["rn"], b["project_share"]) == (first["rn"], first["project_share"])
    assert list(structure.pareto_sample(df).toPandas()["rn"]) == list(range(1, 1101, 2))


def test_similarity(spark):
    rng = np.random.default_rng(4)
    sales = rng.integers(0, 4, (11, 5)).astype(float)
    sales[3] = 0
    data = [(f"c{i:02}", f"k{j}", float(v)) for i, line in enumerate(sales) for j, v in enumerate(line) if v or i == 3]
    df = spark.createDataFrame(data, "city string, category string, monthly_sales double")
    norms = np.linalg.norm(sales, axis=1, keepdims=True)
    unit = sales / np.where(norms == 0, 1, norms)
    expected = unit @ unit.T
    pairs = {(r[0], r[1]): r[2] for r in structure.city_similarity(df).collect()}
    assert len(pairs) == 121
    for (a, b), value in pairs.items():
        assert value == pytest.approx(expected[int(a[1:]), int(b[1:])], abs=1e-12)
    for row in structure.city_similarity_top(df).collect():
        own = int(row["city"][1:])
        others = sorted((-round(expected[own, j], 12), f"c{j:02}") for j in range(11) if j != own)[:5]
        assert [round(e["similarity"], 12) for e in row["top_similar"]] == [-s for s, _ in others]


RISK = ("institution string, udi_match double, approval_no string, rating double, "
        "actual_price double, monthly_sales double")


def test_findings(spark):
    data = [("a", None, "国械1", 4.0, 10.0, 1.0), ("a", 0.0, None, None, 10.0, 1.0),
            ("a", 1.0, "", 3.9, None, 1.0), ("a", 1.0, "进口国械", 5.0, 10.0, None)]
    row = compliance.compliance_metrics(spark.createDataFrame(data, RISK)).first()
    assert row["udi_mismatch_rate"] == 0.5 and row["invalid_approval_rate"] == 0.75
    assert row["low_rating_rate"] == 0.25 and row["price_anomaly_rate"] == 0.0
    assert row["total_sales"] == 3.0 and row["project_count"] == 4


def test_anomalies_need_a_spread(spark):
    prices = [1.0] * 50 + [1000.0]
    df = spark.createDataFrame([("a", 1.0, "国械", 5.0, p, 1.0) for p in prices], RISK)
    assert compliance.compliance_metrics(df).first()["price_anomaly_rate"] == pytest.approx(1 / 51)
    none = df.withColumn("actual_price", F.lit(None).cast("double"))
    assert tuple(compliance.price_baseline(none).first()) == (0.0, 0.0)
    assert compliance.compliance_metrics(none).first()["price_anomaly_rate"] == 0.0


@pytest.mark.parametrize("slices", [1, 9])
def test_risk_ranking(spark, slices):
    # Institution i has i % 6 bad of five listings; many institutions tie.
    data = [(f"i{i:03}", float(j >= i % 6), "国械", 5.0, 1.0, 1.0) for i in range(60) for j in range(5)]
    data += [("few", 0.0, "", 1.0, 1.0, 1.0)] * 4
    out = compliance.institution_risk(spark.createDataFrame(data, RISK), slices=slices).toPandas()
    assert len(out) == 60
    expected = out["risk_score"].rank(method="min", ascending=False)
    assert (out["risk_rank"] == expected).all()
    assert set(out[out["risk_score"] == 40]["risk_level"]) == {"高风险"}
    assert set(out[out["risk_score"] == 16]["risk_level"]) == {"中风险"}
    df = spark.createDataFrame(data, RISK)
    assert compliance.institution_risk_bottom(df).count() == 10
    assert compliance.institution_risk_bottom(df.where("institution < 'i009'")).count() == 0
    levels = compliance.institution_risk_distribution(df).collect()
    assert sum(r["count"] for r in levels) == 60 == levels[0]["institution_count_total"]


def test_orphan_keys_count_nowhere(spark, tmp_path):
    from bazaar.operators import trend
    from bazaar.sources.star import load_sales

    source = "/root/testdata/sf0.001"
    for name in ("region", "nation", "customer", "supplier", "part", "lineitem", "orders"):
        table = spark.read.parquet(f"{source}/{name}.parquet")
        kept = table.where("o_orderkey % 10 <> 3") if name == "orders" else table
        kept.write.parquet(f"{tmp_path}/{name}.parquet")
    whole = load_sales(spark, str(tmp_path))
    summary = trend.trend_section(load_sales(spark, str(tmp_path), *whole.columns[:1], "monthly_sales", "rating",
                                             "actual_price", "list_price", "discount_rate", "review_count"), "summary")
    by_city = trend.trend_section(whole, "by_city")
    assert summary.first()["row_cnt"] == by_city.agg(F.sum("project_count")).first()[0] == whole.count() < 6000


def test_ranks_looked_up_and_joined_agree(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(rng.integers(0, 9, 400), rng.normal(size=400), rng.integers(-3, 3, 400))]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0), (0.0, -0.0, 0.0)], "a double, b double, c double")
    for ties in ("min", "average"):
        found = {}
        for limit in (0, 20, 10_000):  # none, some and all features are looked up
            monkeypatch.setattr(stats, "LOOKUP_VALUES", limit)
            found[limit] = _matrix(stats.spearman_matrix(df, features=("a", "b", "c"), ties=ties))
        for pair, corr in found[10_000].items():
            assert found[0][pair] == pytest.approx(corr) and found[20][pair] == pytest.approx(corr)


def test_leaders_are_picked_before_the_shuffle(spark):
    df = spark.range(5_000).select(
        F.when(F.col("id") >= 0, "one").alias("city"), F.concat(F.lit("i"), "id").alias("institution"), (F.col("id") + 1.0).alias("monthly_sales")
    )
    found = structure.hhi_by_city(df)
    (row,) = found.collect()
    assert row["cr10"] == pytest.approx(sum(range(4_991, 5_001)) / sum(range(1, 5_001))) and row["institution_count"] == 5_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_list" not in plan


def test_bottom_ranks_count_larger_scores(spark):
    rows = [(f"i{i:02}", 1.0 if i % 3 else 0.0, 4.5, 10.0, 1.0, "国械1") for i in range(30) for _ in range(5)]
    df = spark.createDataFrame(rows, "institution string, udi_match double, rating double, actual_price double, "
                                     "monthly_sales double, approval_no string")
    ranked = {r["institution"]: r["risk_rank"] for r in compliance.institution_risk(df).collect()}
    last = compliance.institution_risk_bottom(df, n=22)
    assert {r["institution"]: r["risk_rank"] for r in last.collect()} == {
        i: r for i, r in sorted(ranked.items(), key=lambda x: (x[1], x[0]))[-22:]}
    assert {r["risk_rank"] for r in last.collect()} == {1, 11}
    assert compliance.institution_risk_bottom(df, n=31).isEmpty()
