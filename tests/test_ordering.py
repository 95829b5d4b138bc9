import pytest
from pyspark.sql import functions as F

from bazaar.functions.ordering import ordered_prefix


def _frame(spark):
    # A third of all rows share one value, so it must span several slices.
    values = [7.0] * 100 + [float(i % 40) for i in range(150)] + [None] * 50
    data = [("ab"[i % 2] if i > 60 else "a", v, i) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "g string, v double, id int")


@pytest.mark.parametrize("slices", [1, 5, 40])
@pytest.mark.parametrize("within", [(), ("g",)])
def test_positions_sums_and_ranks(spark, slices, within):
    df = _frame(spark)
    out = ordered_prefix(
        df, [F.desc_nulls_last("v"), F.asc("id")], {"upto": "id"},
        within=within, rank_by="v", slices=slices,
    ).toPandas()
    expected = df.toPandas().sort_values(["v", "id"], ascending=[False, True], na_position="last")
    groups = expected.groupby("g") if within else expected.groupby(lambda _: 0)
    expected["position"] = groups.cumcount() + 1
    expected["upto"] = groups["id"].cumsum()
    expected["rank"] = groups["v"].rank(method="min", ascending=False, na_option="bottom")
    merged = out.merge(expected, on="id", suffixes=("", "_x"))
    assert len(merged) == 300
    for c in ("position", "upto", "rank"):
        assert (merged[c] == merged[f"{c}_x"]).all(), c
    sizes = groups["id"].agg(["sum", "count"]) if within else None
    for key, part in merged.groupby("g" if within else (lambda _: 0)):
        total = sizes.loc[key] if within else {"sum": expected["id"].sum(), "count": 300}
        assert set(part["upto_total"]) == {total["sum"]}
        assert set(part["rows_total"]) == {total["count"]}


@pytest.mark.parametrize("slices", [1, 7])
def test_one_value_only(spark, slices):
    df = spark.range(30).withColumn("v", F.lit(1.0))
    out = ordered_prefix(df, [F.asc("v"), F.asc("id")], rank_by="v", slices=slices)
    found = out.toPandas().sort_values("id")
    assert list(found["position"]) == list(range(1, 31)) and set(found["rank"]) == {1}


def test_empty_input(spark):
    df = spark.range(0).withColumn("v", F.lit(1.0))
    assert ordered_prefix(df, [F.asc("v"), F.asc("id")], {"s": "v"}).count() == 0


def test_plans_have_no_task_for_all_rows(spark, capsys):
    from bazaar.operators import stats, structure
    from bazaar.sources.star import load_sales

    sales = load_sales(spark, "/root/testdata/sf0.001", "project_name", "monthly_sales", "list_price", "rating")
    for df in (structure.pareto_projects(sales), stats.feature_ranks(sales, ["list_price", "rating"])):
        df.explain()
    assert "SinglePartition" not in capsys.readouterr().out


def test_ranks_keep_rows_with_missing_features(spark):
    from bazaar.operators.stats import feature_ranks

    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 1.0), (None, None)], "a double, b double")
    found = feature_ranks(df, ["a", "b"]).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1.0, None, 1.0, None), (None, 2.0, None, 2.0), (3.0, 1.0, 2.0, 1.0), (None,) * 4], key=str
    )
