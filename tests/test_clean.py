from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazaar.functions import quantiles
from bazaar.operators import clean
from bazaar.schema import RAW_COLUMNS, SALES_SCHEMA, UNKNOWN
from bazaar.sources.star import load_dirty, turns
from verification import queries


def test_numbers(spark):
    texts = ["5", " 7.5 ", "-1e3", ".5", "5d", "abc", "", None, "1,000", "0x10", "+2", "5."]
    df = spark.createDataFrame([(t,) for t in texts], "rating string")
    found = [r[0] for r in clean.coerce_numeric(df).collect()]
    assert found == [5.0, 7.5, -1000.0, 0.5, None, None, None, None, None, None, 2.0, 5.0]


def test_dates(spark):
    texts = ["2025-1-5", "2025/01/05", " 2025-01/05 ", "2025-02-30", "########", "", None,
             "2025-01-05 10:00", "25-1-5", "2024-2-29"]
    df = spark.createDataFrame([(t,) for t in texts], "collection_date string")
    out = clean.derive_stats_month(clean.parse_dates(df)).collect()
    day = date(2025, 1, 5)
    assert [r[0] for r in out] == [day, day, day, *[None] * 6, date(2024, 2, 29)]
    assert [r[1] for r in out] == ["2025-01"] * 3 + [UNKNOWN] * 6 + ["2024-02"]


def test_columns_by_position(spark):
    wide = spark.createDataFrame([tuple("abcd")], "`x.y` string, b string, c string, d string")
    assert clean.standardize_columns(wide, ["p", "q"]).first().asDict() == {"p": "a", "q": "b"}
    narrow = clean.standardize_columns(wide)
    assert narrow.columns == RAW_COLUMNS and narrow.first()["spec"] is None


def test_duplicates_take_missing_as_equal(spark):
    data = [("a", None), ("a", None), ("a", float("nan")), ("a", 1.0), ("b", None)]
    assert clean.drop_duplicate_rows(spark.createDataFrame(data, "k string, v double")).count() == 3


def test_median_of_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "rating double, list_price double")
    out = clean.fill_median(df).collect()
    assert [r["rating"] for r in out] == [1.0, 2.5, 4.0]
    assert [r["list_price"] for r in out] == [None] * 3


def test_outliers_match_pandas(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({
        "list_price": rng.lognormal(3, 1, 300), "rating": rng.normal(4, 1, 300),
        "udi_match": [1.0] * 300, "monthly_sales": rng.exponential(5, 300),
    })
    expected = frame
    for c in ("list_price", "monthly_sales", "rating", "udi_match"):
        q1, q3 = expected[c].quantile(0.25), expected[c].quantile(0.75)
        if q3 > q1:
            gap = 1.5 * (q3 - q1)
            expected = expected[(expected[c] >= q1 - gap) & (expected[c] <= q3 + gap)]
    out = clean.remove_outliers_iqr(spark.createDataFrame(frame)).toPandas()
    assert sorted(map(tuple, out.values)) == sorted(map(tuple, expected.values))
    assert 0 < len(out) < 300


def test_a_column_without_values_removes_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "rating double")
    assert clean.remove_outliers_iqr(df).count() == 2


def _listings(spark, groups, month="2025-09"):
    data = [(i, p, c, float(n), month) for n, (i, p, c) in enumerate(groups)]
    return spark.createDataFrame(
        data, "institution string, project_name string, city string, list_price double, stats_month string"
    )


@pytest.mark.parametrize("groups", [
    [("a", "p", "x")] * 3 + [("b", "p", "x")] * 6,
    [("b", "q", "x"), ("a", "z", "y"), ("a", "b", "y"), ("c", "c", "c")],
    [("a", "p", "x")] * 7,
    [(None, "p", "x"), ("a", "p", "x"), ("a", None, "x"), ("b", "p", "x"), ("b", "p", "x")],
])
def test_split_halves_by_key_order(spark, groups):
    df = _listings(spark, groups)
    out = clean.split_single_month(df).toPandas()
    keys = ["institution", "project_name", "city"]
    ordered = out.sort_values([*keys, "list_price"], na_position="last")
    half = len(groups) // 2
    assert list(ordered["stats_month"]) == ["2025-08"] * half + ["2025-09"] * (len(groups) - half)


def test_split_orders_the_values_of_one_key_at_a_time(spark, monkeypatch):
    seen, order = [], clean.ordered_prefix

    def watch(df, *args, **kwargs):
        seen.append((df.columns, df.count()))
        return order(df, *args, **kwargs)

    monkeypatch.setattr(clean, "ordered_prefix", watch)
    groups = [(i, p, c) for i in "ab" for p in "pqr" for c in "xy"] + [(None, "p", "x")]
    clean.split_single_month(_listings(spark, groups))
    assert seen[:3] == [(["institution", "_n"], 3), (["project_name", "_n"], 3), (["city", "_n"], 2)]


def test_split_leaves_other_tables_alone(spark):
    two = _listings(spark, [("a", "p", "x")] * 4).withColumn(
        "stats_month", F.when(F.col("list_price") > 1, "2025-09").otherwise("2025-07")
    )
    assert clean.split_single_month(two).exceptAll(two).isEmpty()
    unknown = _listings(spark, [("a", "p", "x")] * 2, UNKNOWN)
    assert clean.split_single_month(unknown).exceptAll(unknown).isEmpty()


def test_whole_sequence(spark):
    base = {c: "x" for c in RAW_COLUMNS} | {
        "list_price": "100", "actual_price": "90", "discount_rate": "0.9", "monthly_sales": "3",
        "review_count": "4", "rating": "4.5", "installment": "1", "udi_match": "1",
        "new_customer": "0", "listing_date": "2025-01-01", "collection_date": "2025/9/3",
    }
    changes = [{}, {}, {"rating": "bad", "district": None}, {"rating": "3.5", "collection_date": "########"}]
    data = [tuple({**base, **change}[c] for c in RAW_COLUMNS) for change in changes]
    out = clean.clean(spark.createDataFrame(data, ", ".join(f"{c} string" for c in RAW_COLUMNS)))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in SALES_SCHEMA]
    found = sorted((r["rating"], r["district"], r["stats_month"]) for r in out.collect())
    assert found == [(3.5, "x", UNKNOWN), (4.0, UNKNOWN, "2025-09"), (4.5, "x", "2025-09")]


def test_storage_check(spark):
    df = spark.createDataFrame([("a", 1.0)], "city string, monthly_sales double")
    row = clean.validate_storage(df, "hdfs://host/clean").first()
    assert row["mode"] == "hdfs" and row["rows"] == 1 and row["columns"] == 2
    assert row["missing_required_columns"] == "category" and not row["has_stats_month_col"]


def test_month_distribution(spark):
    months = [" 2025-08 ", "2025-08", "", "nan", "None", None, UNKNOWN]
    df = spark.createDataFrame([(m,) for m in months], "stats_month string")
    assert [tuple(r) for r in clean.month_distribution(df).collect()] == [("2025-08", 2), (UNKNOWN, 1)]


def test_features_must_be_there(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (float("nan"), 1.0)], "rating double, x double")
    assert clean.drop_null_features(df).count() == 1


@pytest.mark.parametrize("name", [
    "fill_median", "fill_median_all_columns", "remove_outliers_iqr", "remove_outliers_iqr_narrowed",
    "remove_outliers_simultaneous", "remove_outliers_all_columns",
])
def test_listings_are_joined_once_for_all_passes(spark, monkeypatch, name):
    passes = []
    counted = quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda df, cells: (passes.append(df), counted(df, cells))[1])
    found = queries.build()[name](spark, "/root/testdata/sf0.001")
    assert passes
    for df in [found, *passes]:
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_columns_found_together_or_in_turn_remove_the_same_rows(spark):
    rng = np.random.default_rng(5)
    names = ["list_price", "actual_price", "discount_rate", "monthly_sales", "review_count", "rating", "udi_match"]
    frame = pd.DataFrame({c: rng.uniform(size=200) if i % 3 else rng.lognormal(0, 2, 200) for i, c in enumerate(names)})
    expected = frame
    for c in names:
        q1, q3 = expected[c].quantile(0.25), expected[c].quantile(0.75)
        expected = expected[expected[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    out = clean.remove_outliers_iqr(spark.createDataFrame(frame), names).toPandas()
    assert sorted(map(tuple, out.values)) == sorted(map(tuple, expected.values))
    assert len(out) < 200


def test_frames_cleaned_in_turns_lose_duplicates_across_them(spark, rows):
    kinds = "a string, x double, d date"
    one = [("k", 0.0, None), (None, 1.0, None), ("k", float("nan"), None), ("m", None, None)]
    two = [("k", -0.0, None), (None, 1.0, None), ("k", None, None), ("n", 2.0, None)]
    frames = [spark.createDataFrame(r, kinds) for r in (one, two, one)]
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    found = clean.settle_unique(frames)
    assert rows(found) == rows(clean.drop_duplicate_rows(whole)) and found.count() == 5
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("unique_")]
    sf = "/root/testdata/sf0.001"
    parts = [load_dirty(spark, sf, turn=turn) for turn in turns(spark, sf, rows=2_500)]
    assert len(parts) == 3 and rows(clean.clean(parts)) == rows(clean.clean(load_dirty(spark, sf)))
