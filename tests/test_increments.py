"""Reports merged from months equal those worked out from all rows."""

import random

import pytest

from bazaar.operators import increments, trend, warehouse

LISTING = ("cluster int, city string, category string, channel string, stats_month string, "
           "discount_rate double, monthly_sales double, list_price double, actual_price double, "
           "review_count double, rating double, project_name string, doctor_name string, doctor_title string")


@pytest.fixture(scope="module")
def months(spark):
    draw = random.Random(5)

    def row(month):
        maybe = lambda x: None if draw.random() < 0.1 else x
        return (maybe(draw.randint(0, 2)), maybe(draw.choice("xyz")), maybe(draw.choice("ab")), draw.choice("wv"), month,
                maybe(draw.choice([0.6, 0.8, 1.0])), maybe(float(draw.randint(0, 9))), 5.0, maybe(float(draw.randint(1, 50))),
                1.0, maybe(draw.choice([3.5, 4.5])), f"p{draw.randint(0, 9)}", maybe(f"d{draw.randint(0, 60)}"),
                maybe(draw.choice(["t", "u"])))

    return {m: spark.createDataFrame([row(m) for _ in range(90)], LISTING) for m in ("2025-01", "2025-02", None, "", "2025-03")}


def same(found, wanted):
    def shown(df):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(sorted(wanted.columns)).collect())

    assert shown(found) == shown(wanted)


def together(frames):
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def test_adding_a_month_equals_the_full_report(spark, months, tmp_path):
    path, names = str(tmp_path / "trend"), trend.available_sections(months["2025-01"])
    first = together([months["2025-01"], months["2025-02"], months[None], months[""]])
    made = increments.trend_partials(first)
    increments.put_months(made, path)
    same(increments.trend_report_of(increments.stored_months(spark, path, made), names), trend.trend_report(first))
    before = {p.name: [q.name for q in p.iterdir()] for p in (tmp_path / "trend").glob("_month*")}
    for _ in range(2):  # a month put in twice counts once
        increments.put_months(increments.trend_partials(months["2025-03"]), path)
    after = {p.name: [q.name for q in p.iterdir()] for p in (tmp_path / "trend").glob("_month*")}
    assert set(after) - set(before) == {"_month=2025-03"} and all(after[m] == before[m] for m in before)
    merged = increments.trend_report_of(increments.stored_months(spark, path, made), names)
    same(merged, trend.trend_report(together([first, months["2025-03"]])))


def test_doctors_of_several_months_count_once(spark, months, tmp_path):
    names, path = str(tmp_path / "doctors"), str(tmp_path / "matching")
    first = together([months["2025-01"], months["2025-02"]])
    made = increments.doctor_partials(first, increments.known_doctors(first, names))
    increments.put_months(made, path)
    numbers = {r["doctor"]: r["id"] for r in spark.read.parquet(names).collect()}
    later = increments.known_doctors(months["2025-03"], names)
    increments.put_months(increments.doctor_partials(months["2025-03"], later), path)
    found = {r["doctor"]: r["id"] for r in later.collect()}
    assert numbers.items() <= found.items() and sorted(found.values()) == list(range(1, len(found) + 1))
    merged = increments.doctor_matching_of(increments.stored_months(spark, path, made))
    same(merged, warehouse.cluster_doctor_matching(together([first, months["2025-03"]])))
    parts = increments.stored_months(spark, path, made).where("bucket is not null").count()
    assert parts == 3 * 3 * 2  # one bitmap for each month, segment and title


def test_doctors_are_sets_of_bits_only(spark, tmp_path):
    rows = spark.createDataFrame(
        [("2025-01", 0, "T1", name, 1.0, 2.0, 3.0) for name in ["a", "a", "b", None]],
        "stats_month string, cluster int, doctor_title string, doctor_name string, monthly_sales double, "
        "rating double, actual_price double",
    )
    made = increments.doctor_partials(rows, increments.known_doctors(rows, str(tmp_path / "names")))
    assert increments.doctor_matching_of(made).first()["doctor_count"] == 2
    # One aggregate for the sums and one for the bitmaps; none of names.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
