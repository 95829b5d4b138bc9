import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from bazaar.functions import quantiles
from bazaar.functions.quantiles import exact_quantiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 1.0]


def _check(spark, values, slots):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = exact_quantiles(df, {"x": PROBABILITIES}, slots=slots)["x"]
    present = [v for v in values if v is not None and not np.isnan(v)]
    if not present:
        assert found == [None] * len(PROBABILITIES)
    else:
        assert found == pytest.approx(np.quantile(present, PROBABILITIES), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("slots", [2, 5, 1 << 16])
def test_same_numbers_however_many_slots(spark, slots):
    rng = np.random.default_rng(0)
    _check(spark, [float(v) for v in rng.lognormal(3, 2, 400)] + [None, float("nan")], slots)


@pytest.mark.parametrize("slots", [2, 3])
def test_frequent_values(spark, slots):
    _check(spark, [5.0] * 100 + [6.0] * 90 + [float(i) for i in range(40)], slots)


@pytest.mark.parametrize("slots", [2, 100])
def test_no_values_and_one_value(spark, slots):
    _check(spark, [None, None], slots)
    _check(spark, [3.0], slots)


def test_extreme_values(spark):
    tiny, huge = 5e-324, 1.7e308
    values = [-huge, -1.0, -tiny, 0.0, -0.0, tiny, 2 * tiny, 1.0, 1.0 + 2**-52, huge, 3.0]
    _check(spark, values, 1 << 16)
    df = spark.createDataFrame([(v,) for v in [float("-inf"), 1.0, 2.0, 3.0, float("inf")]], "x double")
    assert exact_quantiles(df, {"x": [0.0, 0.5, 1.0]})["x"] == [float("-inf"), 2.0, float("inf")]


def test_four_passes_at_most(spark, monkeypatch):
    rng = np.random.default_rng(1)
    near = [1.0 + float(k) * 2**-52 for k in rng.integers(0, 1 << 30, 3_000)]
    passes = []
    monkeypatch.setattr(quantiles, "_next_pass", lambda *a, f=quantiles._next_pass: (passes.append(1), f(*a)))
    _check(spark, near + [float(v) for v in rng.normal(size=3_000)], 1 << 16)
    assert len(passes) <= 3


def test_whole_numbers_and_several_columns(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-50, 50, 700), rng.integers(2**40, 2**41, 700)
    df = spark.createDataFrame([(int(x), int(y), None if x > 40 else float(y)) for x, y in zip(a, b)], "a int, b long, c double")
    found = quantiles.summaries(df, {c: PROBABILITIES for c in "abc"})
    for c, values in (("a", a), ("b", b), ("c", b[a <= 40])):
        assert found[c].quantiles == pytest.approx(np.quantile(values.astype(float), PROBABILITIES), rel=1e-12)
        assert (found[c].rows, found[c].missing) == (len(values), 700 - len(values))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_any_list(spark, values):
    _check(spark, values, 4)
