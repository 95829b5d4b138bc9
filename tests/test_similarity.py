"""The closest cities by bounded pairs, against all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaar.operators import structure


def plain(vectors, n):
    """The n others of greatest cosine of each city, ties by name."""
    names = sorted(vectors)
    norm = {c: np.sqrt(sum(x * x for x in v.values())) for c, v in vectors.items()}
    out = {}
    for a in names:
        others = []
        for b in names:
            if a != b:
                dot = sum(x * vectors[b].get(k, 0.0) for k, x in vectors[a].items())
                others.append((-round(dot / (norm[a] * norm[b]), 9) if norm[a] * norm[b] else 0.0, b))
        out[a] = sorted(others)[:n]
    return out


def listings(spark, vectors):
    rows = [(a, k, float(x)) for a, v in vectors.items() for k, x in v.items()]
    return spark.createDataFrame(rows, "city string, category string, monthly_sales double")


def same(found, vectors, n):
    wanted = plain(vectors, n)
    got = {r["city"]: [(e["city"], round(e["similarity"], 9)) for e in r["top_similar"]] for r in found.collect()}
    assert set(got) == set(wanted)
    for city, others in wanted.items():
        assert [s for _, s in got[city]] == pytest.approx([-s for s, _ in others], abs=2e-9)
        # Names agree but for cities as near as rounding can tell.
        for (name, s), (t, other) in zip(got[city], others):
            assert name == other or any(abs(s + x) < 2e-9 and name == y for x, y in wanted[city]) or abs(s + t) < 2e-9


def clustered(seed, clusters, size, categories):
    draw, vectors = np.random.default_rng(seed), {}
    for c in range(clusters):
        base = {int(k): float(draw.lognormal(0, 1)) for k in draw.choice(categories, 12, replace=False)}
        for i in range(size):
            shown = {f"k{k}": x * draw.uniform(0.8, 1.2) for k, x in base.items()}
            shown[f"k{draw.integers(categories)}"] = float(draw.uniform(0, 0.5))
            vectors[f"c{c:03}-{i:02}"] = shown
    return vectors


def test_pairs_far_below_all(spark):
    vectors = clustered(1, 40, 10, 150)
    df = listings(spark, vectors)
    same(structure.city_similarity_top(df), vectors, 5)
    unit = structure._unit_cells(structure.city_category_sales(df))
    formed = structure.close_pairs(unit, 5).count()
    sharing = structure._shared(structure.city_category_sales(df)).count()
    assert formed < 0.25 * len(vectors) ** 2 and formed < 0.4 * sharing


@pytest.mark.parametrize("n", [1, 5, 30])
def test_awkward_vectors(spark, n):
    draw = np.random.default_rng(2)
    vectors = {f"s{i}": {f"k{k}": float(draw.integers(1, 4)) for k in draw.choice(8, 2, replace=False)} for i in range(20)}
    vectors |= {"alone": {"own": 3.0}, "zero": {"k1": 0.0}, "same1": {"k1": 2.0, "k2": 2.0}, "same2": {"k1": 5.0, "k2": 5.0}}
    same(structure.city_similarity_top(listings(spark, vectors), n=n), vectors, n)


def test_few_cities(spark):
    same(structure.city_similarity_top(listings(spark, {"a": {"k": 1.0}, "b": {"k": 2.0}})), {"a": {"k": 1.0}, "b": {"k": 2.0}}, 5)


def test_all_pairs_meet_in_blocks(spark):
    vectors = {f"c{i}": {f"k{i % 4}": 1.0, f"j{i}": 1.0} for i in range(15)}
    found = structure.city_similarity(listings(spark, vectors))
    assert "category, 0" not in found._jdf.queryExecution().toString()
    rows = {(r["city_a"], r["city_b"]): r["similarity"] for r in found.collect()}
    assert set(rows) == set(itertools.product(vectors, vectors))
    assert rows["c0", "c4"] == pytest.approx(0.5) and rows["c0", "c1"] == 0.0 and rows["c3", "c3"] == pytest.approx(1.0)
    assert found.where(F.col("similarity") < 0).isEmpty()
