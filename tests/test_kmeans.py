"""The coreset, the shared scans, and whole fits against MLlib."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from bazaar.operators import kmeans, segment
from bazaar.session import run_folder


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(3)
    x = np.vstack([draw.normal(m, s, (n, 3)) for m, s, n in [(0, 1, 9_000), (6, 0.5, 5_000), (-7, 2, 3_000), (30, 0.2, 60)]])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    w = draw.integers(1, 4, len(x)).astype(float)
    w[0] = 4_000.0
    x -= np.average(x, axis=0, weights=w)
    rows = [(*map(float, p), float(v)) for p, v in zip(x, w)]
    return spark.createDataFrame(rows, "z0 double, z1 double, z2 double, weight double").repartition(7), x, w


def cost(x, w, centers):
    return float(w @ ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).min(axis=1))


def test_coreset_costs_what_all_points_cost(points):
    df, x, w = points
    sample, weight = kmeans.coreset(df, 2_000)
    assert len(sample) == 2_000 and weight.sum() == pytest.approx(w.sum(), rel=0.05)
    draw = np.random.default_rng(4)
    for k in (1, 2, 4, 8):
        centers = x[draw.choice(len(x), k)]
        assert cost(sample, weight, centers) == pytest.approx(cost(x, w, centers), rel=0.08)


def test_coreset_does_not_depend_on_partitions(points):
    df, _, _ = points
    a, b = kmeans.coreset(df, 500), kmeans.coreset(df.repartition(2, "z1"), 500)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    everything, weight = kmeans.coreset(df, 20_000)
    assert len(everything) == df.count() and weight.max() == 4_000.0


def test_step_counts_all_models_at_once(points):
    df, x, w = points
    models = [x[:2], x[5:10], x[:1]]
    for centers, (weight, mean, total) in zip(models, kmeans.step(df, models), strict=True):
        near = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert weight == pytest.approx(np.bincount(near, w, len(centers)))
        assert total == pytest.approx(cost(x, w, centers))
        for c in range(len(centers)):
            assert mean[c] == pytest.approx(np.average(x[near == c], axis=0, weights=w[near == c]), abs=1e-8)


def test_fits_cost_no_more_than_full_ones(points):
    df, x, w = points
    ks = [2, 3, 4, 6]
    found = kmeans.fit(df, ks, seed=42)
    vectors = VectorAssembler(inputCols=["z0", "z1", "z2"], outputCol="features").transform(df)
    for k in ks:
        full = KMeans(k=k, seed=42, weightCol="weight", maxIter=60).fit(vectors)
        assert found[k][1] == pytest.approx(cost(x, w, found[k][0]))
        assert found[k][1] <= 1.01 * full.summary.trainingCost
    assert all(found[a][1] >= found[b][1] for a, b in zip(ks, ks[1:]))


def test_fits_repeat_for_any_partitions(points):
    df, _, _ = points
    a, b = kmeans.fit(df, [4], 1)[4], kmeans.fit(df.repartition(3, "z2"), [4], 1)[4]
    assert (a[0] == b[0]).all() and a[1] == pytest.approx(b[1])


def test_fewer_points_than_clusters(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2)) for i in range(10)], "list_price double, rating double")
    model = segment.fit_segments(df, k=5, features=("list_price", "rating"))
    assert model.k == 2
    assert segment.assign_segments(df, model).groupBy("cluster").count().where(F.col("count") == 5).count() == 2
    with pytest.raises(ValueError, match="no row"):
        segment.fit_segments(df.where("rating > 5"), features=("list_price", "rating"))


def test_elbow_never_rises(spark, points):
    _, x, _ = points
    df = spark.createDataFrame([tuple(map(float, p)) for p in x[::5]], "list_price double, rating double, monthly_sales double")
    costs = [r["wcss"] for r in segment.elbow_sweep(df, features=df.columns).collect()]
    assert len(costs) == 7 and costs == sorted(costs, reverse=True)


def test_steps_read_packed_points(points):
    df, x, w = points
    blocks = kmeans.packed(df)
    held = [np.frombuffer(r["block"]).reshape(4, -1) for r in blocks.collect()]
    assert len(held) <= 14 and sum(b.shape[1] for b in held) == len(x)
    together = np.hstack(held)
    assert sorted(map(tuple, together.T.tolist())) == sorted((*p, v) for p, v in zip(x.tolist(), w.tolist()))
    centers = np.array([[0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [1.0, 1.0, 1.0]])
    nearest, gap = kmeans._nearest(x.T, centers)
    full = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert gap == pytest.approx(full.min(axis=1), abs=1e-9) and set(nearest) == {0, 1}


def test_stored_points_are_read_in_small_groups(spark):
    columns = [F.rand(i).alias(f"z{i}") for i in range(5)]
    df = spark.range(0, 900_000, 1, 1).select(*columns, F.lit(1.0).alias("weight"))
    with run_folder(spark) as folder:
        kmeans.fit(df, [2], seed=1)
        files = [f for f in map(pq.ParquetFile, Path(folder).rglob("*.parquet")) if f.schema.names == ["block"]]
        groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    sizes = [g.total_byte_size / g.num_rows for g in groups]
    assert sum(g.num_rows for g in groups) >= 900_000 / 4_096 and max(sizes) < 300_000
    assert max(g.total_byte_size for g in groups) < 24 << 20
