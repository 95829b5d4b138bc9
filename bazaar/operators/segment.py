"""K-Means segmentation of listings by their numeric features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.operators import kmeans
from bazaar.operators.clean import cast_numeric, drop_null_features
from bazaar.schema import FEATURE_COLUMNS
from bazaar.session import settle

DEFAULT_K = 3
SEED = 42
_VECTOR = "features"


def _usable(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    present = [f for f in features if f in df.columns]
    return drop_null_features(cast_numeric(df, present), present), present


def assemble_features(
    df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, output: str = _VECTOR
) -> DataFrame:
    """Add the features as one vector; rows missing any of them are skipped."""
    rows, present = _usable(df, features)
    return VectorAssembler(inputCols=present, outputCol=output, handleInvalid="skip").transform(rows)


def _number(x: float) -> str:
    """A double as a SQL constant."""
    return f"({x!r}D)"


@dataclass(frozen=True)
class Scaling:
    """Mean and sample standard deviation of each feature."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def expressions(self) -> list[str]:
        """The z-score of each feature in SQL; a constant feature scores zero."""
        return [
            f"(`{f}` - {_number(m)}) / {_number(s)}" if s else "0D"
            for f, m, s in zip(self.features, self.mean, self.std)
        ]

    def restore(self, center: Sequence[float]) -> list[float]:
        """A standardised point in original units."""
        return [m + z * s for m, s, z in zip(self.mean, self.std, center)]


def fit_scaling(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> Scaling:
    """One pass over the rows that have all features."""
    rows, present = _usable(df, features)
    found = rows.agg(
        *[F.avg(f) for f in present], *[F.coalesce(F.stddev_samp(f), F.lit(0.0)) for f in present]
    ).first()
    n = len(present)
    return Scaling(tuple(present), tuple(found[:n]), tuple(found[n:]))


def standardize_features(
    df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, scaling: Scaling | None = None
) -> DataFrame:
    """Replace the features by their z-scores."""
    rows, _ = _usable(df, features)
    scaling = scaling or fit_scaling(df, features)
    return rows.withColumns({f: F.expr(e) for f, e in zip(scaling.features, scaling.expressions())})


def _features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features of usable rows, stored: fitting reads them several times."""
    rows, present = _usable(df, features)
    stored, _ = settle(rows.select(*present))
    return stored


def _training_points(rows: DataFrame, scaling: Scaling) -> DataFrame:
    """Distinct standardised points with their number of rows as weight, stored.

    Equal points are collapsed before the shuffle, so one point held by a large
    part of all rows is one row here.
    """
    names = [f"z{i}" for i in range(len(scaling.features))]
    points = rows.selectExpr([f"{e} AS {n}" for e, n in zip(scaling.expressions(), names)])
    stored, _ = settle(points.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias(kmeans.WEIGHT)))
    return stored


@dataclass(frozen=True)
class Segmentation:
    """A fitted model: centres in standardised units, in order of first feature."""

    scaling: Scaling
    centers: tuple[tuple[float, ...], ...]

    @property
    def k(self) -> int:
        return len(self.centers)


def fit_segments(
    df: DataFrame, k: int = DEFAULT_K, features: Sequence[str] = FEATURE_COLUMNS, seed: int = SEED
) -> Segmentation:
    """Fit K-Means on standardised features.

    Clusters are numbered by rising centre, first feature first, so that a
    number means the same from one fit to the next.
    """
    rows = _features(df, features)
    scaling = fit_scaling(rows, features)
    fitted, _ = kmeans.fit(_training_points(rows, scaling), [k], seed)[k]
    centers = sorted(tuple(float(x) for x in c) for c in fitted)
    return Segmentation(scaling, tuple(centers))


def assign_nearest_center(
    df: DataFrame,
    centers: Sequence[Sequence[float]],
    scaling: Scaling,
) -> DataFrame:
    """Add ``cluster``, the number of the nearest centre in standardised units.

    The few centres are constants of the expression: no join, no shuffle.  The
    lowest number wins a tie; a row that lacks a feature has no cluster.
    """

    def distance(center: Sequence[float]) -> str:
        gaps = [
            f"pow(`{f}` - {_number(x)}, 2) * {_number(1 / (s * s))}"
            for f, x, s in zip(scaling.features, scaling.restore(center), scaling.std)
            if s
        ]
        return " + ".join(gaps) or "0D"

    # Each distance stands once in the plan, however it is folded into later steps.
    pairs = ", ".join(f"struct({distance(c)} AS distance, {i} AS cluster)" for i, c in enumerate(centers))
    missing = " OR ".join(f"`{f}` IS NULL" for f, s in zip(scaling.features, scaling.std) if s) or "false"
    return df.withColumn("cluster", F.expr(f"CASE WHEN {missing} THEN NULL ELSE array_min(array({pairs})).cluster END"))


def assign_segments(df: DataFrame, model: Segmentation) -> DataFrame:
    """Add ``cluster`` from a fitted model; rows missing a feature are dropped."""
    rows, _ = _usable(df, model.scaling.features)
    return assign_nearest_center(rows, model.centers, model.scaling)


def kmeans_cluster(
    df: DataFrame, k: int = DEFAULT_K, features: Sequence[str] = FEATURE_COLUMNS, seed: int = SEED
) -> DataFrame:
    """Fit and assign in one go."""
    return assign_segments(df, fit_segments(df, k, features, seed))


def cluster_centers(spark: SparkSession, model: Segmentation) -> DataFrame:
    """Centres as long rows, in standardised and in original units."""
    rows = [
        (i, f, z, x)
        for i, center in enumerate(model.centers)
        for f, z, x in zip(model.scaling.features, center, model.scaling.restore(center))
    ]
    return spark.createDataFrame(
        rows, "cluster int, feature string, center double, center_original double"
    )


def centers_table(centers: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """One row per cluster, one column per feature."""
    return (
        centers.groupBy("cluster").pivot("feature", list(features)).agg(F.first("center"))
        .orderBy("cluster")
    )


def elbow_sweep(
    df: DataFrame,
    ks: Sequence[int] = tuple(range(2, 9)),
    features: Sequence[str] = FEATURE_COLUMNS,
    seed: int = SEED,
) -> DataFrame:
    """Within-cluster sum of squares for each number of clusters.

    All fits share their scans, and each starts from the one with a cluster less,
    so the sum falls with the number.
    """
    rows = _features(df, features)
    found = kmeans.fit(_training_points(rows, fit_scaling(rows, features)), list(ks), seed)
    costs = [(int(k), float(found[k][1])) for k in ks]
    return df.sparkSession.createDataFrame(costs, "k int, wcss double")
