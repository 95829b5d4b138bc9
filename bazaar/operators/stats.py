"""Correlation matrices, price elasticity, correlation within groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.numeric import all_present, pearson
from bazaar.schema import DEFAULT_ROLES, FEATURE_COLUMNS, Roles
from bazaar.session import settle


def _quoted(name: str) -> str:
    return f"`{name}`"


def pearson_matrix(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Pearson correlation of every pair, each over the rows that have both.

    Null where a column is constant over those rows.  One scan: the pairs of a
    row are unfolded and grouped by pair, so each has its own few moments.
    """
    present = [f for f in features if f in df.columns]
    pairs = list(combinations(present, 2))
    cells = ", ".join(f"{i}, {_quoted(a)}, {_quoted(b)}" for i, (a, b) in enumerate(pairs))
    unfolded = df.selectExpr(f"stack({len(pairs)}, {cells}) AS (pair, x, y)")
    corr = unfolded.groupBy("pair").agg(pearson("x", "y").alias("corr"))
    named = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]
    both = F.array(
        F.struct(F.col("p.a").alias("feature_a"), F.col("p.b").alias("feature_b"), "corr"),
        F.struct(F.col("p.b").alias("feature_a"), F.col("p.a").alias("feature_b"), "corr"),
    )
    off_diagonal = corr.withColumn("p", F.array(*named)[F.col("pair")]).select(F.inline(both))
    itself = F.array(*[F.struct(F.lit(f), F.lit(f), F.lit(1.0)) for f in present])
    one_row = df.sparkSession.range(1).select(F.inline(itself)).toDF("feature_a", "feature_b", "corr")
    return one_row.unionByName(off_diagonal)


# Distinct values of a feature up to which its ranks are looked up in every task: 16 MB.
LOOKUP_VALUES = 1_000_000


def _check_ties(ties: str) -> None:
    if ties not in ("min", "average"):
        raise ValueError("ties must be 'min' or 'average'")


def _value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, n) of every distinct value; features by their place in ``features``."""
    cells = ", ".join(f"{i}, CAST({_quoted(f)} AS DOUBLE)" for i, f in enumerate(features))
    values = df.selectExpr(f"stack({len(features)}, {cells}) AS (feature, value)").where(F.col("value").isNotNull())
    return values.groupBy("feature", "value").agg(F.sum(F.lit(1.0)).alias("n"))


def _upto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a slice, in the order of values, with the running sums of each of its features."""
    slice_, totals = TaskContext.get().partitionId(), {}
    for batch in batches:
        feature, n = batch.column("feature").to_numpy(), batch.column("n").to_numpy()
        upto = np.empty(len(batch))
        for f in np.unique(feature).tolist():
            of = feature == f
            sums = np.cumsum(n[of]) + totals.get(f, 0.0)
            upto[of], totals[f] = sums, sums[-1]
        columns = [pa.array(upto), pa.array(np.full(len(batch), slice_, dtype=np.int32))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "upto", "slice"])


def _value_ranks(counts: DataFrame, ties: str, slices: int | None) -> DataFrame:
    """(feature, value, n, rank) of every distinct value; a null has no rank.

    Equal values are collapsed to counts before anything is ordered, so a
    value held by a large part of all rows costs no more than a rare one.  Each
    slice of the order adds its counts up; the totals of those before it, a row
    for each slice and feature, are added when the ranks are read.
    """
    _check_ties(ties)
    slices = slices or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.select("feature", "value", "n").repartitionByRange(slices, "feature", "value")
    # A slice lies in one feature or a few: to sort by the value alone is enough, and faster.
    stored, _ = settle(ordered.sortWithinPartitions("value").mapInArrow(
        _upto, "feature int, value double, n double, upto double, slice int"
    ))
    earlier = Window.partitionBy("feature").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("feature", "slice").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0.0)).alias("before")
    offsets, _ = settle(totals.select("feature", "slice", before))
    first = F.col("before") + F.col("upto") - F.col("n") + 1
    rank = first if ties == "min" else first + (F.col("n") - 1) / 2
    return stored.join(offsets, ["feature", "slice"]).select("feature", "value", "n", rank.alias("rank"))


def feature_ranks(
    df: DataFrame, features: Sequence[str], ties: str = "min", slices: int | None = None
) -> DataFrame:
    """The rank of every row's value in each feature, as ``rank_<feature>``.

    A null feature has a null rank; no row is lost.  The ranks are joined by
    value: Spark broadcasts those of a feature with few values, and splits the
    reads of a frequent value otherwise.
    """
    ranks = _value_ranks(_value_counts(df, features), ties, slices)
    return _with_ranks(df, dict(enumerate(features)), ranks)


def _with_ranks(df: DataFrame, features: dict[int, str], ranks: DataFrame) -> DataFrame:
    """``df`` with ranks of ``features``, named by their number in ``ranks``."""
    out = df
    for i, f in features.items():
        of_feature = ranks.where(F.col("feature") == i).select(
            F.col("value").alias(f), F.col("rank").alias(f"rank_{f}")
        )
        out = out.join(of_feature, f, "left")
    return out.select(*df.columns, *[f"rank_{f}" for f in features.values()])


def spearman_matrix(
    df: DataFrame,
    features: Sequence[str] = FEATURE_COLUMNS,
    ties: str = "min",
    slices: int | None = None,
) -> DataFrame:
    """Pearson correlation of ranks over rows that have all features.

    ``ties='min'`` gives equal values their lowest rank, ``'average'`` the
    mean of their ranks.

    Ranks come from counts of distinct values, and so do their means and spreads.
    The products are summed in one scan that looks ranks up by binary search; a
    feature with more than ``LOOKUP_VALUES`` values has its ranks worked out in
    ``slices`` of its order and joined to the rows before.
    """
    _check_ties(ties)
    present = [f for f in features if f in df.columns]
    complete, rows = settle(df.select(*[F.col(f).cast("double").alias(f) for f in present]).where(all_present(present)))
    counts, _ = settle(_value_counts(complete, present), "feature")
    sizes = dict(counts.groupBy("feature").count().collect())
    small = [i for i in range(len(present)) if slices is None and sizes.get(i, 0) <= LOOKUP_VALUES]
    tables = {present[i]: _Ranks.of(counts.where(F.col("feature") == i), ties) for i in small}
    large = {i: f for i, f in enumerate(present) if i not in small}
    moments = {f: (t.mean, t.spread) for f, t in tables.items()}
    if large:
        ranks = _value_ranks(counts.where(F.col("feature").isin(list(large))), ties, slices)
        complete = _with_ranks(complete, large, ranks)
        moments |= {large[i]: found for i, found in _rank_moments(ranks).items()}
    sums = _rank_products(complete, present, tables, {f: moments[f][0] for f in large.values() if f in moments})
    cells = [(f, f, 1.0) for f in present]
    for a, b in combinations(present, 2):
        spread = moments[a][1] * moments[b][1] if rows else 0.0
        corr = sums[a, b] / rows / spread if spread else None
        cells += [(a, b, corr), (b, a, corr)]
    return df.sparkSession.createDataFrame(cells, "feature_a string, feature_b string, corr double")


def _rank_moments(ranks: DataFrame) -> dict[int, tuple[float, float]]:
    """Mean and spread of the ranks of each feature, in two readings: no table is dealt by its few features."""
    n, r = F.col("n"), F.col("rank")
    means = dict(ranks.groupBy("feature").agg(F.sum(n * r) / F.sum(n)).collect())
    if not means:
        return {}
    mean = F.create_map(*[F.lit(x) for pair in means.items() for x in pair])[F.col("feature")]
    spreads = ranks.groupBy("feature").agg(F.sqrt(F.sum(n * (r - mean) ** 2) / F.sum(n)))
    return {i: (means[i], spread) for i, spread in spreads.collect()}


@dataclass(frozen=True)
class _Ranks:
    """Values of a feature in order, their ranks less the mean, and the moments of the ranks."""

    values: np.ndarray
    centered: np.ndarray
    mean: float
    spread: float

    @classmethod
    def of(cls, counts: DataFrame, ties: str) -> _Ranks:
        table = counts.select("value", "n").toArrow()
        values, n = table.column("value").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(values)
        values, n = values[order], n[order]
        rank = np.cumsum(n) - n + (1 if ties == "min" else (n + 1) / 2)
        mean = float(np.average(rank, weights=n)) if len(n) else 0.0
        centered = rank - mean
        spread = float(np.sqrt(np.average(centered**2, weights=n))) if len(n) else 0.0
        return cls(values, centered, mean, spread)


def _rank_products(
    rows: DataFrame, features: Sequence[str], tables: dict[str, _Ranks], means: dict[str, float]
) -> dict[tuple[str, str], float]:
    """Sums of products of centred ranks, for every pair of features."""
    pairs = list(combinations(features, 2))
    if not pairs:
        return {}
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    columns = [f if f in tables else f"rank_{f}" for f in features]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(features), len(features)))
        for batch in batches:
            ranks = np.empty((len(batch), len(features)))
            for i, (f, c) in enumerate(zip(features, columns, strict=True)):
                x, table = batch.column(c).to_numpy(), shared.value.get(f)
                ranks[:, i] = table.centered[np.searchsorted(table.values, x)] if table else x - means[f]
            total += ranks.T @ ranks
        cells = [total[features.index(a), features.index(b)] for a, b in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32()), pa.array(cells)], names=["pair", "s"])

    features = list(features)
    found = rows.select(*[_quoted(c) for c in columns]).mapInArrow(add, "pair int, s double")
    sums = dict(found.groupBy("pair").agg(F.sum("s")).collect())
    return {pair: sums.get(i, 0.0) for i, pair in enumerate(pairs)}


def price_elasticity(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Per category, the fit of log sales on log price."""
    category, actual, sales = roles.of("category", "actual_price", "monthly_sales")
    x, y = F.ln(F.col(actual)), F.ln(F.col(sales))
    usable = df.where(F.col(category).isNotNull() & (F.col(actual) > 0) & (F.col(sales) > 0))
    return (
        usable.groupBy(F.col(category).alias("category"))
        .agg(
            F.regr_slope(y, x).alias("elasticity"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy(F.asc_nulls_last("elasticity"), "category")
    )


def rating_sales_corr(
    df: DataFrame, by: str, min_rows: int = 0, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """Correlation of rating and sales within each group of at least ``min_rows``."""
    key, rating, sales = roles.of(by, "rating", "monthly_sales")
    groups = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(by)).agg(
        pearson(rating, sales).alias("corr_rating_sales"),
        F.count(F.lit(1)).alias("n"),
        F.avg(rating).alias("avg_rating"),
        F.avg(sales).alias("avg_sales"),
    )
    return groups.where(F.col("n") >= min_rows).orderBy(
        F.desc_nulls_last("corr_rating_sales"), by
    )


def rating_sales_corr_by_city(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return rating_sales_corr(df, "city", min_rows=30, roles=roles)


def rating_sales_corr_by_category(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return rating_sales_corr(df, "category", roles=roles)
