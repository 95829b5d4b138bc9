"""Positions, ranks and running sums over one order of all rows.

A window without partition keys moves every row into one task.  Here rows are
range-partitioned by their order into slices, each slice is numbered on its
own, and the totals of the slices before it (one row per slice) are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from bazaar.session import settle

_SLICE = "_slice"


def ordered_prefix(
    df: DataFrame,
    order: Sequence[Column],
    running: Mapping[str, str] | None = None,
    within: Sequence[str] = (),
    rank_by: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Number the rows of ``df`` along ``order``.

    Adds ``position`` (from 1), for every ``name: column`` of ``running`` the
    running sum ``name`` and the whole sum ``name_total``, and ``rows_total``.
    All are counted separately per ``within`` group, and a large group is
    spread over several slices.  With ``rank_by``, the column ``order`` begins
    with, also ``rank``: one more than the number of rows whose value comes
    strictly earlier.

    ``order`` must be a total order; rows it cannot tell apart share a slice.
    There are ``slices``, by default as many as the session has shuffle
    partitions.
    """
    sums, groups = dict(running or {}), list(within)
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _by_slices(df, order, sums, groups, rank_by, slices)


def _numbers(
    over: WindowSpec, order: Sequence[Column], sums: Mapping[str, str], rank_by: str | None
) -> dict[str, Column]:
    ordered = over.orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbers = {"position": F.row_number().over(ordered).cast("long")}
    numbers |= {name: F.sum(c).over(so_far) for name, c in sums.items()}
    if rank_by:
        numbers["rank"] = F.rank().over(over.orderBy(order[0])).cast("long")
    return numbers


def _by_slices(
    df: DataFrame, order: Sequence[Column], sums: Mapping[str, str], groups: list[str],
    rank_by: str | None, slices: int,
) -> DataFrame:
    ranged = df.repartitionByRange(slices, *[F.col(g) for g in groups], *order)
    sliced, _ = settle(ranged.withColumn(_SLICE, F.spark_partition_id()), *groups)
    numbered = sliced.withColumns(
        _numbers(Window.partitionBy(*groups, _SLICE), order, sums, rank_by)
    )
    # Stored, so that Spark knows how small it is and picks the join by that.
    offsets, _ = settle(_slice_offsets(sliced, sums, groups))
    shift = {"position": "_rows_before", **{n: f"_{n}_before" for n in sums}}
    if rank_by:
        shift["rank"] = "_rows_before"
    placed = numbered.join(offsets, [*groups, _SLICE]).withColumns(
        {name: F.col(name) + F.col(before) for name, before in shift.items()}
    )
    if rank_by:
        placed = _carry_ties(placed, numbered, offsets, groups, rank_by)
    return placed.drop(_SLICE, *set(shift.values()))


def _slice_offsets(sliced: DataFrame, sums: Mapping[str, str], groups: list[str]) -> DataFrame:
    """What precedes each slice.  One row per slice and group it touches."""
    whole = sliced.groupBy(*groups, _SLICE).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_{name}") for name, c in sums.items()],
    )
    everything = Window.partitionBy(*groups)
    earlier = everything.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return whole.select(
        *groups,
        _SLICE,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_rows").over(everything).alias("rows_total"),
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums],
        *[F.sum(f"_{n}").over(everything).alias(f"{n}_total") for n in sums],
    )


def _carry_ties(
    placed: DataFrame, numbered: DataFrame, offsets: DataFrame, groups: list[str], rank_by: str
) -> DataFrame:
    """Give a value that runs on over several slices the rank of its first row.

    Only the first and last value of a slice can do so, so the table of their
    starts has at most two rows per slice.
    """
    edges = (
        numbered.groupBy(*groups, _SLICE)
        .agg(
            F.min_by(rank_by, "rank").alias("_first"),
            F.max_by(rank_by, "rank").alias("_last"),
            F.max("rank").alias("_last_rank"),
        )
        .join(offsets.select(*groups, _SLICE, "_rows_before"), [*groups, _SLICE])
    )
    starts = (
        edges.select(
            *groups,
            F.inline(
                F.array(
                    F.struct(F.col("_first").alias("_value"), (F.col("_rows_before") + 1).alias("_start")),
                    F.struct(
                        F.col("_last").alias("_value"),
                        (F.col("_rows_before") + F.col("_last_rank")).alias("_start"),
                    ),
                )
            ),
        )
        .groupBy(*[F.col(g).alias(f"_in_{g}") for g in groups], "_value")
        .agg(F.min("_start").alias("_start"))
    )
    same = F.col(rank_by).eqNullSafe(F.col("_value"))
    for g in groups:
        same = same & (F.col(g) == F.col(f"_in_{g}"))
    starts, _ = settle(starts)
    return (
        placed.join(starts, same, "left")
        .withColumn("rank", F.coalesce("_start", "rank"))
        .drop("_value", "_start", *[f"_in_{g}" for g in groups])
    )
