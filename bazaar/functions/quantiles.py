"""Exact quantiles, linear between neighbours, by radix selection.

Spark's exact ``percentile`` keeps every distinct value in memory.  Here a pass
counts rows in slots that keep the order of the values: at first by sign and
logarithm, then by even cuts of what is left.  A slot also tells its least and
largest value, so a wanted row is found as soon as its slot holds one value only,
and else the slot is cut again.  After the first pass a double has less than 48
bits left, and every further pass settles 16 of them.  All columns and quantiles
go through each pass together, and the driver sees one row for each wanted row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.numeric import no_nan

SLOTS = 1 << 16
# Slots of an octave in the first pass, and a number that makes those of all positive doubles positive.
_OCTAVE = 24
_BEYOND = 1_100 * _OCTAVE
_LARGEST = 1.7976931348623157e308


@dataclass(frozen=True)
class Summary:
    """Quantiles of a column, and how many of its rows have a value and how many none."""

    quantiles: list[float | None]
    rows: int
    missing: int


@dataclass
class _Wanted:
    """The row numbered ``rank`` of a column, among those from ``low`` to ``high``, of which ``below`` come before."""

    column: str
    rank: int
    below: int = 0
    low: float | None = None
    high: float | None = None

    def narrow(self, low: float, high: float, before: int, rows: int) -> None:
        self.below += before
        if self.rank == self.below:
            high = low
        elif self.rank == self.below + rows - 1:
            low = high
        self.low, self.high = low, high

    @property
    def found(self) -> bool:
        return self.low == self.high


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], slots: int = SLOTS
) -> dict[str, list[float | None]]:
    """Quantiles of each column over its non-null values; nulls if it has none."""
    return {c: s.quantiles for c, s in summaries(df, wanted, slots).items()}


def summaries(df: DataFrame, wanted: Mapping[str, Sequence[float]], slots: int = SLOTS) -> dict[str, Summary]:
    """Quantiles with counts, from the same passes."""
    if not wanted:
        return {}
    kinds = dict(df.select(*wanted).dtypes)
    df = df.select([no_nan(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in wanted])
    columns = list(wanted)
    sizes, rows = _first_pass(df, columns, wanted)
    while left := [r for r in rows.values() if not r.found]:
        _next_pass(df, left, slots)

    def interpolate(c: str, p: float) -> float | None:
        n = sizes.get(c, (0, 0))[0]
        if not n:
            return None
        low, high = _neighbours(p, n)
        if low == high:
            return rows[c, low].low
        place = p * (n - 1)
        return (high - place) * rows[c, low].low + (place - low) * rows[c, high].low

    return {c: Summary([interpolate(c, p) for p in wanted[c]], *sizes.get(c, (0, 0))) for c in columns}


def _neighbours(p: float, rows: int) -> tuple[int, int]:
    place = p * (rows - 1)
    return math.floor(place), math.ceil(place)


def _cell(bracket: int, value: Column, slot: Column) -> Column:
    return F.struct(F.lit(bracket).alias("bracket"), value.cast("double").alias("value"), slot.cast("long").alias("slot"))


def _counted(df: DataFrame, cells: list[Column]) -> DataFrame:
    """Rows of each bracket and slot, and how many the bracket has up to there and in all."""
    held = df.select((F.explode(F.array_compact(F.array(*cells))) if len(cells) > 1 else cells[0]).alias("cell"))
    table = held.where("cell is not null").groupBy("cell.bracket", "cell.slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("cell.value").alias("low"), F.max("cell.value").alias("high")
    )
    whole = Window.partitionBy("bracket")
    known = F.when(F.col("slot").isNotNull(), F.col("n")).otherwise(0)
    return table.withColumns({
        "upto": F.sum(known).over(whole.orderBy("slot")), "rows": F.sum(known).over(whole),
        "missing": F.sum(F.col("n") - known).over(whole),
    })


def _holding(table: DataFrame, ranks: Column) -> list:
    """For each bracket the slots that hold its ``ranks``."""
    held = table.where("slot is not null").withColumn("rank", F.explode(ranks))
    before = F.col("upto") - F.col("n")
    return held.where((F.col("rank") >= before) & (F.col("rank") < F.col("upto"))).collect()


def _by_logarithm(x: Column) -> Column:
    size = F.abs(x.cast("double"))
    slot = F.when(size > _LARGEST, F.lit(2 * _BEYOND)).otherwise(F.floor(F.log2(size) * _OCTAVE) + _BEYOND)
    return F.when(x.isNull(), F.lit(None)).when(size == 0, F.lit(0)).when(x > 0, slot).otherwise(-slot)


def _first_pass(
    df: DataFrame, columns: list[str], wanted: Mapping[str, Sequence[float]]
) -> tuple[dict[str, tuple[int, int]], dict[tuple[str, int], _Wanted]]:
    table = _counted(df, [_cell(i, F.col(c), _by_logarithm(F.col(c))) for i, c in enumerate(columns)])
    ranks = F.lit(None)
    for i, c in enumerate(columns):
        places = [F.lit(float(p)) * (F.col("rows") - 1) for p in dict.fromkeys(wanted[c])]
        both = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
        ranks = F.when(F.col("bracket") == i, both).otherwise(ranks)
    sizes, rows = {}, {}
    for r in _holding(table, ranks):
        c = columns[r["bracket"]]
        sizes[c] = (r["rows"], r["missing"])
        rows[c, r["rank"]] = row = _Wanted(c, r["rank"])
        row.narrow(r["low"], r["high"], r["upto"] - r["n"], r["n"])
    return sizes, rows


def _next_pass(df: DataFrame, left: list[_Wanted], slots: int) -> None:
    brackets = list(dict.fromkeys((r.column, r.low, r.high) for r in left))
    cells, ranks = [], F.lit(None)
    for i, (c, low, high) in enumerate(brackets):
        x = F.col(c)
        slot = F.floor((x - F.lit(low)).cast("double") / F.lit(float(high - low)) * slots)
        cells.append(F.when(x.between(low, high), _cell(i, x, slot)))
        inside = [r.rank - r.below for r in left if (r.column, r.low, r.high) == (c, low, high)]
        ranks = F.when(F.col("bracket") == i, F.array(*[F.lit(k).cast("long") for k in inside])).otherwise(ranks)
    found = {(r["bracket"], r["rank"]): r for r in _holding(_counted(df, cells), ranks)}
    for row in left:
        at = brackets.index((row.column, row.low, row.high))
        r = found[at, row.rank - row.below]
        row.narrow(r["low"], r["high"], r["upto"] - r["n"], r["n"])
