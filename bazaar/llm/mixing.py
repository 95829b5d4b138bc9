"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue up in a shuffled order, up to ``max_repeats``
times over.  A document's virtual finish time is the words its source has
queued until then divided by the source's target, so every source is through
with its target at time 1.  The mix is the global order of finish times, cut
where the budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.shared import slices_for, store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
ROWS_PER_SLICE = 50_000


def source_targets(
    sizes: Sequence[tuple[str | None, int]], weights: Sequence[int], max_repeats: int
) -> list[tuple[int, str | None, int, float]]:
    """(number, source, size, target) of each source, in order of code points, null last.

    Sources weigh ``weights`` in turn and share the sum of all sizes.  A share
    above ``max_repeats`` times the source's size stops there; what is left is
    shared again among the others until no share is above its limit.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(ordered))]
    limit = [max_repeats * size for _, size in ordered]
    budget = sum(size for _, size in ordered)
    sharing, fixed = set(range(len(ordered))), set()
    while True:
        left = budget - sum(limit[i] for i in fixed)
        whole = sum(weight[i] for i in sharing)
        above = {i for i in sharing if weight[i] * left > limit[i] * whole}
        if not above:
            break
        sharing -= above
        fixed |= above
    return [
        (i, source, size, float(limit[i]) if i in fixed else weight[i] * left / whole)
        for i, (source, size) in enumerate(ordered)
    ]


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 7,
    rows_per_slice: int = ROWS_PER_SLICE,
    carry: Sequence[str] = (),
) -> DataFrame:
    """What a mix of the given weights takes of each document.

    ``docs`` has ``doc_id``, ``text`` and ``source``; the result has a row for
    each of its rows with ``doc_id, size`` (words), ``source_size``, ``target``
    (words the source should give) and ``taken`` (words the mix takes of the
    document: a multiple of its size, ``max_repeats`` times at most).

    Null sources are one source of their own; null and empty texts have size 0
    and are never taken, as are documents of a source without any word.  Rows
    that are alike in id and size may change places without changing the
    result.  An empty table gives an empty result.  Columns to ``carry``, small
    ones under names the result does not have, come out with their rows.
    """
    spark = docs.sparkSession
    count = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = store(docs.select("doc_id", "source", count.alias("size"), *carry), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    # Shares are levelled among all sources at once: the driver sees a row for each.
    sizes = totals.collect()
    targets = source_targets([(r["source"], r["size"]) for r in sizes], weights, max_repeats)
    rows = sum(r["rows"] for r in sizes)
    budget = sum(r["size"] for r in sizes)
    table = spark.createDataFrame(
        targets, "source_no int, source string, source_size long, target double"
    )
    known = sized.join(
        table, sized["source"].eqNullSafe(table["source"])
    ).drop("source")
    queued = store(_queue(known, seed, slices_for(rows, rows_per_slice)), "mix-queue")
    return _cut(queued, budget, max_repeats, slices_for(rows, rows_per_slice), carry)


def _queue(known: DataFrame, seed: int, slices: int) -> DataFrame:
    """Adds the words queued in the source up to each document in a first pass.

    A source is shuffled by a hash; its ranges of hashes are added up first, so
    that a source with most of all rows is spread over many tasks.
    """
    bits = max(1, (slices - 1).bit_length())
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), 1)
    drawn = known.withColumn("key", key).withColumn("slice", F.shiftright("key", 63 - bits).cast("int"))
    sums = drawn.groupBy("source_no", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "source_no", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("source_no", "slice").orderBy("key", "doc_id", "size")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        drawn.withColumns({"place": F.row_number().over(within), "words": F.sum("size").over(so_far)})
        .join(offsets, ["source_no", "slice"])
        .withColumn("queued", F.col("words") + F.col("before"))
        .drop("words", "before")
    )


def _finish(turn: Column) -> Column:
    return F.try_divide(turn * F.col("source_size") + F.col("queued"), F.col("target"))


def _step(finish: Column, steps: int) -> Column:
    """Ranges of finish times: even up to 1, where every range has about as many words, wider beyond."""
    beyond = steps + F.floor(F.log2(F.greatest(finish, F.lit(1.0))) * steps)
    return F.when(finish < 1, F.floor(finish * steps)).otherwise(beyond).cast("long")


def _cut(
    queued: DataFrame, budget: int, max_repeats: int, steps: int, carry: Sequence[str]
) -> DataFrame:
    """Take documents in order of finish time while they fit in the budget.

    Whole ranges of finish times are taken by their sums; only the range that
    crosses the budget is sorted row by row.
    """
    turns = F.array(*[F.lit(i) for i in range(max_repeats)])
    live = queued.where((F.col("target") > 0) & (F.col("size") > 0))
    played = (
        live.select("*", F.explode(turns).alias("turn"))
        .withColumn("finish", _finish(F.col("turn")))
        .withColumn("step", _step(F.col("finish"), steps))
    )
    order = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = played.groupBy("step").agg(F.sum("size").alias("words"))
    running = sums.withColumn("until", F.sum("words").over(order))
    crossing = running.where(F.col("until") > budget).orderBy("step").first()
    last = crossing["step"] if crossing else None
    if last is None:
        return _shown(queued, F.lit(max_repeats), F.lit(0), carry)
    left = budget - (crossing["until"] - crossing["words"])
    in_range = Window.orderBy("finish", "source_no", "slice", "place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    edge = (
        played.where(F.col("step") == last)
        .withColumn("until", F.sum("size").over(in_range))
        .where(F.col("until") <= left)
        .groupBy("source_no", "slice", "place")
        .agg(F.count(F.lit(1)).alias("at_edge"))
    )
    before = sum(
        (F.when(_step(_finish(F.lit(i)), steps) < last, 1).otherwise(0) for i in range(max_repeats)),
        start=F.lit(0),
    )
    joined = queued.join(edge, ["source_no", "slice", "place"], "left")
    return _shown(joined, before, F.coalesce(F.col("at_edge"), F.lit(0)), carry)


def _shown(queued: DataFrame, whole: Column, at_edge: Column, carry: Sequence[str]) -> DataFrame:
    usable = (F.col("target") > 0) & (F.col("size") > 0)
    times = F.when(usable, whole + at_edge).otherwise(0)
    return queued.select(
        "doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"),
        *carry,
    )
