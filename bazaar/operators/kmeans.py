"""K-Means over weighted points: seeded from a coreset, exact from there, several models in one scan.

A coreset is a weighted sample whose cost for any centres is close to that of all
points.  Each point draws a priority from a hash of itself and its share of the
spread; the highest ones are the coreset, so coresets of parts merge into that of
the whole, whatever the partitions.  Seeds are worked out on it, where a try
costs nothing.  Lloyd steps then read all points, for all models at once, and
bring back the weight, sum and cost of every cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.session import settle

# Points of a coreset: what the driver works on.
CORESET_POINTS = 8_000
# Starts that are tried on the coreset for each model, and steps each may take.
_STARTS = 4
_SEED_STEPS = 25
# Steps over all points, and the move of a centre that no longer counts.
MAX_STEPS = 20
TOLERANCE = 1e-4
# Points a step works on at once, and a stored row holds: what it keeps of them stays in the cache of a core.
_AT_ONCE = 4_096
# Readers hold a whole group of rows in memory, and rows are long: groups are small, and cut in time.
_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "10"}
# Sums are added in any order; centres are cut where that shows.
_DECIMALS = 9

WEIGHT = "weight"


def coreset(points: DataFrame, size: int = CORESET_POINTS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights; ``points`` are distinct, have a ``weight``, and mean zero.

    Half of a point's chance comes from its weight, half from its distance to the
    mean.  If there are no more than ``size`` points, all of them with their weight.
    """
    names = [c for c in points.columns if c != WEIGHT]
    spread = sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)) / len(names)
    chance = F.col(WEIGHT) * (1 + spread)
    draw = (F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    marked = points.withColumns({"_chance": chance, "_priority": chance / draw})
    best = marked.orderBy(F.desc("_priority"), *names).limit(size + 1).collect()
    found = np.array([[r[c] for c in names] for r in best], dtype=float).reshape(len(best), len(names))
    weight = np.array([r[WEIGHT] for r in best], dtype=float)
    if len(best) > size:
        # What a point stands for: itself, or as much as it takes to reach the last priority.
        least = best[-1]["_priority"]
        weight *= np.maximum(1.0, least / np.array([r["_chance"] for r in best]))
        found, weight = found[:size], weight[:size]
    return found, weight


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of points to centres."""
    out = np.empty((len(points), len(centers)))
    for i, c in enumerate(centers):
        gap = points - c
        out[:, i] = np.einsum("ij,ij->i", gap, gap)
    return out


def _settled(points: np.ndarray, weight: np.ndarray, centers: np.ndarray) -> tuple[float, np.ndarray]:
    """Cost and centres after steps within the coreset."""
    for _ in range(_SEED_STEPS):
        nearest = _distances(points, centers).argmin(axis=1)
        total = np.bincount(nearest, weight, len(centers))
        moved = centers.copy()
        held = total > 0
        for d in range(points.shape[1]):
            moved[held, d] = np.bincount(nearest, weight * points[:, d], len(centers))[held] / total[held]
        if np.abs(moved - centers).max() < TOLERANCE:
            break
        centers = moved
    return float(weight @ _distances(points, centers).min(axis=1)), centers


def _added(points: np.ndarray, weight: np.ndarray, centers: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """One more centre: a point drawn by its share of the cost."""
    cost = weight * (_distances(points, centers).min(axis=1) if len(centers) else 1.0)
    if cost.sum() == 0:
        return centers
    return np.vstack([centers, points[draw.choice(len(points), p=cost / cost.sum())]])


def seeds(points: np.ndarray, weight: np.ndarray, ks: Sequence[int], seed: int) -> dict[int, np.ndarray]:
    """Centres for every ``k``, each grown from those of the one before and tried against fresh starts.

    Fewer than ``k`` where there are not so many points.
    """
    draw, found = np.random.default_rng(seed), {}
    best = np.zeros((0, points.shape[1]))
    for k in range(1, max(ks) + 1):
        tries = []
        for start in range(2 * _STARTS):
            centers = best
            if start >= _STARTS:
                centers = np.zeros((0, points.shape[1]))
                while len(centers) < k - 1 and len(grown := _added(points, weight, centers, draw)) > len(centers):
                    centers = grown
            tries.append(_settled(points, weight, _added(points, weight, centers, draw)))
        best = min(tries, key=lambda t: t[0])[1]
        found[k] = best
    return {k: found[k] for k in ks}


def packed(points: DataFrame) -> DataFrame:
    """The points some thousand to a row, column after column: what a step reads costs little to hand over."""
    names = [*(c for c in points.columns if c != WEIGHT), WEIGHT]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.stack([batch.column(c).to_numpy() for c in names])
            cuts = [block[:, at : at + _AT_ONCE].tobytes() for at in range(0, len(batch), _AT_ONCE)]
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.binary())], names=["block"])

    return points.mapInArrow(pack, "block binary")


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of ``x`` the nearest centre, the first of equal ones, and its squared distance."""
    # The square of the point is the same for all centres, so it is added at the end.
    # No matrix product: its threads would get in the way of the other tasks.
    gaps = (centers**2).sum(axis=1)[:, None] - np.einsum("kd,dn->kn", 2 * centers, x)
    least, nearest = gaps[0], np.zeros(x.shape[1], dtype=np.intp)
    for c in range(1, len(centers)):
        nearest[gaps[c] < least] = c
        least = np.minimum(least, gaps[c])
    return nearest, np.maximum(least + np.einsum("ij,ij->j", x, x), 0.0)


def step(points: DataFrame, models: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Weight and mean of the clusters of each model, and its cost, in one scan."""
    return _step(packed(points), models)


def _step(blocks: DataFrame, models: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    width = models[0].shape[1]
    sums = [f"s{i}" for i in range(width)]
    schema = ", ".join(["model int, cluster int, w double, cost double", *[f"{s} double" for s in sums]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), 2 + width)) for c in models]
        for batch in batches:
            for block in batch.column("block"):
                held = np.frombuffer(block.as_buffer()).reshape(width + 1, -1)
                for at in range(0, held.shape[1], _AT_ONCE):
                    x, w = held[:width, at : at + _AT_ONCE], held[width, at : at + _AT_ONCE]
                    weighted = w * x
                    for centers, out in zip(models, total, strict=True):
                        nearest, gap = _nearest(x, centers)
                        for i, cell in enumerate([w, w * gap, *weighted]):
                            out[:, i] += np.bincount(nearest, cell, len(centers))
        rows = np.vstack(total)
        where = [(m, c) for m, centers in enumerate(models) for c in range(len(centers))]
        model, cluster = (pa.array(v, pa.int32()) for v in zip(*where, strict=True))
        yield pa.RecordBatch.from_arrays(
            [model, cluster, *[pa.array(column) for column in rows.T]], names=["model", "cluster", "w", "cost", *sums]
        )

    parts = blocks.mapInArrow(add, schema).groupBy("model", "cluster")
    rows = parts.agg(*[F.sum(c).alias(c) for c in ("w", "cost", *sums)]).collect()
    out = []
    for m, centers in enumerate(models):
        weight, mean, cost = np.zeros(len(centers)), centers.copy(), 0.0
        for r in sorted((r for r in rows if r["model"] == m), key=lambda r: r["cluster"]):
            c = r["cluster"]
            weight[c], cost = r["w"], cost + r["cost"]
            if r["w"] > 0:
                mean[c] = [r[s] / r["w"] for s in sums]
        out.append((weight, mean.round(_DECIMALS), cost))
    return out


def refine(
    blocks: DataFrame, starts: dict[int, np.ndarray], tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS
) -> dict[int, tuple[np.ndarray, float]]:
    """Exact Lloyd steps for all models together over packed points: centres and their cost."""
    left, found = dict(starts), {}
    for turn in range(max_steps + 1):
        for (k, centers), (_, moved, cost) in zip(list(left.items()), _step(blocks, list(left.values())), strict=True):
            if turn == max_steps or np.abs(moved - centers).max() < tolerance:
                found[k] = (centers, cost)
                del left[k]
            else:
                left[k] = moved
        if not left:
            break
    return found


def fit(points: DataFrame, ks: Sequence[int], seed: int) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and cost for every ``k`` of ``ks``; more centres never cost more."""
    sample, weight = coreset(points, seed=seed)
    if not len(sample):
        raise ValueError("no row has all features")
    blocks, _ = settle(packed(points), compression="zstd", **_GROUPS)
    found = refine(blocks, seeds(sample, weight, ks, seed))
    draw = np.random.default_rng(seed)
    for less, more in zip(sorted(ks), sorted(ks)[1:], strict=False):
        if found[more][1] > found[less][1]:
            grown = found[less][0]
            while len(grown) < more and len(next_ := _added(sample, weight, grown, draw)) > len(grown):
                grown = next_
            found |= refine(blocks, {more: grown})
    return found
