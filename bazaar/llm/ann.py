"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample and splits the directions of vectors by
k-means, level by level.  Every vector goes down to a leaf.  A query visits
leaves in the order of a priority queue that holds the closest branch not yet
taken.  How many it visits is widened until queries whose neighbours are known
from a full search find enough of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.shared import store

NEIGHBOURS = 5
# Bounds of what passes through the driver: the fitted sample, and the queries that calibrate.
MAX_SAMPLE = 20_000
MAX_CALIBRATION = 128
BRANCHES = 8
LEAF_SAMPLE = 48
RECALL = 0.97
# Vectors of a leaf that one task compares with the leaf's queries.
ROWS_PER_TASK = 20_000


@dataclass
class Node:
    """Centres of the branches and where they lead: inner nodes, or leaves as -1 - leaf."""

    centres: np.ndarray
    leads: list[int]


class Tree:
    def __init__(self, unit: np.ndarray, branches: int, leaf_sample: int, seed: int = 5):
        self.nodes: list[Node] = []
        self.leaves = 0
        random = np.random.default_rng(seed)
        root = self._grow(unit, branches, leaf_sample, random)
        if root < 0:
            self.nodes.append(Node(np.zeros((1, unit.shape[1])), [root]))
        self.root = max(root, 0)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, unit: np.ndarray, branches: int, leaf_sample: int, random: np.random.Generator) -> int:
        if len(unit) <= leaf_sample or (part := _k_means(unit, branches, random)) is None:
            return self._leaf()
        centres, of = part
        at = len(self.nodes)
        self.nodes.append(Node(centres, []))
        for i in range(len(centres)):
            self.nodes[at].leads.append(self._grow(unit[of == i], branches, leaf_sample, random))
        return at

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the closest branch at every node."""
        out = np.zeros(len(unit), dtype=np.int32)
        todo = [(self.root, np.arange(len(unit)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            best = (unit[rows] @ node.centres.T).argmax(axis=1)
            for i, lead in enumerate(node.leads):
                mine = rows[best == i]
                if lead < 0:
                    out[mine] = -1 - lead
                elif len(mine):
                    todo.append((lead, mine))
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: always on from the closest branch not yet taken."""
        waiting = [(0.0, self.root)]
        while waiting:
            _, at = heapq.heappop(waiting)
            while at >= 0:
                node = self.nodes[at]
                far = 1 - node.centres @ query
                best = int(far.argmin())
                for i, lead in enumerate(node.leads):
                    if i != best:
                        heapq.heappush(waiting, (float(far[i]), lead))
                at = node.leads[best]
            yield -1 - at


def _k_means(unit: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8):
    """Centres of unit length and the centre of each vector; nothing if they are all alike."""
    distinct = np.unique(unit, axis=0)
    if len(distinct) < 2:
        return None
    centres = distinct[random.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        used = np.unique(of)
        sums = np.stack([unit[of == i].sum(axis=0) for i in used])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    of = (unit @ centres.T).argmax(axis=1)
    used, of = np.unique(of, return_inverse=True)
    return (centres[used], of) if len(used) > 1 else None


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vec`` of the vectors that have a direction.

    Null vectors, zero ones and those with a null or non-finite component take
    no part, nor do those of another length than most, or without an id.
    """
    big = F.lit(float("inf"))
    vec = F.transform(F.col(column), lambda x: x.cast("double"))

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == big)

    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    )
    sizes = whole.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    return whole.where(F.size("vec") == (most["size"] if most else 0))


def _top(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query, neighbour, cosine) of the ``k`` nearest among ``vectors`` to each query.

    A matrix product finds all that can be among them; their cosines are then
    worked out one by one, so that equal vectors have equal ones.
    """
    out_q, out_v, out_s = [], [], []
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    unit = vectors / lengths[:, None]
    for begin in range(0, len(queries), 256):
        some = queries[begin : begin + 256]
        near = _unit(some) @ unit.T
        for i, q in enumerate(some):
            query_id = query_ids[begin + i]
            row = near[i]
            others = ids != query_id
            wanted = min(k, int(others.sum()))
            if not wanted:
                continue
            candidates = np.flatnonzero(others)
            floor = np.partition(row[candidates], len(candidates) - wanted)[len(candidates) - wanted]
            close = candidates[row[candidates] >= floor - 1e-9]
            dots = (vectors[close] * q).sum(axis=1)
            cosine = dots / (lengths[close] * np.sqrt((q * q).sum()))
            best = np.lexsort((ids[close], -cosine))[:wanted]
            out_q += [query_id] * len(best)
            out_v.append(ids[close[best]])
            out_s.append(cosine[best])
    none = np.zeros(0)
    return np.array(out_q, dtype=np.int64), np.concatenate([none.astype(np.int64), *out_v]), np.concatenate([none, *out_s])


_FOUND = "query_id long, vec_id long, score double"


def _found(parts: tuple) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(p, t) for p, t in zip(parts, types, strict=True)], names=["query_id", "vec_id", "score"]
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """A full search for a few queries, carried to all vectors."""
    carried = vectors.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            if len(ids):
                yield _found(_top(ids, _matrix(batch.column("vec")), *carried.value, k))

    return _best(vectors.select("vec_id", "vec").mapInArrow(run, _FOUND), k)


def _drawn(vectors: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    draw = F.xxhash64(F.lit(17), "vec_id")
    table = vectors.select("vec_id", "vec").orderBy(draw, "vec_id").limit(most).toArrow().combine_chunks()
    if not table.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 1))
    vec = table.column("vec").combine_chunks()
    return table.column("vec_id").to_numpy(), _matrix(vec)


def _calibrated(tree: Tree, placed: DataFrame, calibration: tuple, k: int, recall: float) -> int:
    """How many leaves a query must visit to find ``recall`` of its true neighbours."""
    query_ids, queries = calibration
    true = exact_neighbours(placed, query_ids, queries, k)
    met = true.join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    leaves: dict[int, list[int]] = {}
    for row in met:
        leaves.setdefault(row["query_id"], []).append(row["leaf"])
    ranks = []
    for query_id, unit in zip(query_ids.tolist(), _unit(queries), strict=True):
        order = {leaf: i + 1 for i, leaf in enumerate(tree.visits(unit))}
        ranks += [order[leaf] for leaf in leaves.get(query_id, [])]
    if not ranks:
        return tree.leaves
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))])


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = NEIGHBOURS,
    recall: float = RECALL,
    max_sample: int = MAX_SAMPLE,
    rows_per_task: int = ROWS_PER_TASK,
    column: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows found for each row that ``queries`` selects.

    ``vectors`` has ``vec_id`` and a column of numbers; ``queries`` is a
    condition on ``vec_id``.  Returns ``query_id, rank, vec_id, score``, the
    cosine in double precision, nearest first, ties to the smaller id; all
    candidates if there are fewer than ``k``.  A query is not its own neighbour;
    repeated rows of one id are one candidate.  Unusable vectors (see
    ``usable``) are neither queries nor candidates; an empty table gives none.
    """
    spark = vectors.sparkSession
    kept = store(usable(vectors, column), "ann-vectors")
    _, sample = _drawn(kept, max_sample)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(_unit(sample), BRANCHES, LEAF_SAMPLE)
    carried = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaf = carried.value.leaf_of(_unit(_matrix(batch.column("vec"))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vec"), pa.array(leaf)], names=["vec_id", "vec", "leaf"]
                )

    placed = store(kept.mapInArrow(place, "vec_id long, vec array<double>, leaf int"), "ann-leaves")
    asked = placed.where(queries)
    visits = _calibrated(tree, placed, _drawn(asked, MAX_CALIBRATION), k, recall)
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count_distinct("vec_id").alias("n")).collect()}
    parts = {leaf: -(-n // rows_per_task) for leaf, n in sizes.items()}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves, places = [], [], []
            units = _unit(_matrix(batch.column("vec"))) if len(batch) else []
            for i, unit in enumerate(units):
                met = 0
                for seen, leaf in enumerate(carried.value.visits(unit)):
                    # Fewer than k others met: go on, however many leaves it takes.
                    if seen >= visits and met > k:
                        break
                    met += sizes.get(leaf, 0)
                    for part in range(parts.get(leaf, 0)):
                        rows.append(i)
                        leaves.append(leaf)
                        places.append(part)
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(taken), batch.column("vec").take(taken),
                    pa.array(leaves, pa.int32()), pa.array(places, pa.int32()),
                ],
                names=["vec_id", "vec", "leaf", "part"],
            )

    schema = "vec_id long, vec array<double>, leaf int, part int"
    sent = asked.select("vec_id", "vec").distinct().mapInArrow(visit, schema)
    # A leaf with more rows than one task should compare is cut into parts by id.
    cuts = F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair])
    part = F.pmod(F.xxhash64("vec_id"), cuts[F.col("leaf")]).cast("int")
    held = placed.withColumn("part", part)

    def compare(questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(questions) or not len(rows):
            return pa.Table.from_batches([_found(([], [], []))])
        q, v = (t.column("vec").combine_chunks() for t in (questions, rows))
        ids, query_ids = rows.column("vec_id").to_numpy(), questions.column("vec_id").to_numpy()
        return pa.Table.from_batches([_found(_top(ids, _matrix(v), query_ids, _matrix(q), k))])

    found = sent.groupBy("leaf", "part").cogroup(held.groupBy("leaf", "part")).applyInArrow(compare, _FOUND)
    return _best(found, k)
