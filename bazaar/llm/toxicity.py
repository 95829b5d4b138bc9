"""Toxicity scores learned from toxic examples and unlabelled text.

The learner knows texts that are toxic and texts of which it knows nothing.
With the share of toxic texts known, the risk on clean texts is the risk on
all texts less that on toxic ones.  On a sample this difference can fall below
zero, which is over-fitting, so it counts as zero at least (non-negative
positive-unlabelled learning).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.shared import NOT_ALNUM, Words, held_out, pieces, prefix_sums, span_hash

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
# What is said of a slot: a text has it, twice, four times, once in 500 words, in 100.
LEVEL_BITS = 3
FEATURES = SLOTS << LEVEL_BITS
# The learner's sample: toxic examples and unlabelled texts, drawn by a hash of the id.
MAX_TOXIC = 4_000
MAX_UNLABELLED = 12_000
LEAST_TOXIC = 3
THRESHOLD = 0.3
_STEMS = (4, 5, 6)


def _slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, slot) of every word and of the beginnings of words; words of each text."""
    words = Words(texts, NOT_ALNUM, lower=True)
    sums = prefix_sums(words.bytes)
    n_words = np.diff(words.first)
    doc = np.repeat(np.arange(len(texts)), n_words)
    size = words.end - words.start
    docs, slots = [doc], [span_hash(sums, words.start, words.end)]
    for stem in _STEMS:
        longer = size > stem
        start = words.start[longer]
        docs.append(doc[longer])
        slots.append(span_hash(sums, start, start + stem) ^ np.uint64(stem << 40))
    shift = np.uint64(64 - SLOT_BITS)
    return np.concatenate(docs), (np.concatenate(slots) >> shift).astype(np.int64), n_words


def _features(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each text, in order; of the ``wanted`` slots, or all."""
    doc, slot, n_words = _slots(texts)
    if wanted is not None:
        keep = wanted[slot]
        doc, slot = doc[keep], slot[keep]
    held, times = np.unique(doc * SLOTS + slot, return_counts=True)
    of = n_words[held // SLOTS]
    said = [times >= 1, times >= 2, times >= 4, times * 500 >= of, times * 100 >= of]
    cells = np.sort(np.concatenate([
        (held[true] // SLOTS) * FEATURES + level * SLOTS + held[true] % SLOTS for level, true in enumerate(said)
    ]))
    return cells // FEATURES, cells % FEATURES


def _drawn(docs: DataFrame, ids: DataFrame, most: int, wanted: np.ndarray | None = None) -> _Sample:
    """The features of at most ``most`` texts, drawn by a hash of their ids."""
    draw = F.xxhash64(F.lit(3), "doc_id")
    picked = ids.select("doc_id").distinct().orderBy(draw, "doc_id").limit(most)
    carried = docs.sparkSession.sparkContext.broadcast(None if wanted is None else np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if carried.value is None else np.unpackbits(carried.value).astype(bool)
        for _, texts in pieces(batches):
            doc, feature = _features(texts, asked)
            edges = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(feature.astype(np.int32)))],
                names=["features"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(picked), "doc_id").select("text").mapInArrow(run, "features array<int>")
    return _Sample(found.toArrow())


class _Sample:
    """Rows of distinct features, as one long array."""

    def __init__(self, table: pa.Table):
        column = table.column("features")
        sizes = [np.diff(c.offsets.to_numpy()) for c in column.chunks]
        self.rows = len(column)
        self.row = np.repeat(np.arange(self.rows), np.concatenate([np.zeros(0, dtype=int), *sizes]))
        self.feature = np.concatenate([np.zeros(0, dtype=np.int32), *[c.flatten().to_numpy() for c in column.chunks]])

    def narrowed(self, column: np.ndarray) -> None:
        """Features become column numbers; those without a column go."""
        kept = column[self.feature] >= 0
        self.row, self.feature = self.row[kept], column[self.feature[kept]]


def fit(
    toxic: _Sample, unlabelled: _Sample, prior: float, rounds: int = 400, rate: float = 0.05,
    sparsity: float = 0.02, least_toxic: int = LEAST_TOXIC, discount: float = 1.0, least_lift: float = 2.0,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, their weights, and a bias that minimise the non-negative risk.

    Logistic loss, Adam steps over the whole sample, and weights shrunk towards
    zero in each.  Features count that at least ``least_toxic`` toxic texts have, and
    ``least_lift`` times as often as all texts do: those that tell nothing would only
    move all outputs together.
    """
    if not toxic.rows or not unlabelled.rows or prior <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -20.0
    often = np.bincount(toxic.feature, minlength=FEATURES)
    usual = np.bincount(unlabelled.feature, minlength=FEATURES) / unlabelled.rows
    used = np.flatnonzero((often >= min(least_toxic, toxic.rows)) & (often / toxic.rows >= least_lift * usual))
    column = np.full(FEATURES, -1, dtype=np.int32)
    column[used] = np.arange(len(used))
    toxic.narrowed(column)
    unlabelled.narrowed(column)
    theta = np.zeros(len(used) + 1)
    theta[-1] = np.log(prior / (1 - prior)) if prior < 1 else 1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def outputs(sample: _Sample) -> np.ndarray:
        return np.bincount(sample.row, theta[sample.feature], minlength=sample.rows) + theta[-1]

    def gradient(sample: _Sample, by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(sample.feature, by_row[sample.row], minlength=len(used)), by_row.sum())

    # The less toxic texts there are, the more chance there is in what they share.
    sparsity = sparsity / toxic.rows**0.5
    averaged, late = np.zeros_like(theta), rounds // 2
    for step in range(1, rounds + 1):
        on_toxic, on_all = outputs(toxic), outputs(unlabelled)
        p, u = _sigmoid(on_toxic), _sigmoid(on_all)
        clean_risk = _softplus(on_all).mean() - prior * _softplus(on_toxic).mean()
        # d/dz log(1+e^z) is sigmoid(z); d/dz log(1+e^-z) is sigmoid(z) - 1.
        g = gradient(toxic, prior * (p - 1) / toxic.rows)
        of_clean = gradient(unlabelled, u / unlabelled.rows) - gradient(toxic, prior * p / toxic.rows)
        # A risk below zero is over-fitting: climb back from there.
        g = g + of_clean if clean_risk > 0 else -discount * of_clean
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        scale = np.sqrt(second / (1 - 0.99**step)) + 1e-4
        now = rate * min(1.0, 10 / step**0.5)
        theta -= now * (first / (1 - 0.9**step)) / scale
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - now * sparsity / scale[:-1], 0)
        if step > late:
            averaged += theta / (rounds - late)
    theta = averaged
    told = np.flatnonzero(theta[:-1])
    return used[told], theta[told], float(theta[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def learn(
    docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED
) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on a bounded sample of ``docs``; ``labels`` say which are toxic (``doc_id, toxic``).

    The share of toxic texts is taken from all labels.  A document labelled in
    several ways is toxic if any label says so; null labels are none.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    toxic = _drawn(docs, known.where("toxic = 1"), max_toxic)
    # Slots that hardly any toxic text has cannot get a weight, so they need not be gathered.
    texts_with = np.bincount(toxic.feature[toxic.feature < SLOTS], minlength=SLOTS)
    everything = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    unlabelled = _drawn(docs, everything, max_unlabelled, texts_with >= min(LEAST_TOXIC, max(1, toxic.rows)))
    return fit(toxic, unlabelled, prior)


OUT = "doc_id long, held_out boolean, score double, predicted int"


def score(
    docs: DataFrame, features: np.ndarray, weights: np.ndarray, bias: float, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(SLOTS, dtype=bool)
        wanted[features % SLOTS] = True
        weight = np.zeros(FEATURES, dtype=np.float32)
        weight[features] = weights
        for rows, texts in pieces(batches):
            doc, feature = _features(texts, wanted)
            outputs = np.bincount(doc, weight[feature].astype(np.float64), minlength=len(texts)) + bias
            scores = _sigmoid(outputs)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("held_out"), pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return picked.mapInArrow(run, OUT)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from documents and labels that are not held out, then score all documents.

    Without a toxic example every score is next to 0.  Null texts count as empty,
    and empty ones get a score too; a null id is never held out.  Every row is
    scored by itself, whole and however long; rows of one id are told apart by
    nothing, so each is learnt from if the id has a label.  Other columns of both
    tables, whatever their names, are not read.
    """
    model = learn(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, *model)
