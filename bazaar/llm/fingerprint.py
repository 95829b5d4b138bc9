"""Document fingerprints from Lempel-Ziv phrases.

A document is parsed into phrases as a dictionary coder does: each phrase is the
longest known one and one byte more.  The set of phrases is hashed, and the
least hash in each of a number of bins makes the fingerprint.  Documents that
compress well together share phrases, and so bins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.shared import encoded, prefix_sums, slices_for, span_hash, squeeze, unsqueeze

BINS = 128
# Text of neighbouring documents that one task goes through.
SLICE_BYTES = 16 << 20
_NO_ID = -(1 << 63)

OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


class Phrases:
    """A parse that can go on: the known phrases as a tree, and where phrases end."""

    def __init__(self) -> None:
        self.tree: dict[int, int] = {}
        self.node = 0
        self.ends: list[int] = []
        self.read = 0

    def parse(self, data: bytes) -> None:
        tree, node = self.tree, self.node
        known, ended = tree.get, self.ends.append
        # Nodes are numbered in steps of 256, so that node + byte is the branch's key.
        free = (len(tree) + 1) << 8
        for at, byte in enumerate(data, self.read + 1):
            branch = known(node + byte)
            if branch:
                node = branch
            else:
                tree[node + byte] = free
                free += 256
                node = 0
                ended(at)
        self.node = node
        self.read += len(data)

    def branch(self) -> Phrases:
        other = Phrases()
        other.tree, other.node = self.tree.copy(), self.node
        other.ends, other.read = self.ends.copy(), self.read
        return other

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of all phrases; the last may be one that was known."""
        ends = self.ends if not self.read or self.ends[-1:] == [self.read] else [*self.ends, self.read]
        end = np.array(ends, dtype=np.int64)
        return np.concatenate(([0], end[:-1])).astype(np.int64)[: len(end)], end


def sketch(data: bytes, phrases: Phrases, bins: int) -> np.ndarray:
    """The least hash of each bin in 16 bits, never 0; 0 where a bin is empty."""
    begin, end = phrases.spans()
    least = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    if len(end):
        hashes = span_hash(prefix_sums(np.frombuffer(data, dtype=np.uint8)), begin, end)
        np.minimum.at(least, (hashes % np.uint64(bins)).astype(np.int64), hashes // np.uint64(bins))
    filled = least != np.iinfo(np.uint64).max
    # A minimum's leading bits are mostly 0, so it is spread again before it is cut to 16.
    spread = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return np.where(filled, np.maximum(spread, 1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of bins with equal hashes among those that either has; 1 for two empty ones."""
    held = (a > 0) | (b > 0)
    return float(((a == b) & held).sum() / held.sum()) if held.any() else 1.0


def _slice_borders(docs: DataFrame, slice_bytes: int) -> list[int]:
    """Ids that begin slices of about ``slice_bytes``, the least id first."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    size = F.sum(F.octet_length("text")).alias("size")
    least, size = docs.agg(F.min(order), size).first()
    if least is None:
        return []
    slices = slices_for(size or 0, slice_bytes)
    shares = [i / slices for i in range(1, slices)]
    if not shares:
        return [least]
    inner = docs.agg(F.percentile_approx(order, shares, 20 * slices)).first()[0]
    return sorted({least, *inner})


def _to_slices(docs: DataFrame, borders: list[int]) -> DataFrame:
    """Documents with the number of their slice; the first of a slice also visits the one before.

    The first document of all visits the last slice.
    """
    begins, count = np.array(borders, dtype=np.int64), len(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column("order").to_numpy()
            data = pa.array([squeeze(t) for t in encoded(batch.column("text"))], pa.binary())
            slice_ = np.searchsorted(begins, order, side="right") - 1
            visits = np.flatnonzero(begins[slice_] == order)
            rows = np.concatenate([np.arange(len(order)), visits])
            number = np.concatenate([slice_, (slice_[visits] - 1) % count])
            guest = np.repeat([False, True], [len(order), len(visits)])
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number, pa.int32()), pa.array(guest), batch.column("order").take(taken),
                    batch.column("doc_id").take(taken), data.take(taken),
                ],
                names=["slice", "guest", "order", "doc_id", "data"],
            )

    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("order")
    picked = docs.select(order, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(run, "slice int, guest boolean, order long, doc_id long, data binary")


class _Document:
    """A text, its sketch, and its parse as far as the half that stays when it is edited."""

    def __init__(self, doc_id: int | None, data: bytes, bins: int):
        self.doc_id, self.text = doc_id, data.decode()
        half = len(self.text) // 2
        self.stays = self.text[: len(self.text) - half].encode()
        self.half = Phrases()
        self.half.parse(self.stays)
        whole = self.half.branch()
        whole.parse(data[len(self.stays) :])
        self.sketch = sketch(data, whole, bins)

    def row(self, following: _Document, bins: int) -> tuple:
        other = following.text[: len(self.text) // 2].encode()
        edited = self.stays + other
        self.half.parse(other)
        edited_sketch = sketch(edited, self.half, bins)
        return (
            self.doc_id, len(self.text), hashlib.sha256(edited).hexdigest(),
            self.sketch.astype(">u2").tobytes().hex(), edited_sketch.astype(">u2").tobytes().hex(),
            likeness(self.sketch, edited_sketch), likeness(self.sketch, following.sketch),
        )


def fingerprint_documents(docs: DataFrame, bins: int = BINS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The fingerprint of every text and of its edited form.

    The edited text is the text with its last half, rounded down, replaced by as
    many first characters of the next document by ``doc_id``, or all it has; the
    last document is followed by the first, a single one by itself.  Rows without
    an id come first; rows of one id are ordered by their packed texts.  Returns for
    each row ``n_chars``, both fingerprints (four hex digits for each bin, 0000
    if empty), the digest of the edited text, and how like the fingerprint is to
    the edited one and to that of the next document.  Null is empty; an empty
    text has an empty fingerprint, alike to another empty one only.
    """
    borders = _slice_borders(docs, slice_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        before, at, closed = None, None, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("slice", "guest", "doc_id", "data")]
            for slice_, guest, doc_id, data in zip(*columns, strict=True):
                if slice_ != at:
                    before, at, closed = None, slice_, False
                if closed:
                    continue
                here = _Document(doc_id, unsqueeze(data), bins)
                if before is not None:
                    rows.append(before.row(here, bins))
                before, closed = here, guest
            if rows:
                yield _rows(rows)
                rows = []

    placed = _to_slices(docs, borders)
    if not borders:
        return placed.mapInArrow(run, OUT)
    dealt = placed.repartition(len(borders), "slice").sortWithinPartitions("slice", "guest", "order", "data")
    return dealt.select("slice", "guest", "doc_id", "data").mapInArrow(run, OUT)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    text, double = pa.string(), pa.float64()
    types = [pa.int64(), pa.int64(), text, text, text, double, double]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])
