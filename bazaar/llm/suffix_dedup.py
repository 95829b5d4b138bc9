"""Substring dedup over bytes by a depth-limited radix sort of suffixes.

The sort goes by most significant digits and stops at the depth of the window:
suffixes that are equal so far stay in a group, and groups that lie in one
document are dropped.  Groups left at full depth are exactly the windows that
several documents hold.  What keeps it small:

* A window is sorted at its anchors only: the places of its least gram of
  ``gram`` bytes.  Equal windows have equal anchors at equal places, so sorting
  the anchors, about one byte in twelve, loses no window.
* The first digit is the anchor's gram, the second its context, the bytes that
  all windows around it can reach.  A context that a smaller document has
  settles all its windows at once; only where an anchor has several contexts,
  the first occurrence of each goes on to the last digit, the windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bazaar.llm.blocks import (
    ENTRIES, answer, bits_by_kind, bucket_edges, carried_columns, carried_schema, differs, doc_order, entries, gather_bits, held_earlier,
    held_twice, keep_bucketed, least_by_key, text_blocks, total_bytes, unpack_block,
)
from bazaar.llm.shared import lean_cogroup, lean_map, mix, prefix_sums, slices_for, span_hash, store, window_hash

WINDOW = 50
GRAM = 28
# Text whose keys one task sorts at a time.
BUCKET_BYTES = 8 << 20

# Kinds of keys: grams, contexts of grams, grams with their contexts, windows.
GRAMS, CONTEXTS, MIXED, WINDOWS = range(4)
RULES = {
    GRAMS: (np.uint8, np.uint8, held_twice),
    CONTEXTS: (np.int64, np.int64, held_earlier),
    MIXED: (np.uint32, np.uint32, differs),
    WINDOWS: (np.int64, np.int64, held_earlier),
}
_GRAM_BITS = 48

OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary"


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of every ``width`` neighbouring values."""
    step = 1
    while step * 2 <= width:
        values = best(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return best(values[: len(values) - rest], values[rest:]) if rest else values


class _Radix:
    """A block's bytes, its anchors, and what is known of them after each pass."""

    def __init__(self, doc_ids: list, texts: list[bytes], window: int, gram: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.doc_ids, self.order = doc_ids, doc_order(doc_ids)
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum(np.array([len(t) for t in texts], dtype=np.int64))
        self.begins = self.ends - np.array([len(t) for t in texts], dtype=np.int64)
        self.reach = window - gram
        self.sums = prefix_sums(self.bytes)
        self._find_anchors(gram)
        # Starts of the windows found to be removed.
        self.removed = np.zeros(len(self.bytes) + 1, dtype=bool)

    def _find_anchors(self, gram: int) -> None:
        n = len(self.bytes)
        empty = np.zeros(0, dtype=np.int64)
        if n < self.window:
            self.grams, self.at, self.least = np.zeros(0, dtype=np.uint64), empty, np.zeros(0, dtype=np.uint64)
        else:
            self.grams = window_hash(self.sums, gram)
            least = _slide(self.grams, self.reach + 1, np.minimum)
            outside = np.zeros(n + 2, dtype=np.int32)
            np.add.at(outside, np.maximum(self.begins, self.ends - self.window + 1), 1)
            np.add.at(outside, self.ends, -1)
            least[np.cumsum(outside)[: len(least)] > 0] = 0
            padded = np.zeros(len(self.grams) + self.reach, dtype=np.uint64)
            padded[self.reach : self.reach + len(least)] = least
            self.least = least
            self.at = np.flatnonzero((_slide(padded, self.reach + 1, np.maximum) == self.grams) & (self.grams > 0))
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.key = self.grams[self.at] >> np.uint64(64 - _GRAM_BITS)

    # First digit: which grams are in several documents?

    def send_grams(self, block: str) -> Iterator[pa.RecordBatch | None]:
        keys, least = least_by_key(self.key, self.doc)
        _, most = least_by_key(self.key, -self.doc)
        times = np.where(least < -most, 2, 1).astype(np.uint8)
        yield entries(GRAMS, block, bucket_edges(keys, self.buckets, _GRAM_BITS), keys, times)

    def keep_repeated(self, bits: list[tuple[int, bytes]]) -> None:
        keys, place = np.unique(self.key, return_inverse=True)
        repeated = gather_bits(bits, bucket_edges(keys, self.buckets, _GRAM_BITS))[place]
        self.at, self.doc, self.key = self.at[repeated], self.doc[repeated], self.key[repeated]
        self.left = np.maximum(self.begins[self.doc], self.at - self.reach)
        self.right = np.minimum(self.ends[self.doc], self.at + self.window)
        shift = (self.at - self.left).astype(np.uint64)
        self.context = mix(span_hash(self.sums, self.left, self.right) + shift * np.uint64(0x9E3779B1))

    # Second digit: which contexts has a smaller document, which grams have several contexts?

    def send_contexts(self, block: str) -> Iterator[pa.RecordBatch | None]:
        keys, least = least_by_key(self.context, self.order[self.doc])
        yield entries(CONTEXTS, block, bucket_edges(keys, self.buckets), keys, least)
        tag = (self.context >> np.uint64(32)).astype(np.int64)
        keys, low = least_by_key(self.key, tag)
        _, high = least_by_key(self.key, -tag)
        edges = bucket_edges(keys, self.buckets, _GRAM_BITS)
        yield entries(MIXED, block, edges, keys, low.astype(np.uint32), (-high).astype(np.uint32))

    def settle_contexts(self, contexts: list[tuple[int, bytes]], mixed: list[tuple[int, bytes]]) -> None:
        keys, place = np.unique(self.context, return_inverse=True)
        _, least = least_by_key(self.context, self.order[self.doc])
        known = gather_bits(contexts, bucket_edges(keys, self.buckets))[place]
        known |= self.order[self.doc] > least[place]
        cover = np.zeros(len(self.bytes) + 2, dtype=np.int32)
        np.add.at(cover, self.left[known], 1)
        np.add.at(cover, self.right[known] - self.window + 1, -1)
        self.removed |= np.cumsum(cover)[: len(self.removed)] > 0
        keys, place = np.unique(self.key, return_inverse=True)
        unsettled = gather_bits(mixed, bucket_edges(keys, self.buckets, _GRAM_BITS))[place] & ~known
        self._open_windows(self.at[unsettled])

    def _open_windows(self, anchors: np.ndarray) -> None:
        """The windows whose least gram is at one of ``anchors``."""
        starts = (anchors[:, None] - np.arange(self.reach + 1)).reshape(-1)
        gram = np.repeat(self.grams[anchors], self.reach + 1)
        inside = (starts >= 0) & (starts < len(self.least))
        starts, gram = starts[inside], gram[inside]
        self.open = np.unique(starts[self.least[starts] == gram])
        self.open_key = span_hash(self.sums, self.open, self.open + self.window)
        self.open_doc = self.order[np.searchsorted(self.ends, self.open, side="right")]

    # Last digit: which windows has a smaller document?

    def send_windows(self, block: str) -> Iterator[pa.RecordBatch | None]:
        keys, least = least_by_key(self.open_key, self.open_doc)
        yield entries(WINDOWS, block, bucket_edges(keys, self.buckets), keys, least)

    def settle_windows(self, bits: list[tuple[int, bytes]]) -> None:
        keys, place = np.unique(self.open_key, return_inverse=True)
        _, least = least_by_key(self.open_key, self.open_doc)
        known = gather_bits(bits, bucket_edges(keys, self.buckets))[place]
        known |= self.open_doc > least[place]
        self.removed[self.open[known]] = True

    def result(self, carried: bytes | None = None, carry: Sequence[str] = (), as_text: bool = False) -> pa.Table:
        n = len(self.bytes)
        starts = np.flatnonzero(self.removed[:n])
        cover = np.zeros(n + 1, dtype=np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, np.minimum(starts + self.window, n), -1)
        gone = np.cumsum(cover)[:n] > 0
        docs = []
        for doc_id, s, e in zip(self.doc_ids, self.begins.tolist(), self.ends.tolist(), strict=True):
            mask, data = gone[s:e], self.bytes[s:e]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])).astype(np.int8)))
            spans = [{"first": a, "last": b - 1} for a, b in edges.reshape(-1, 2).tolist()]
            kept = data[~mask].tobytes() if spans else data.tobytes()
            shown = kept.decode("utf-8", "ignore") if as_text else kept
            docs.append((doc_id, e - s, e - s - len(kept), spans, shown))
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), span, pa.string() if as_text else pa.binary()]
        columns = zip(*docs, strict=True)
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)] + carried_columns(carried),
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept", *carry],
        )


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    bucket_bytes: int = BUCKET_BYTES,
    carry: Sequence[str] = (),
    as_text: bool = False,
) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that a smaller document has too.

    A row for each row of ``docs``: ``n_bytes`` of the text in UTF-8,
    ``n_removed``, the removed ``spans`` (first and last byte of each maximal
    run) and the ``kept`` bytes.  Documents are compared by ``doc_id``; one
    without an id comes last, rows of the same id remove nothing from each
    other.  Strings are judged on the input and never cross documents.  Null,
    empty and short texts keep all they have.  Strings are compared by 64-bit
    hashes.  With ``as_text`` what is kept is text, without the parts of characters
    that were cut through; columns to ``carry`` come out with their rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = keep_bucketed(text_blocks(docs, carry=carry), parts)
    buckets = slices_for(total_bytes(kept), bucket_bytes)

    def radix(row: tuple) -> _Radix:
        doc_ids, sizes, texts = row
        return _Radix(doc_ids, unpack_block(sizes, texts), window, gram, buckets)

    def rows(table: pa.Table) -> Iterator[tuple]:
        return zip(*[table.column(c).to_pylist() for c in ("doc_ids", "sizes", "texts")], strict=True)

    def send(parts: Iterator[pa.RecordBatch | None]) -> pa.Table:
        found = [p for p in parts if p is not None]
        return pa.Table.from_batches(found) if found else _no_entries()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in zip(batch.column("block").to_pylist(), rows(batch), strict=True):
                yield from (b for b in radix(row).send_grams(block) if b is not None)

    def second(block: pa.Table, bits: pa.Table) -> pa.Table:
        out, known = [], bits_by_kind(bits)
        for name, row in zip(block.column("block").to_pylist(), rows(block), strict=True):
            state = radix(row)
            state.keep_repeated(known.get(GRAMS, []))
            out += state.send_contexts(name)
        return send(out)

    def third(block: pa.Table, bits: pa.Table) -> pa.Table:
        out, known = [], bits_by_kind(bits)
        for name, row in zip(block.column("block").to_pylist(), rows(block), strict=True):
            state = radix(row)
            state.keep_repeated(known.get(GRAMS, []))
            state.settle_contexts(known.get(CONTEXTS, []), known.get(MIXED, []))
            out += state.send_windows(name)
        return send(out)

    def last(block: pa.Table, bits: pa.Table) -> pa.Table:
        out, known = [], bits_by_kind(bits)
        for row, carried in zip(rows(block), block.column("carried").to_pylist(), strict=True):
            state = radix(row)
            state.keep_repeated(known.get(GRAMS, []))
            state.settle_contexts(known.get(CONTEXTS, []), known.get(MIXED, []))
            state.settle_windows(known.get(WINDOWS, []))
            out.append(state.result(carried, carry, as_text))
        return pa.concat_tables(out)

    def with_answers(answers: DataFrame, step, schema: str) -> DataFrame:
        return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean_cogroup(step), schema)

    grams = kept.select("block", "doc_ids", "sizes", "texts").mapInArrow(lean_map(first), ENTRIES)
    answers = store(answer(grams, RULES), "radix-grams")
    contexts = with_answers(answers, second, ENTRIES)
    answers = answers.unionByName(store(answer(contexts, RULES), "radix-contexts"))
    windows = with_answers(answers, third, ENTRIES)
    answers = answers.unionByName(store(answer(windows, RULES), "radix-windows"))
    shown = OUT.replace("kept binary", "kept string") if as_text else OUT
    return with_answers(answers, last, shown + carried_schema(docs, carry))


def _no_entries() -> pa.Table:
    text, binary = pa.string(), pa.binary()
    types = [pa.int32(), pa.int32(), text, binary, binary, binary]
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    return pa.table([pa.array([], t) for t in types], names=names)
