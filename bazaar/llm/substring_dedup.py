"""Substring dedup over words with prefix-partitioned suffix trees.

A suffix begins at every word.  Prefixes of different lengths, each long enough
that few suffixes share it, split the suffixes into groups that fit in memory.
A group becomes the part of the suffix tree below its prefix.  Only nodes as deep as
the window matter: one with two leaves below it is a repeated window, and
neighbouring repeated windows run together to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from bazaar.llm.blocks import (
    ENTRIES, add_up, answer, bits_by_kind, entries, gather_bits, held_twice, text_blocks, total_bytes,
    unpack_block,
)
from bazaar.llm.shared import Words, mix, pack, prefix_sums, slices_for, store, window_hash

WINDOW = 35
# Suffixes a group should have at most, unless its prefix is already a whole window.
GROUP_SUFFIXES = 400_000
_DEPTHS = (1, 2, 4, 8, 16)
_BYTES_PER_WORD = 6

OUT = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept string"


class _Suffixes:
    """The suffixes of a block that have a whole window, and their prefixes."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = Words(texts)
        self.window = window
        self.sums = prefix_sums(self.words.hashes())
        n = len(self.words.start)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.words.first))
        self.at = np.flatnonzero(self.words.first[doc + 1] - np.arange(n) >= window)

    def prefix(self, depth: int) -> np.ndarray:
        return window_hash(self.sums, depth)[self.at] if len(self.at) else np.zeros(0, dtype=np.uint64)

    def bucket(self, splits: dict[int, np.ndarray], buckets: int) -> np.ndarray:
        """The bucket of each suffix's group; small groups share buckets.

        A suffix belongs to its shortest prefix that is not split further.
        """
        group = np.zeros(len(self.at), dtype=np.uint64)
        still = np.ones(len(self.at), dtype=bool)
        for depth in _depths(self.window):
            prefix = self.prefix(depth)
            group = np.where(still, prefix, group)
            if depth in splits:
                still &= splits[depth][_slot(prefix, len(splits[depth]))]
        return ((mix(group) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def windows(self, splits: dict[int, np.ndarray], buckets: int) -> tuple[np.ndarray, ...]:
        """Distinct windows by bucket and hash: (hash, times, edges of buckets, place of each suffix)."""
        keys, at, place, times = np.unique(
            self.prefix(self.window), return_index=True, return_inverse=True, return_counts=True
        )
        bucket = self.bucket(splits, buckets)[at]
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return keys[order], times[order], edges, rank[place]


def _depths(window: int) -> list[int]:
    return [d for d in _DEPTHS if d < window] + [window]


def _slot(prefix: np.ndarray, slots: int) -> np.ndarray:
    return (prefix >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def _count_prefixes(blocks: DataFrame, window: int, slots: int) -> dict[int, np.ndarray]:
    """How many suffixes have a prefix in each of ``slots`` ranges of prefix hashes, by depth."""
    depths = _depths(window)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {d: np.zeros(slots, dtype=np.int64) for d in depths}
        for batch in batches:
            for sizes, texts in zip(*[batch.column(c).to_pylist() for c in ("sizes", "texts")], strict=True):
                suffixes = _Suffixes(unpack_block(sizes, texts), window)
                for d in depths:
                    counts[d] += np.bincount(_slot(suffixes.prefix(d), slots), minlength=slots)
        part = [TaskContext.get().partitionId()] * len(depths)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(depths), pa.array([pack(counts[d]) for d in depths], pa.binary())],
            names=["part", "name", "counts"],
        )

    return add_up(blocks.select("sizes", "texts").mapInArrow(run, "part long, name long, counts binary"))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES
) -> DataFrame:
    """Remove every word covered by a window of words that stands anywhere else.

    A row for each row of ``docs``: ``n_words``, ``n_removed``, the removed
    ``spans`` (first and last word of each maximal run, from 0) and the ``kept``
    words joined by one space.  All copies of a window go, the first as well, and
    windows are judged on the input.  A null, empty or short text has nothing
    removed; repeated rows are copies of each other.  Windows are compared by 64-bit
    hashes of their words.
    """
    blocks = store(text_blocks(docs), "word-blocks")
    suffixes = total_bytes(blocks) // _BYTES_PER_WORD
    groups = slices_for(suffixes, group_suffixes)
    slots = max(1 << 10, 1 << (4 * groups - 1).bit_length())
    # A prefix is split where its slot alone would be a group too large.
    splits = {d: c > group_suffixes for d, c in _count_prefixes(blocks, window, slots).items()}
    sent = _send(blocks, window, splits, groups)
    answers = answer(sent, {0: (np.uint8, np.uint8, held_twice)})
    return _cut_out(blocks, answers, window, splits, groups)


def _send(blocks: DataFrame, window: int, splits: dict[int, np.ndarray], buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "sizes", "texts")]
            for block, sizes, texts in zip(*columns, strict=True):
                keys, times, edges, _ = _Suffixes(unpack_block(sizes, texts), window).windows(splits, buckets)
                out = entries(0, block, edges, keys, np.minimum(times, 2).astype(np.uint8))
                if out is not None:
                    yield out

    return blocks.select("block", "sizes", "texts").mapInArrow(run, ENTRIES)


def _cut_out(
    blocks: DataFrame, answers: DataFrame, window: int, splits: dict[int, np.ndarray], buckets: int
) -> DataFrame:
    def run(block: pa.Table, bits: pa.Table) -> pa.Table:
        columns = [block.column(c).to_pylist() for c in ("doc_ids", "sizes", "texts")]
        parts = []
        for doc_ids, sizes, texts in zip(*columns, strict=True):
            suffixes = _Suffixes(unpack_block(sizes, texts), window)
            _, _, edges, place = suffixes.windows(splits, buckets)
            repeated = gather_bits(bits_by_kind(bits).get(0, []), edges)[place]
            parts.append(_without(suffixes, suffixes.at[repeated], doc_ids))
        return pa.concat_tables(parts)

    together = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return together.applyInArrow(run, OUT)


def _without(suffixes: _Suffixes, starts: np.ndarray, doc_ids: list) -> pa.Table:
    """The documents of a block without the words of the windows that begin at ``starts``."""
    words, n = suffixes.words, len(suffixes.words.start)
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + suffixes.window, -1)
    removed = np.cumsum(cover)[:n] > 0
    n_words = np.diff(words.first)
    so_far = np.concatenate(([0], np.cumsum(removed)))
    # Runs end at the borders of documents as well.
    opens = removed & np.concatenate(([True], ~removed[:-1]))[:n]
    closes = removed & np.concatenate((~removed[1:], [True]))[:n]
    borders = words.first[1:-1]
    inner = borders[(borders > 0) & (borders < n)]
    opens[inner] |= removed[inner]
    closes[inner - 1] |= removed[inner - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    offset = np.searchsorted(first, words.first)
    base = np.repeat(words.first[:-1], np.diff(offset))
    spans = pa.ListArray.from_arrays(
        pa.array(offset.astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], names=["first", "last"]),
    )
    return pa.table(
        [
            pa.array(doc_ids, pa.int64()), pa.array(n_words, pa.int64()),
            pa.array(np.diff(so_far[words.first]), pa.int64()), spans, _joined(words, ~removed),
        ],
        names=["doc_id", "n_words", "n_removed", "spans", "kept"],
    )


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, one space between them."""
    data = np.append(words.bytes, np.uint8(0x20))
    start, end = words.start[keep], words.end[keep]
    data[end] = 0x20
    taken = np.zeros(len(data) + 1, dtype=np.int8)
    taken[start] += 1
    taken[end + 1] -= 1
    mask = np.cumsum(taken, dtype=np.int8)[: len(data)] > 0
    flat = data[mask].tobytes()
    before = np.concatenate(([0], np.cumsum(end + 1 - start)))
    kept_before = np.concatenate(([0], np.cumsum(keep)))[words.first]
    edge = before[kept_before].tolist()
    return pa.array([flat[s : max(s, e - 1)].decode() for s, e in zip(edge[:-1], edge[1:], strict=True)], pa.string())
