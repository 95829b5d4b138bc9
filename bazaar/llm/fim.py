"""Fill-in-middle: documents cut at line ends into prefix, middle and suffix, and put together anew.

A rolling hash cuts texts into chunks at places their content chooses, so that
copies of a passage fall into the same chunks wherever they stand.  A task keeps
a summary of each distinct chunk, found again by comparing the chunk's bytes: its
line ends, its code points, and whether it holds a marker.  Adding the summaries
of a text's chunks up tells its number of lines and the chunk a cut lies in; a
marker across a border shows in the bytes on both sides of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.shared import mix, pieces

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
SEED = 7

# A chunk ends where the hash of its last WINDOW bytes has _MEAN_BITS low bits of zero.
WINDOW = 32
_MEAN_BITS = 10
MOST_BYTES = 8 << 10
# Chunks a task remembers, in bytes; then it begins to remember anew.
MEMORY_BYTES = 48 << 20

_GEAR = mix(np.arange(1, 257, dtype=np.uint64))

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def chunk_ends(data: bytes, most: int = MOST_BYTES) -> list[int]:
    """Where the chunks of a text end; equal bytes around a place make equal choices."""
    if not data:
        return []
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    reach = 1
    while reach < WINDOW:  # each round doubles the bytes a hash is made of
        grown = h.copy()
        grown[reach:] += h[:-reach] << np.uint64(reach)
        h, reach = grown, 2 * reach
    # The window's own bits are the high ones of its last byte: low bits hear of few bytes.
    found = np.flatnonzero((h >> np.uint64(64 - _MEAN_BITS)) == 0)
    chosen = found[found >= WINDOW - 1] + 1
    ends, begin = [], 0
    for end in [*chosen.tolist(), len(data)]:
        while end - begin > most:
            begin += most
            ends.append(begin)
        if end > begin:
            ends.append(end)
            begin = end
    return ends


def _chars(data: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


@dataclass(frozen=True)
class Summary:
    """What the cut of a text needs to know of a chunk."""

    breaks: np.ndarray  # where its lines end, the line break included
    chars: int
    marked: bool

    @classmethod
    def of(cls, chunk: bytes) -> Summary:
        bytes_ = np.frombuffer(chunk, dtype=np.uint8)
        breaks = np.flatnonzero(bytes_ == 10).astype(np.int32) + 1
        return cls(breaks, _chars(chunk), any(m in chunk for m in MARKERS))


class Summaries(dict):
    """Summaries by content; forgets all when the chunks take more than ``limit`` bytes."""

    def __init__(self, limit: int = MEMORY_BYTES):
        super().__init__()
        self.limit, self.held = limit, 0

    def __missing__(self, chunk: bytes) -> Summary:
        if self.held > self.limit:
            self.clear()
            self.held = 0
        self[chunk] = made = Summary.of(chunk)
        self.held += len(chunk)
        return made


class Outline:
    """A text by its chunks: their ends, and their summaries added up."""

    def __init__(self, data: bytes, known: Summaries, most: int = MOST_BYTES):
        self.data = data
        self.ends = chunk_ends(data, most)
        self.begins = [0, *self.ends[:-1]][: len(self.ends)]
        self.parts, self.marked, before = [], False, b""
        for begin, end in zip(self.begins, self.ends, strict=True):
            chunk = data[begin:end]
            part = known[chunk]
            border = before + chunk[:2]
            self.marked = self.marked or part.marked or any(m in border for m in MARKERS)
            self.parts.append(part)
            before = (before + chunk[-2:])[-2:]
        self.breaks = np.cumsum([len(p.breaks) for p in self.parts]) if self.parts else np.zeros(0, dtype=np.int64)
        self.chars = np.cumsum([0, *[p.chars for p in self.parts]])

    @property
    def lines(self) -> int:
        whole = int(self.breaks[-1]) if self.parts else 0
        return whole + (bool(self.data) and not self.data.endswith(b"\n"))

    def cut_after(self, lines: int) -> tuple[int, int]:
        """The byte after so many lines, and the code points before it."""
        if lines == 0 or not self.parts:
            return 0, 0
        if lines > self.breaks[-1]:
            return len(self.data), int(self.chars[-1])
        at = int(np.searchsorted(self.breaks, lines))
        part = self.parts[at]
        inside = int(part.breaks[lines - 1 - (int(self.breaks[at]) - len(part.breaks))])
        begin = self.begins[at]
        return begin + inside, int(self.chars[at]) + _chars(self.data[begin : begin + inside])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 from the seed and the id."""
    shown = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(shown[i : i + 8], 16) for i in range(0, 32, 8)]


def _arranged(doc_id: int | None, data: bytes, known: Summaries, seed: int, rate: int, spm_rate: int) -> tuple:
    outline = Outline(data, known)
    n = outline.lines
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or outline.marked or h3 % 100 >= rate:
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (b, upto) = outline.cut_after(low), outline.cut_after(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", before, upto - before, b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return n, "psm", before, upto - before, b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """``doc_id, n`` (lines), ``form``, ``prefix_chars, middle_chars`` and the new text as ``output``.

    Of 100 documents about ``rate`` are rearranged, and of those ``spm_rate`` have
    the suffix first; which ones and where they are cut follows from seed and id
    alone, so reruns agree and repeated rows come out alike.  Null texts count as
    empty; an empty text, and one that holds a marker, stays plain.  A null id
    draws as an empty number.  A text is handled in pieces of a few kilobytes
    except for its output, so its length matters only for the row itself.  Other
    columns of ``docs``, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Summaries()
        for batch, texts in pieces(batches):
            made = [
                _arranged(doc_id, data, known, seed, rate, spm_rate)
                for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts, strict=True)
            ]
            n, form, before, middle, output = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form),
                    pa.array(before, pa.int64()), pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def restore(arranged: DataFrame) -> DataFrame:
    """Add ``restored``, the original text, from ``output`` and ``form`` alone."""
    parts = F.split("output", "<[PSM]>")
    # What the marks enclose, in the order it is written: psm has the suffix second, spm first.
    return arranged.withColumn(
        "restored",
        F.when(F.col("form") == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(F.col("form") == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.col("output")),
    )
