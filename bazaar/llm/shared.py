"""What several operators need: stored tables, pieces of text, words and hashes as arrays."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.session import checkpoint_folder

# Text handled at once within a task; a longer document is a piece of its own.
PIECE_BYTES = 2 << 20

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WHITESPACE = np.zeros(256, dtype=bool)  # a word is [^\x20\x09-\x0D]+
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALNUM = np.zeros(256, dtype=bool)  # a word is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, by: str, parts: int) -> DataFrame:
    """The same as a table in ``parts`` buckets of ``by``: groups, windows and joins by it shuffle no row of it.

    Each task writes a file for every bucket it has rows of.
    """
    table = f"{name}-{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(df.sparkSession)}/{table}"
    written = df.write.format("parquet").option("compression", "zstd").bucketBy(parts, by).option("path", path)
    table = table.replace("-", "_")
    written.saveAsTable(table)
    return df.sparkSession.table(table)


def discard(stored: DataFrame) -> None:
    """Remove a table written by ``store``, once all that is made from it is stored as well."""
    files = stored.inputFiles()
    if files:
        jvm, conf = stored.sparkSession._jvm, stored.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id never does."""
    left = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(left == 2, F.lit(False))


def slices_for(rows: int, per_slice: int) -> int:
    """How many slices keep each at about ``per_slice`` rows or bytes."""
    return max(1, -(-rows // per_slice))


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces(
    batches: Iterable[pa.RecordBatch], text: str = "text", size: int = PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into runs of rows whose texts have about ``size`` bytes together."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < len(batch):
            until = size + (int(ends[begin - 1]) if begin else 0)
            stop = max(begin + 1, int(np.searchsorted(ends, until, side="right")))
            rows = batch.slice(begin, stop - begin)
            yield rows, encoded(rows.column(text))
            begin = stop
    _give_back()


def _give_back() -> None:
    """Return freed memory to the machine: workers live on, and those idle should not hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean_map(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` for ``mapInArrow``, returning memory once all it held is freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        _give_back()

    return run


def lean_group(step: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a step on each group."""

    def run(table: pa.Table) -> pa.Table:
        out = step(table)
        _give_back()
        return out

    return run


def lean_cogroup(step: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a step on each pair of groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = step(left, right)
        _give_back()
        return out

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n-1, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        grown = np.full(max(n, PIECE_BYTES + 4096), base, dtype=np.uint64)
        grown[0] = 1
        _powers[base] = known = np.cumprod(grown, dtype=np.uint64)
    return known[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span of ``values``."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    terms = (values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(values))
    np.cumsum(terms, dtype=np.uint64, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal wherever the spans hold equal values."""
    h = (sums[end] - sums[start]) * powers(_BASE_INVERSE, len(sums))[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(_ODD))


def window_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of every window of ``size`` values, in order."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = (sums[size:] - sums[:n]) * powers(_BASE_INVERSE, n)
    return mix(h + np.uint64(size * _ODD % (1 << 64)))


# Words of more bytes are hashed one by one.
_LONG_WORD = 256


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, eight bytes at a time, each mixed in before the next.

    Unlike sums of powers, which any two words of the same pattern of letters can
    share, this has no words that meet by construction.
    """
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    at_byte = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = (end - start).astype(np.int64)
    h = mix(size.astype(np.uint64) * np.uint64(_ODD) + np.uint64(_BASE))
    left = np.flatnonzero(size <= _LONG_WORD)
    lane = 0
    while len(left := left[size[left] > lane]):
        value = at_byte[start[left] + lane]
        rest = np.minimum(size[left] - lane, 8).astype(np.uint64)
        value = value & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - rest) * np.uint64(8)))
        h[left] = mix((h[left] ^ value) * np.uint64(_ODD) + np.uint64(lane + 1))
        lane += 8
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


class Words:
    """The words of several texts: spans in one buffer, and the text each is from."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = WHITESPACE, lower: bool = False):
        buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        self.bytes = LOWER[buffer] if lower else buffer
        inside = np.zeros(len(buffer) + 2, dtype=np.int8)
        inside[1:-1] = ~separators[self.bytes]
        edges = np.diff(inside)
        self.start = np.flatnonzero(edges == 1)
        self.end = np.flatnonzero(edges == -1)
        self.text_end = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
        # first[i] is the number of the first word of text i; one more entry closes the last.
        self.first = np.concatenate(([0], np.searchsorted(self.start, self.text_end)))

    def hashes(self) -> np.ndarray:
        return word_hashes(self.bytes, self.start, self.end)


@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _compressor().compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _decompressor().decompress(data)


def pack(values: np.ndarray) -> bytes:
    """An integer array, by byte planes: leading bytes of sorted values cost next to nothing."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(len(flat), flat.itemsize).T
    return squeeze(np.ascontiguousarray(planes).tobytes()) if len(flat) else b""


def unpack(data: bytes, dtype: type = np.uint64) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
