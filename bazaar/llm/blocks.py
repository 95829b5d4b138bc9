"""Texts packed into blocks, and questions about keys that blocks ask each other.

A block holds whole documents.  It sends its distinct keys, sorted and cut into
ranges; a task that gets one range from all blocks answers with a bit for each
key sent.  A block works its keys out again from its texts when the answer
comes, so neither documents nor positions travel with the keys, and a key costs
a block one entry however often it holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.shared import PIECE_BYTES, lean_group, lean_map, pack, pieces, slices_for, squeeze, unpack, unsqueeze
from bazaar.session import checkpoint_folder

BLOCKS = "block string, n_bytes long, doc_ids array<long>, sizes binary, texts binary, carried binary"
ENTRIES = "kind int, bucket int, block string, keys binary, a binary, b binary"
ANSWERS = "kind int, bucket int, block string, bits binary"
NO_ID = np.iinfo(np.int64).max

_NAMES = {schema: [c.split()[0] for c in schema.split(", ")] for schema in (BLOCKS, ENTRIES, ANSWERS)}


def text_blocks(
    docs: DataFrame, block_bytes: int = PIECE_BYTES, carry: Sequence[str] = ()
) -> DataFrame:
    """``docs`` as blocks of about ``block_bytes``; a longer document is a block of its own.

    The columns to ``carry`` are packed with the block, to come out with its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for made, (rows, texts) in enumerate(pieces(batches, size=block_bytes)):
            sizes = np.array([len(t) for t in texts], dtype=np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{made}"]), pa.array([int(sizes.sum())], pa.int64()),
                    pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([pack(sizes)], pa.binary()), pa.array([squeeze(b"".join(texts))], pa.binary()),
                    pa.array([_packed_rows(rows.select(list(carry))) if carry else None], pa.binary()),
                ],
                names=_NAMES[BLOCKS],
            )

    others = [c for c in carry if c != "text"]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others)
    return picked.mapInArrow(lean_map(run), BLOCKS)


def _packed_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return squeeze(sink.getvalue().to_pybytes())


def carried_columns(packed: bytes | None) -> list[pa.ChunkedArray]:
    if packed is None:
        return []
    return pa.ipc.open_stream(unsqueeze(packed)).read_all().columns


def carried_schema(docs: DataFrame, carry: Sequence[str]) -> str:
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)


def keep_bucketed(blocks: DataFrame, parts: int) -> DataFrame:
    """Store blocks as a table bucketed by block: joins to it shuffle the other side only."""
    name = f"text_blocks_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(blocks.sparkSession)}/{name}"
    dealt = blocks.repartition(parts, "block").write.bucketBy(parts, "block")
    dealt.option("compression", "uncompressed").option("path", path).saveAsTable(name)
    return blocks.sparkSession.table(name)


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_bytes")).first()[0] or 0


def unpack_block(sizes: bytes, texts: bytes) -> list[bytes]:
    data, at, out = unsqueeze(texts), 0, []
    for size in unpack(sizes, np.uint32).tolist():
        out.append(data[at : at + size])
        at += size
    return out


def doc_order(doc_ids: list[int | None]) -> np.ndarray:
    """Ids to compare documents by; those without an id come last."""
    return np.array([NO_ID if i is None else i for i in doc_ids], dtype=np.int64)


def least_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the least value of each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(keys)])
    least = np.minimum.reduceat(values[order], first) if len(first) else values[:0]
    return ordered[first], least


def bucket_edges(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each of ``buckets`` even ranges of keys begins in sorted ``keys``, and their end."""
    borders = [(i << bits) // buckets for i in range(1, buckets)]
    inner = np.searchsorted(keys, np.array(borders, dtype=np.uint64))
    return np.concatenate(([0], inner, [len(keys)])).astype(np.int64)


def entries(
    kind: int, block: str, edges: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None = None
) -> pa.RecordBatch | None:
    """What a block sends of distinct ``keys``, in buckets cut at ``edges`` and sorted
    within them, with values ``a`` and ``b``."""
    spans = [(i, s, e) for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if e > s]
    if not spans:
        return None
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(spans), pa.int32()), pa.array([i for i, _, _ in spans], pa.int32()),
            pa.array([block] * len(spans)), pa.array([pack(keys[s:e]) for _, s, e in spans], pa.binary()),
            pa.array([pack(a[s:e]) for _, s, e in spans], pa.binary()),
            pa.array([pack(b[s:e]) if b is not None else None for _, s, e in spans], pa.binary()),
        ],
        names=_NAMES[ENTRIES],
    )


def gather_bits(rows: list[tuple[int, bytes]], edges: np.ndarray) -> np.ndarray:
    """The answered bit of each key a block has sent, in the order it was sent."""
    out = np.zeros(int(edges[-1]), dtype=bool)
    for bucket, data in rows:
        s, e = int(edges[bucket]), int(edges[bucket + 1])
        out[s:e] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=e - s).astype(bool)
    return out


# Per kind of question: the types of a and b, and the answer to all entries of a
# range sorted by key; ``first`` is where each key begins, ``group`` its number by entry.
Rule = Callable[[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray], np.ndarray]


def held_twice(a: np.ndarray, b: np.ndarray | None, first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Is the key in two documents or places?  ``a`` counts them in a block, from 1 to 2."""
    return (np.add.reduceat(a.astype(np.int64), first) > 1)[group]


def held_earlier(a: np.ndarray, b: np.ndarray | None, first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Has another block the key in a smaller document?  ``a`` is the smallest of a block."""
    return np.minimum.reduceat(a, first)[group] < a


def differs(a: np.ndarray, b: np.ndarray | None, first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Has the key more than one value?  ``a`` and ``b`` are a block's least and largest."""
    return (np.minimum.reduceat(a, first) != np.maximum.reduceat(b, first))[group]


def answer(sent: DataFrame, rules: dict[int, tuple[type, type, Rule]]) -> DataFrame:
    """A bit for every key of ``sent``, by the rule of its kind."""

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        of_a, of_b, rule = rules[kind]
        keys = [unpack(k) for k in table.column("keys").to_pylist()]
        sizes = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        a = np.concatenate([unpack(x, of_a) for x in table.column("a").to_pylist()])
        b = None
        if table.column("b").null_count < len(table):
            b = np.concatenate([unpack(x, of_b) for x in table.column("b").to_pylist()])
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        begins = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        found = np.zeros(len(key), dtype=bool)
        found[order] = rule(
            a[order], b[order] if b is not None else None, np.flatnonzero(begins), np.cumsum(begins) - 1
        )
        ends = np.cumsum(sizes)
        bits = [np.packbits(found[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
        n = len(bits)
        return pa.table(
            [
                pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()),
                table.column("block"), pa.array(bits, pa.binary()),
            ],
            names=_NAMES[ANSWERS],
        )

    return sent.groupBy("kind", "bucket").applyInArrow(lean_group(run), ANSWERS)


def bits_by_kind(answers: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list[tuple[int, bytes]]] = {}
    columns = [answers.column(c).to_pylist() for c in ("kind", "bucket", "bits")]
    for kind, bucket, bits in zip(*columns, strict=True):
        out.setdefault(kind, []).append((bucket, bits))
    return out


def add_up(parts: DataFrame, fan_in: int = 64) -> dict[int, np.ndarray]:
    """Sums of count tables (``part, name, counts``): one for each name, in levels of ``fan_in``.

    Tables have a fixed size, so no task of any level holds more than ``fan_in`` of a name.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table(
            [table.column("part").slice(0, 1), table.column("name").slice(0, 1), pa.array([pack(total)], pa.binary())],
            names=["part", "name", "counts"],
        )

    left = parts.rdd.getNumPartitions()
    while left > 1:
        fewer = parts.withColumn("part", F.floor(F.col("part") / fan_in))
        parts = fewer.groupBy("part", "name").applyInArrow(lean_group(add), parts.schema)
        left = slices_for(left, fan_in)
    return {r["name"]: unpack(bytes(r["counts"]), np.int64) for r in parts.collect()}
