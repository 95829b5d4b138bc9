"""Byte-level BPE: texts to token ids and back.

Texts are cut into pre-tokens and written as blocks of numbers: a block numbers
its distinct pre-tokens by falling frequency and keeps every document as the
numbers at its positions.  Only the distinct words of each block are shuffled,
dealt out by a hash of the word, so that each distinct word of the corpus is
encoded in one place, once.  Its ids return to the blocks that hold it, which
put their documents together again by position.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.shared import encoded, lean_cogroup, lean_group, lean_map, pack, squeeze, store, unpack, unsqueeze

# Where a block ends: distinct words, and pre-tokens, it holds.  Its documents are
# kept in runs of about so many pre-tokens.
BLOCK_WORDS = 400_000
BLOCK_TOKENS = 6_000_000
RUN_TOKENS = 500_000


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: on each line a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


@cache
def token_table(path: str) -> list[bytes]:
    """The bytes of every token by id; ids without a token have none."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge neighbours of lowest rank, leftmost first, until none can be merged."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pairs):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at > 0:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for words of many bytes: places wait in a queue ordered by rank."""
    n = len(word)
    end = list(range(1, n + 1))  # where the part that begins here ends; 0 once merged away
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(word[j:stop])) is not None:
            heapq.heappush(queue, (r, j, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


_BLOCKS = "block string, bucket int, doc_ids array<long>, sizes binary, numbers binary, words binary"


class _Block:
    """Documents as numbers of words, until the block is full."""

    def __init__(self, name: str, buckets: int, most: int):
        self.name, self.buckets, self.most = name, buckets, most
        self.numbers, self.codes, self.doc_ids = _Numbers(), [], []
        self.tokens = 0

    def add(self, doc_id: int | None, words: list[str]) -> None:
        known = self.numbers
        self.codes.append(np.array([known[w] for w in words], dtype=np.uint32))
        self.doc_ids.append(doc_id)
        self.tokens += len(words)

    def full(self) -> bool:
        return len(self.numbers) >= BLOCK_WORDS or self.tokens >= self.most

    def rows(self) -> Iterator[pa.RecordBatch]:
        """First the words by bucket, then the documents in runs.

        The word at place p of bucket b has the number p * buckets + b: nothing
        but the order of the words tells it, and frequent words have small ones.
        """
        often = np.argsort(-np.bincount(np.concatenate(self.codes), minlength=len(self.numbers)), kind="stable")
        number = np.empty(len(often), dtype=np.uint32)
        dealt: list[list[bytes]] = [[] for _ in range(self.buckets)]
        words = [w.encode() for w in self.numbers]
        for i in often.tolist():
            bucket = zlib.crc32(words[i]) % self.buckets
            number[i] = len(dealt[bucket]) * self.buckets + bucket
            dealt[bucket].append(words[i])
        for bucket, held in enumerate(dealt):
            if held:
                sizes = pack(np.array([len(w) for w in held], dtype=np.uint32))
                yield self._row(bucket, None, sizes, None, squeeze(b"".join(held)))
        begin = tokens = 0
        for i, codes in enumerate(self.codes):
            tokens += len(codes)
            if tokens >= RUN_TOKENS or i == len(self.codes) - 1:
                run = self.codes[begin : i + 1]
                sizes = pack(np.array([len(c) for c in run], dtype=np.uint32))
                yield self._row(-1, self.doc_ids[begin : i + 1], sizes, pack(number[np.concatenate(run)]), None)
                begin, tokens = i + 1, 0

    def _row(self, bucket: int, doc_ids, sizes: bytes, numbers: bytes | None, words: bytes | None):
        columns = [
            pa.array([self.name]), pa.array([bucket], pa.int32()),
            pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.binary()),
            pa.array([numbers], pa.binary()), pa.array([words], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCKS.split(", ")])


def _to_blocks(docs: DataFrame, pattern: str, buckets: int, most: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        task, made = TaskContext.get().partitionId(), 0
        block = _Block(f"{task}-{made}", buckets, most)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, encoded(batch.column("text")), strict=True):
                block.add(doc_id, find(text.decode()))
                if block.full():
                    yield from block.rows()
                    made += 1
                    block = _Block(f"{task}-{made}", buckets, most)
        if block.doc_ids:
            yield from block.rows()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(lean_map(cut), _BLOCKS)


def _encode_words(words: DataFrame, path: str) -> DataFrame:
    """The ids of the words of each block and bucket; equal words meet and are encoded once."""

    def encode(table: pa.Table) -> pa.Table:
        ranks, known = load_ranks(path), {}
        out: list[tuple] = []
        for block, bucket, sizes, held in zip(
            *[table.column(c).to_pylist() for c in ("block", "bucket", "sizes", "words")], strict=True
        ):
            data, at, ids, lengths = unsqueeze(held), 0, [], []
            for size in unpack(sizes, np.uint32).tolist():
                word = data[at : at + size]
                at += size
                found = known.get(word)
                if found is None:
                    known[word] = found = tuple((encode_word if size < 64 else _encode_long)(word, ranks))
                ids += found
                lengths.append(len(found))
            out.append((block, bucket, pack(np.array(lengths, dtype=np.uint32)), pack(np.array(ids, dtype=np.uint32))))
        columns = list(zip(*out, strict=True))
        names = ["block", "bucket", "lengths", "ids"]
        types = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    picked = words.select("bucket", "block", "sizes", "words")
    return picked.groupBy("bucket").applyInArrow(
        lean_group(encode), "block string, bucket int, lengths binary, ids binary"
    )


def _reassemble(blocks: pa.Table, words: pa.Table, buckets: int) -> pa.Table:
    """Every position's word becomes its ids; a document's positions stay in order."""
    number, length, flat = ([np.zeros(0, dtype=t)] for t in (np.int64, np.int64, np.int32))
    for bucket, lengths, ids in zip(*[words.column(c).to_pylist() for c in ("bucket", "lengths", "ids")], strict=True):
        length.append(unpack(lengths, np.uint32).astype(np.int64))
        number.append(np.arange(len(length[-1])) * buckets + bucket)
        flat.append(unpack(ids, np.uint32).astype(np.int32))
    number, length, flat = (np.concatenate(x) for x in (number, length, flat))
    size, begin = (np.zeros(number.max(initial=-1) + 1, dtype=np.int64) for _ in range(2))
    size[number] = length
    begin[number] = np.cumsum(length) - length
    doc_ids, offsets, found, held = [], [np.zeros(1, dtype=np.int64)], [], 0
    for row_ids, row_sizes, row_codes in zip(
        *[blocks.column(c).to_pylist() for c in ("doc_ids", "sizes", "numbers")], strict=True
    ):
        codes = unpack(row_codes, np.uint32)
        many = size[codes]
        ends = np.cumsum(many)
        place = np.repeat(begin[codes] - (ends - many), many) + np.arange(many.sum())
        found.append(flat[place])
        doc_ends = np.cumsum(unpack(row_sizes, np.uint32).astype(np.int64))
        offsets.append(np.concatenate(([0], ends))[doc_ends] + held)
        held += len(place)
        doc_ids += row_ids
    values = pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *found]))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), values)
    return pa.table([pa.array(doc_ids, pa.int64()), lists], names=["doc_id", "ids"])


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, buckets: int | None = None, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """``doc_id`` and token ``ids`` of every text, in a row for each row of ``docs``.

    ``vocabulary`` is the path of a file of ranks that every machine has,
    ``pattern`` cuts texts into pre-tokens.  Null and empty texts have no ids.
    Repeated rows stay repeated.  Words are dealt out to ``buckets``, by default
    as many as the session has shuffle partitions.  A block ends at ``block_tokens``
    pre-tokens: smaller ones take less memory, and send more words.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = store(_to_blocks(docs, pattern, buckets, block_tokens), "bpe-blocks")
    ids = _encode_words(blocks.where(F.col("bucket") >= 0), vocabulary)
    held = blocks.where(F.col("bucket") < 0).select("block", "doc_ids", "sizes", "numbers")
    together = held.groupBy("block").cogroup(ids.groupBy("block"))
    return together.applyInArrow(
        lean_cogroup(lambda runs, words: _reassemble(runs, words, buckets)), "doc_id long, ids array<int>"
    )


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def decode(encoded_docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and the ``bytes`` its ``ids`` stand for, by the table of token bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(vocabulary)
        for batch in batches:
            data = [decode_ids(i or [], table) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"]
            )

    return encoded_docs.select("doc_id", "ids").mapInArrow(lean_map(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, n_tokens`` and the digests of the ids and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(vocabulary)
        shown = [str(i).encode() for i in range(len(table))]
        for batch in batches:
            lists = batch.column("ids")
            count, of_ids, of_bytes = [], [], []
            for i in range(len(lists)):
                ids = lists[i].values.to_numpy().tolist()
                count.append(len(ids))
                of_ids.append(hashlib.sha256(b" ".join([shown[x] for x in ids])).hexdigest())
                of_bytes.append(hashlib.sha256(decode_ids(ids, table)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encode(docs, vocabulary, pattern, block_tokens=block_tokens).mapInArrow(
        lean_map(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
