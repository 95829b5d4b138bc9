"""CSV records that may run over several lines, read from files cut anywhere.

Whether a line break ends a record depends on the quotes before it, back to the
begin of the file.  A first reading finds out, for each split and without knowing
what came before, how it would end if it began between records and if it began
inside quotes.  Chaining these answers along a file tells how every split really
begins.  In a second reading each split then skips to its first true record, and
parses; a record that crosses splits is put together from its pieces.

Lines are cut at line feeds, and quotes, commas and line ends are bytes that no
character of the known charsets contains, so all this works before decoding.
Splits are Spark's own, so any file system it reads will do.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Records of about so many bytes are parsed at once.
_PARSE_BYTES = 1 << 20
_BOM = b"\xef\xbb\xbf"

# Whole fields from the begin of one on: quoted (anything may follow the closing
# quote), bare, or empty, each up to a comma, a carriage return, or the end.
_FIELDS = re.compile(rb'(?:(?:"(?:[^"]|"")*+"[^,\r]*+|[^",\r][^,\r]*+)?(?:,|\r|$))*+')
# What is left of a quoted field the line begins in.
_CLOSING = re.compile(rb'(?:[^"]|"")*+"[^,\r]*+(?:,|\r|$)')

_SURVEY = (
    "path string, start long, open_if_closed boolean, open_if_open boolean, broken_if_closed boolean, "
    "broken_if_open boolean, closes_if_open boolean, first binary, failed array<string>"
)


def ends_open(line: bytes, is_open: bool) -> bool:
    """Is a quote open at the end of a line, if one is or is none at its begin?"""
    if b'"' not in line:
        return is_open
    at = 0
    if is_open:
        closed = _CLOSING.match(line)
        if closed is None:
            return True
        at = closed.end()
    return _FIELDS.match(line, at).end() < len(line)


def _lines(spark: SparkSession, uri: str) -> DataFrame:
    """Every line with the file and the split it is from."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        # Both readings must see the same splits, also if executors come or go between them.
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    where = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_block_start", "start"))]
    return spark.read.option("lineSep", "\n").text(uri).select(F.col("value").cast("binary").alias("line"), *where)


Key = tuple[str, int]


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Key, Iterator[list[bytes]]]]:
    """The lines of each split in turn, some at a time; a split's lines come together and in order."""

    def runs() -> Iterator[tuple[Key, list[bytes]]]:
        for batch in batches:
            if not len(batch):
                continue
            start, paths = batch.column("start").to_numpy(), batch.column("path").dictionary_encode()
            path, lines = paths.indices.to_numpy(), batch.column("line").to_pylist()
            changes = np.flatnonzero((start[1:] != start[:-1]) | (path[1:] != path[:-1])) + 1
            for i, j in zip([0, *changes.tolist()], [*changes.tolist(), len(lines)], strict=True):
                yield (paths.dictionary[path[i]].as_py(), int(start[i])), lines[i:j]

    for key, found in groupby(runs(), key=lambda run: run[0]):
        yield key, (lines for _, lines in found)


@dataclass
class Survey:
    """What a first reading tells of a CSV: its charset and header, and how its splits begin."""

    charset: str
    names: list[str]
    # Whether each split, by file and place, begins inside quotes.
    opens: dict[Key, bool] = field(default_factory=dict)
    # Splits a record runs out of, or into: the split its record begins in.
    crossing: dict[Key, int] = field(default_factory=dict)
    broken: bool = False  # has any record a line break in quotes?


class _Look:
    """One split under one assumption about how it begins."""

    def __init__(self, is_open: bool):
        self.open = self.broken = is_open
        self.closes = not is_open

    def see(self, lines: list[bytes], quoted: bool) -> None:
        for line in lines if quoted else lines[:1]:
            self.open = ends_open(line, self.open)
            self.broken = self.broken or self.open
            self.closes = self.closes or not self.open


def _survey_split(runs: Iterator[list[bytes]], at_begin: bool, chain: list[str]) -> tuple:
    closed, opened, left = _Look(False), _Look(True), list(chain)
    first: list[bytes] | None = [] if at_begin else None
    header = None
    for lines in runs:
        data = b"\n".join(lines)
        for look in (closed, opened):
            look.see(lines, b'"' in data)
        is_open = False
        for line in lines if first is not None else ():
            first.append(line)
            is_open = ends_open(line, is_open if len(first) > 1 else False)
            if not is_open:
                header, first = b"\n".join(first), None
                break
        for charset in list(left):
            try:
                data.decode(charset)
            except UnicodeDecodeError:
                left.remove(charset)
    failed = [c for c in chain if c not in left]
    return closed.open, opened.open, closed.broken, opened.broken, opened.closes, header, failed


def decodable(chain: list[str], failed: set[str], uri: str) -> str:
    """The first charset that has not failed."""
    for charset in chain:
        if charset not in failed:
            return "UTF-8" if charset.lower().replace("-", "") == "utf8" else charset
    raise ValueError(f"none of {chain} can decode {uri}")


def survey(spark: SparkSession, uri: str, preferred: str | None = None) -> Survey:
    """Read a CSV once, to learn what ``scan_records`` must know.

    The charset is ``preferred`` if it can decode the data, else UTF-8, else GB18030;
    else it is an error.  The driver gets one row for each split, as it has planned
    one itself.
    """
    chain = list(dict.fromkeys([*([preferred] if preferred else []), "UTF-8", "GB18030"]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SURVEY.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 5, pa.binary(), pa.list_(pa.string())]
        for (path, start), runs in _by_split(batches):
            row = (path, start, *_survey_split(runs, start == 0, chain))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names
            )

    found = sorted(_lines(spark, uri).mapInArrow(look, _SURVEY).collect(), key=lambda r: (r["path"], r["start"]))
    failed = {c for r in found for c in r["failed"]}
    charset = decodable(chain, failed, uri)
    if not found:
        raise ValueError(f"{uri} has no lines")
    for r in found:
        if r["start"] == 0 and r["first"] is None:
            raise ValueError(f"the header of {r['path']} does not end within its first split")
    known = Survey(charset, next(iter(_records([bytes(found[0]["first"])], charset)), []))
    for path, splits in groupby(found, key=lambda r: r["path"]):
        is_open, origin = False, 0
        for r in splits:
            key = (path, r["start"])
            known.opens[key] = is_open
            leaves = r["open_if_open"] if is_open else r["open_if_closed"]
            known.broken = known.broken or (r["broken_if_open"] if is_open else r["broken_if_closed"])
            if is_open:
                known.crossing[key] = origin
            # A record that still goes on at the end began here, unless it runs through the whole split.
            if leaves and not (is_open and not r["closes_if_open"]):
                origin = r["start"]
                known.crossing.setdefault(key, origin)
            is_open = leaves
    return known


def _records(texts: Iterable[bytes], charset: str) -> Iterator[list[str]]:
    """Fields of the records of whole runs of text; blank lines are none."""
    for text in texts:
        data = text.removeprefix(_BOM).decode(charset)
        for row in csv.reader(io.StringIO(data, newline="")):
            if row and not (len(row) == 1 and not row[0].strip()):
                yield row


def _arrays(rows: list[list[str]], width: int) -> list[pa.Array]:
    """Rows as columns: longer ones are left out, shorter ones padded."""
    kept = [r + [None] * (width - len(r)) for r in rows if len(r) <= width]
    return [pa.array(c, pa.string()) for c in zip(*kept, strict=True)] if kept else [pa.array([], pa.string())] * width


def _split_records(runs: Iterator[list[bytes]], is_open: bool, at_begin: bool) -> Iterator[bytes]:
    """Text of the records that begin and end in a split, in runs; the header is left out."""
    held, done, size = [], 0, 0  # of the lines held, those done belong to whole records
    inside = is_open  # a record that began before?
    for lines in runs:
        if not (is_open or inside or at_begin) and b'"' not in b"".join(lines):
            held += lines
            done, size = len(held), size + sum(map(len, lines))
        else:
            for line in lines:
                is_open = ends_open(line, is_open)
                if inside:
                    inside = is_open
                    continue
                held.append(line)
                size += len(line)
                if is_open:
                    continue
                done = len(held)
                if at_begin:
                    held, done, size, at_begin = [], 0, 0, False
        if done and size >= _PARSE_BYTES:
            yield b"\n".join(held[:done])
            held = held[done:]
            done, size = 0, sum(map(len, held))
    if done:
        yield b"\n".join(held[:done])


def _pieces(runs: Iterator[list[bytes]], key: Key, is_open: bool, origin: int) -> Iterator[tuple[int, bytes]]:
    """What a split holds of records that cross its borders: where each began, and the text."""
    held, tail = [], is_open
    for lines in runs:
        for line in lines:
            held.append(line)
            is_open = ends_open(line, is_open)
            if not is_open:
                if tail:
                    yield origin, b"\n".join(held)
                held, tail = [], False
    if held:
        yield (origin if tail else key[1]), b"\n".join(held)


def scan_records(spark: SparkSession, uri: str, known: Survey) -> DataFrame:
    """The rows of a CSV as text columns; records may have line breaks inside quotes."""
    names, charset, opens, crossing = known.names, known.charset, known.opens, known.crossing
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), runs in _by_split(batches):
            if (path, start) not in opens:
                raise RuntimeError(f"the splits of {path} are others than when it was surveyed")
            for text in _split_records(runs, opens[path, start], start == 0):
                yield pa.RecordBatch.from_arrays(_arrays(list(_records([text], charset)), len(names)), names=names)

    lines = _lines(spark, uri)
    whole = lines.mapInArrow(parse, schema)
    if not crossing:
        return whole

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, runs in _by_split(batches):
            if key in crossing:
                found = [(key[0], o, key[1], text) for o, text in _pieces(runs, key, opens[key], crossing[key])]
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["path", "origin", "start", "piece"],
                )

    def join(table: pa.Table) -> pa.Table:
        pieces = sorted(zip(table.column("start").to_pylist(), table.column("piece").to_pylist(), strict=True))
        rows = list(_records([b"\n".join([p for _, p in pieces])], charset))
        return pa.table(_arrays(rows, len(names)), names=names)

    pieces = lines.mapInArrow(cut, "path string, origin long, start long, piece binary")
    return whole.unionByName(pieces.groupBy("path", "origin").applyInArrow(join, schema))
