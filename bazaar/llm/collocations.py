"""Phrase collocations: which words stand together far more often than by chance, by language.

Blocks number their words and ask which are frequent: no phrase is more frequent
than its words.  Equal words of all blocks meet by hash, are counted, and return
as ids.  In the same way blocks ask which pairs of neighbours are frequent.  What
begins at each place then goes into a HAT-trie, cut where a word or pair is rare
or the piece ends, so that one entry counts for all prefixes of a sequence.
Subtrees leave the trie as sorted runs, dealt out by the first two words.  Runs
that share prefixes meet in one task and are merged; a prefix that holds too
much for one is dealt out anew by more words, and the sums of phrases shorter
than that are added up at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.blocks import ENTRIES, Rule, answer, bucket_edges, entries, gather_bits
from bazaar.llm.hat_trie import HatTrie, Packing, merged
from bazaar.llm.shared import encoded, mix, pack, slices_for, squeeze, store, unpack, unsqueeze

MIN_COUNT = 100
LONGEST = 5
TOP = 2_000
UNKNOWN_LANG = "und"

_BREAK = b"\xff"  # no byte of UTF-8
_BLOCKS = (
    "block string, bucket int, places long, codes binary, skip binary, "
    "langs array<string>, lang_of binary, sizes binary, words binary, counts binary"
)
_FOUND = "block string, bucket int, ids binary, lang string, word string, id long, f long"
_RUNS = "part string, depth int, entries long, ids binary, words binary, counts binary"
_TYPES = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()),
}


@dataclass(frozen=True)
class Sizes:
    """What tasks hold at once: places of a block and of a step, entries of a container, trie and merge,
    text whose words meet in a task, places whose pairs do."""

    block: int = 2_000_000
    step: int = 250_000
    burst: int = 40_000
    hold: int = 600_000
    part: int = 500_000
    most_parts: int = 1_024
    bucket_bytes: int = 64 << 20
    bucket_pairs: int = 3_000_000

    @property
    def limit(self) -> int:
        return 2 * self.part


def _translation() -> bytes:
    table = bytearray(range(256))
    for c in range(0x41, 0x5B):
        table[c] += 32
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = 0xFF
    return bytes(table)


_TABLE = _translation()


def _tokens(data: bytes, size: int = 4 << 20) -> Iterator[list[bytes]]:
    """Words and breaks of a text in runs of about ``size`` bytes, each ending at a break or the text's end."""
    data, begin = data.translate(_TABLE), 0
    while begin < len(data):
        end = data.find(_BREAK, begin + size) + 1 or len(data)
        yield data[begin:end].replace(_BREAK, b" \xff ").split()
        begin = end


class _Numbers(dict):
    """Numbers of the words of one language within a block; breaks have number 0."""

    def __init__(self, block: _Block, lang: str):
        super().__init__({_BREAK: 0})
        self.block, self.lang = block, lang

    def __missing__(self, word: bytes) -> int:
        self.block.words.append((self.lang, word))
        self[word] = number = len(self.block.words)
        return number


class _Block:
    """Texts as numbers of words, until there are enough."""

    def __init__(self, name: str):
        self.name, self.places = name, 0
        self.words: list[tuple[str, bytes]] = []
        self.numbers: dict[str, _Numbers] = {}
        self.codes: list[np.ndarray] = []
        self.skip: list[np.ndarray] = []

    def add(self, lang: str, tokens: list[bytes], starts: int) -> None:
        """Tokens after the first ``starts`` are only there to end what begins before them."""
        known = self.numbers.get(lang)
        if known is None:
            self.numbers[lang] = known = _Numbers(self, lang)
        codes = np.array([known[t] for t in tokens] + [0], dtype=np.uint32)
        self.codes.append(codes)
        if len(tokens) > starts:
            self.skip.append(self.places + np.arange(starts, len(tokens)))
        self.places += len(codes)

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The places, and the words by bucket.

        The word at place p of bucket b gets the number p * buckets + b + 1:
        nothing but the order of the words tells it.
        """
        codes, skip = np.concatenate(self.codes), np.concatenate([np.zeros(0, dtype=np.int64), *self.skip])
        counted = np.ones(len(codes), dtype=bool)
        counted[skip] = False
        n = np.bincount(codes[counted], minlength=len(self.words) + 1)
        number = np.zeros(len(n), dtype=np.uint32)
        dealt: list[list[int]] = [[] for _ in range(buckets)]
        for i in (np.argsort(-n[1:], kind="stable") + 1).tolist():
            bucket = zlib.crc32(self.words[i - 1][1]) % buckets
            number[i] = len(dealt[bucket]) * buckets + bucket + 1
            dealt[bucket].append(i)
        yield _rows(_BLOCKS, [(self.name, -1, len(codes), pack(number[codes]), pack(skip), *[None] * 5)])
        langs = {lang: i for i, lang in enumerate(self.numbers)}
        for bucket, held in enumerate(dealt):
            if held:
                words = [self.words[i - 1] for i in held]
                yield _rows(_BLOCKS, [(
                    self.name, bucket, 0, None, None, list(langs),
                    pack(np.array([langs[lang] for lang, _ in words], dtype=np.uint32)),
                    pack(np.array([len(w) for _, w in words], dtype=np.uint32)),
                    squeeze(b"".join([w for _, w in words])), pack(n[held]),
                )])


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[f[0] for f in fields]
    )


def _to_blocks(docs: DataFrame, longest: int, buckets: int, sizes: Sizes) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        block = _Block(f"{task}-{made}")
        for batch in batches:
            for begin in range(0, len(batch), 256):  # few texts at once
                rows = batch.slice(begin, 256)
                langs = rows.column("lang").to_pylist()
                for lang, data in zip(langs, encoded(rows.column("text")), strict=True):
                    for tokens in _tokens(data):
                        for at in range(0, len(tokens), sizes.block):
                            here = tokens[at : at + sizes.block + longest - 1]
                            block.add(lang, here, min(sizes.block, len(tokens) - at))
                            if block.places >= sizes.block:
                                yield from block.rows(buckets)
                                made += 1
                                block = _Block(f"{task}-{made}")
        if block.codes:
            yield from block.rows(buckets)

    return docs.mapInArrow(cut, _BLOCKS)


def _count_words(blocks: DataFrame, min_count: int, buckets: int) -> DataFrame:
    """The ids of each block's words (0: rare), the frequent words, and the words of each language in all."""

    def count(table: pa.Table) -> pa.Table:
        bucket, held = table.column("bucket")[0].as_py(), []
        total: dict[str, dict[bytes, int]] = {}
        columns = [table.column(c).to_pylist() for c in ("block", "langs", "lang_of", "sizes", "words", "counts")]
        for block, langs, lang_of, sizes, words, counts in zip(*columns, strict=True):
            data, ends = unsqueeze(words), np.cumsum(unpack(sizes, np.uint32), dtype=np.int64).tolist()
            known = [total.setdefault(lang, {}) for lang in langs]
            rows = list(zip(
                [known[i] for i in unpack(lang_of, np.uint32).tolist()],
                [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True,
            ))
            for (of, word), n in zip(rows, unpack(counts, np.int64).tolist(), strict=True):
                of[word] = of.get(word, 0) + n
            held.append((block, rows))
        frequent = sorted((-f, lang, word) for lang, of in total.items() for word, f in of.items() if f >= min_count)
        out = [(None, bucket, None, lang, None, None, sum(of.values())) for lang, of in total.items()]
        ids: dict[int, dict[bytes, int]] = {id(of): {} for of in total.values()}
        for place, (f, lang, word) in enumerate(frequent):
            number = place * buckets + bucket + 1
            ids[id(total[lang])][word] = number
            out.append((None, bucket, None, lang, word.decode(), number, -f))
        for block, rows in held:
            found = np.array([ids[id(of)].get(word, 0) for of, word in rows], dtype=np.int64)
            out.append((block, bucket, pack(found), None, None, None, None))
        return pa.Table.from_batches([_rows(_FOUND, out)])

    words = blocks.where("bucket >= 0").select("bucket", "block", "langs", "lang_of", "sizes", "words", "counts")
    return words.groupBy("bucket").applyInArrow(count, _FOUND)


def _placed(codes: bytes, replies: pa.Table, buckets: int) -> np.ndarray:
    """The id of the word at each place of a block; 0 where it is rare or there is none."""
    codes = unpack(codes, np.uint32)
    of = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.int64)
    for kind, bucket, data in zip(*[replies.column(c).to_pylist() for c in ("kind", "bucket", "data")], strict=True):
        if kind == _WORDS:
            ids = unpack(data, np.int64)
            number = np.arange(len(ids)) * buckets + bucket + 1
            of[number[number < len(of)]] = ids[number < len(of)]
    return of[codes]


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two frequent words are neighbours, and a key for each such pair: one to one while ids have 32 bits."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return at, mix((ids[at].astype(np.uint64) << np.uint64(32)) | ids[at + 1].astype(np.uint64))


_WORDS, _BITS = 0, 1


def _ask_pairs(blocks: DataFrame, replies: DataFrame, buckets: int, ranges: int) -> DataFrame:
    """The distinct pairs of each block and their counts, in ranges of keys."""

    def ask(block: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for name, codes, skip in zip(*[block.column(c).to_pylist() for c in ("block", "codes", "skip")], strict=True):
            at, keys = _pairs(_placed(codes, replies, buckets))
            counted = ~np.isin(at, unpack(skip, np.int64))
            keys, place = np.unique(keys, return_inverse=True)
            n = np.bincount(place[counted], minlength=len(keys)).astype(np.uint32)
            sent = entries(0, name, bucket_edges(keys, ranges), keys, n)
            out += [sent] if sent else []
        return pa.Table.from_batches(out, schema=_ENTRIES)

    return blocks.groupBy("block").cogroup(replies.groupBy("of_block")).applyInArrow(ask, ENTRIES)


_ENTRIES = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in ENTRIES.split(", ")])


def _enough(min_count: int) -> Rule:
    def rule(a: np.ndarray, b: np.ndarray | None, first: np.ndarray, group: np.ndarray) -> np.ndarray:
        return (np.add.reduceat(a.astype(np.int64), first) >= min_count)[group]

    return rule


def _dealt(ids: list[np.ndarray], depth: int, into: int, turn: int) -> np.ndarray:
    """Which of ``into`` parts each sequence of word ids goes to, by its first ``depth`` words; turns are independent."""
    h = np.full(len(ids[0]), turn, dtype=np.uint64)
    for column in ids[:depth]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ column.astype(np.uint64))
    return (h % np.uint64(into)).astype(np.int64)


def _run_rows(
    prefix: str, depth: int, into: int, known: np.ndarray, words: list[np.ndarray], counts: np.ndarray
) -> pa.Table:
    """Sorted entries as rows, one for each of ``into`` parts that gets any; they stay sorted.

    ``known[w - 1]`` is the id of word ``w``; 0 is no word.
    """
    ids = np.concatenate((np.zeros(1, dtype=np.int64), known))
    part = _dealt([ids[w] for w in words], depth, into, prefix.count("."))
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(into + 1))
    rows = []
    for p in np.flatnonzero(np.diff(edges)).tolist():
        of = order[edges[p] : edges[p + 1]]
        columns = np.stack([w[of] for w in words])
        used, local = np.unique(columns, return_inverse=True)
        if used[0] == 0:
            used = used[1:]
        else:
            local = local + 1
        rows.append((
            f"{prefix}{p}", depth, len(of), pack(known[used.astype(np.int64) - 1]),
            pack(local.reshape(-1).astype(np.uint32)), pack(counts[of]),
        ))
    return pa.Table.from_batches([_rows(_RUNS, rows)])


def _trie_runs(
    blocks: DataFrame, replies: DataFrame, longest: int, buckets: int, ranges: int, parts: int, sizes: Sizes
) -> DataFrame:
    """Each block's sequences of frequent words and pairs, counted and dealt out as sorted runs."""

    def count(block: pa.Table, replies: pa.Table) -> pa.Table:
        out = [_run_rows("", 2, parts, np.zeros(0, dtype=np.int64), [np.zeros(0, dtype=np.uint64)] * longest, np.zeros(0))]
        for codes, skip in zip(*[block.column(c).to_pylist() for c in ("codes", "skip")], strict=True):
            ids = _placed(codes, replies, buckets)
            at, keys = _pairs(ids)
            good = np.zeros(len(ids) + longest, dtype=bool)  # is what begins here a frequent pair?
            good[at] = True
            if ranges:
                keys, place = np.unique(keys, return_inverse=True)
                bits = [
                    (bucket, data)
                    for kind, bucket, data in zip(
                        *[replies.column(c).to_pylist() for c in ("kind", "bucket", "data")], strict=True
                    )
                    if kind == _BITS
                ]
                good[at] = gather_bits(bits, bucket_edges(keys, ranges))[place]
            start = good.copy()
            start[unpack(skip, np.int64)] = False
            start = np.flatnonzero(start)
            used = good[: len(ids)].copy()
            used[1:] |= good[: len(ids) - 1]
            known, local = np.unique(ids[used], return_inverse=True)
            words = np.zeros(len(good), dtype=np.uint32)
            words[np.flatnonzero(used)] = local + 1
            packing = Packing(len(known).bit_length(), longest)
            trie = HatTrie(packing, sizes.burst, sizes.hold)
            for begin in range(0, len(start), sizes.step):
                at = start[begin : begin + sizes.step]
                sequence, goes_on = [words[at]], np.ones(len(at), dtype=bool)
                for k in range(1, longest):  # a rare word or pair or a break ends the sequence
                    goes_on &= good[at + k - 1]
                    sequence.append(np.where(goes_on, words[at + k], 0))
                for run in trie.add(packing.pack(sequence), np.ones(len(at), dtype=np.int64)):
                    out.append(_run_rows("", 2, parts, known, packing.unpack(run[0]), run[1]))
            for run in trie.runs():
                out.append(_run_rows("", 2, parts, known, packing.unpack(run[0]), run[1]))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(replies.groupBy("of_block")).applyInArrow(count, _RUNS)


def _joined(runs: pa.Table, longest: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Runs merged into one: the ids of its words, sorted distinct entries, and counts."""
    held = [unpack(i, np.int64) for i in runs.column("ids").to_pylist()]
    known = np.unique(np.concatenate(held))
    packing = Packing(len(known).bit_length(), longest)
    keys, counts = [], []
    for ids, words, n in zip(
        held, runs.column("words").to_pylist(), runs.column("counts").to_pylist(), strict=True
    ):
        to = np.concatenate(([0], np.searchsorted(known, ids) + 1)).astype(np.uint32)
        keys.append(packing.pack(list(to[unpack(words, np.uint32)].reshape(longest, -1))))
        counts.append(unpack(n, np.int64))
    keys, counts = merged(np.concatenate(keys), np.concatenate(counts))
    return known, packing.unpack(keys), counts


def _dealing(depth: int, longest: int) -> Callable[[pa.Table], pa.Table]:
    def again(table: pa.Table) -> pa.Table:
        prefix, into = table.column("part")[0].as_py(), table.column("into")[0].as_py()
        return _run_rows(f"{prefix}.", depth, into, *_joined(table, longest))

    return again


def _divide(runs: DataFrame, longest: int, sizes: Sizes) -> DataFrame:
    """Deal out anew what is too much for one merge: by two words, then by three, then by all."""
    for depth in sorted({2, min(3, longest), longest}):
        totals = runs.groupBy("part").agg(F.sum("entries").alias("total")).where(F.col("total") > sizes.limit)
        into = F.ceil(F.col("total") / sizes.part).cast("int").alias("into")
        large = store(totals.select("part", into), "collocations-large")
        if large.isEmpty():
            break

        marked = runs.join(large, "part", "left")
        # Equal shares of a part's runs are merged and dealt out by different tasks.
        share = F.pmod(F.xxhash64("ids", "words"), F.col("into")).alias("share")
        cut = marked.where("into is not null").select("*", share).groupBy("part", "share").applyInArrow(
            _dealing(depth, longest), _RUNS
        )
        runs = store(marked.where("into is null").select(runs.columns).unionByName(cut), "collocations-runs")
    return runs


def _phrases(runs: DataFrame, longest: int, min_count: int) -> DataFrame:
    """``ids, f`` of every phrase of two words and more that stands in ``min_count`` places at least."""

    def merge(table: pa.Table) -> pa.Table:
        depth = table.column("depth")[0].as_py()
        known, words, counts = _joined(table, longest)
        changed = np.zeros(len(counts), dtype=bool)
        changed[:1] = True
        changed[1:] = words[0][1:] != words[0][:-1]
        phrases, found = [], []
        for length in range(2, longest + 1):
            column = words[length - 1]
            changed[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(changed)
            f = np.add.reduceat(counts, first)
            # Phrases shorter than what dealt them out are not complete here.
            kept = (column[first] > 0) & ((f >= min_count) | (length < depth))
            first, f = first[kept], f[kept]
            if len(first):
                ids = known[np.stack([w[first] for w in words[:length]]).T.astype(np.int64) - 1]
                phrases.append(pa.ListArray.from_arrays(
                    pa.array(np.arange(len(first) + 1, dtype=np.int32) * length), pa.array(ids.reshape(-1))
                ))
                found.append(f)
        ids = pa.concat_arrays(phrases) if phrases else pa.array([], pa.list_(pa.int64()))
        return pa.table([ids, pa.array(np.concatenate([counts[:0], *found]))], names=["ids", "f"])

    parts = runs.groupBy("part").applyInArrow(merge, "ids array<long>, f long")
    return parts.groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def _grown(table: DataFrame) -> DataFrame:
    """Phrases and words grow with the texts, and files of them are a small part of what they take in memory:
    joins sort them, whatever their files say, so that no driver has to hold them for a broadcast."""
    return table.hint("merge")


def _scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """``ids, lang, a, l, r, n, score`` of each phrase at its lowest-scoring cut."""
    parts = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    at = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    cut = phrases.select("ids", F.col("f").alias("a"), at)
    cut = cut.withColumns({
        "first": F.slice("ids", F.lit(1), F.col("k")), "rest": F.slice("ids", F.col("k") + 1, F.size("ids")),
    })
    cut = cut.join(_grown(parts.select(F.col("ids").alias("first"), F.col("f").alias("l"))), "first")
    cut = cut.join(_grown(parts.select(F.col("ids").alias("rest"), F.col("f").alias("r"))), "rest")
    langs = words.select("id", "lang").join(totals, "lang")
    cut = cut.withColumn("id", F.col("ids")[0]).join(_grown(langs), "id")
    wide = {c: F.col(c).cast("decimal(20,0)") for c in "alrn"}
    score = F.expr("cast(1000 * a * n as decimal(38,0)) div cast(l * r as decimal(38,0))")
    scored = cut.select("ids", "lang", "k", *[wide[c].alias(c) for c in "alrn"]).withColumn("score", score)
    best = F.min(F.struct("score", "k", "lang", "a", "l", "r", "n")).alias("best")
    return scored.groupBy("ids").agg(best).select(
        "ids", "best.lang", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    )


def _outermost(scored: DataFrame, absorb: int) -> DataFrame:
    """Without phrases that a longer one contains in ``absorb`` of 100 of their places."""
    span = F.struct(F.col("begin"), F.col("length"))
    long = scored.where(F.size("ids") > 2).select("ids", F.col("a").alias("longer"))
    inside = (
        long.withColumn("length", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)))
        .withColumn("begin", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("length") + 1)))
        .select(F.slice("ids", span["begin"], span["length"]).alias("ids"), "longer")
        .groupBy("ids").agg(F.max("longer").alias("longer"))
    )
    left = scored.join(_grown(inside), "ids", "left")
    return left.where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a"))).drop("longer")


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    absorb: int = 100,
    top: int = TOP,
    sizes: Sizes | None = None,
) -> DataFrame:
    """Per language the ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase has 2 to ``longest`` words of one piece of text and stands in ``a``
    places, ``min_count`` or more.  Its score compares that with what the counts
    ``l`` and ``r`` of its two parts, at the cut where they explain it best, make
    likely among ``n`` words.  Phrases inside a longer one that is there in
    ``absorb`` of 100 of their places, or more, are left out.

    Null texts count as empty, a null lang as ``und``; repeated rows count each
    time.  Ties are broken by count and phrase.  A text is worked on in runs that
    end between pieces; only one without any end of a piece is split up as a whole.
    Columns besides ``text`` and ``lang`` are not read, whatever their names.  The
    counts are exact, and no task holds more than ``sizes`` says.
    """
    sizes = sizes or Sizes()
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang")
    texts = docs.select(lang, "text")
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = slices_for(volume, sizes.bucket_bytes)
    blocks = store(_to_blocks(texts, longest, buckets, sizes), "collocations-blocks")
    found = store(_count_words(blocks, min_count, buckets), "collocations-words")
    words = found.where("word is not null").select("id", "lang", "word", "f")
    totals = found.where("lang is not null and word is null").groupBy("lang").agg(F.sum("f").alias("n"))
    coded = blocks.where("bucket < 0").select("block", "places", "codes", "skip")
    last, places = words.agg(F.max("id")).first()[0] or 0, coded.agg(F.sum("places")).first()[0] or 0
    parts = min(sizes.most_parts, slices_for(places, sizes.part))
    replies = found.where("ids is not null").select(
        F.lit(_WORDS).alias("kind"), "bucket", F.col("block").alias("of_block"), F.col("ids").alias("data")
    )
    # Pairs only narrow down what enters a trie: where ids outgrow their keys, all pairs of frequent words do.
    ranges = slices_for(places, sizes.bucket_pairs) if last < 1 << 32 else 0
    everything = replies
    if ranges:
        asked = _ask_pairs(coded, replies, buckets, ranges)
        bits = answer(asked, {0: (np.uint32, np.uint32, _enough(min_count))})
        everything = replies.unionByName(bits.select(
            F.lit(_BITS).alias("kind"), "bucket", F.col("block").alias("of_block"), F.col("bits").alias("data")
        ))
    runs = store(_trie_runs(coded, everything, longest, buckets, ranges, parts, sizes), "collocations-runs")
    runs = _divide(runs, longest, sizes)
    phrases = store(_phrases(runs, longest, min_count), "collocations-phrases")
    left = store(_outermost(_scored(phrases, words, totals), absorb), "collocations-scored")
    spelt = (
        left.select("ids", F.posexplode("ids").alias("place", "id")).join(_grown(words.select("id", "word")), "id")
        .groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
        .select("ids", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.join(_grown(spelt), "ids").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
