"""Token counts of every prefix of a text, for a word-wise BPE vocabulary with word ends.

A text is tiled into words and white space.  A dynamic programme over each
distinct word finds, for every prefix, the one token that can end it: a sequence
of tokens is what merging gives exactly if each two neighbours are, so the last
token of a prefix is decided by the last token of the shorter prefix before it.
The count at a prefix is one more than the count there.  Adding up over words
gives the exact count at every prefix of the text, from which questions about
truncation and budgets are answered without encoding anything again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from bazaar.llm.shared import pack, pieces, unpack

WORD_END = "</w>"
LIMIT = 2048

# A task forgets words, pairs and beginnings it has met beyond these numbers.
_MOST_WORDS = 800_000
_MOST_PAIRS = 500_000
_MOST_STATES = 800_000
# Beginnings of words up to this many bytes are remembered.
_SHORT = 16
# Longer texts are handled in parts cut at white space.
_PART_CHARS = 1 << 20
_GAP = re.compile(r"[ \n\t]")


def byte_letters() -> list[str]:
    """The letter for each byte: itself where it is visible, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class WordCounts:
    """Counts at the prefixes of single words, by a vocabulary's merges."""

    def __init__(self, vocabulary: list[str], merges: list[tuple[str, str]]):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        # Where a token may stand: 1 inside a word, 2 at its end.
        self.places = dict.fromkeys((t for t in vocabulary if not t.endswith(WORD_END)), 1)
        for token in vocabulary:
            if token.endswith(WORD_END):
                part = token.removesuffix(WORD_END)
                self.places[part] = self.places.get(part, 0) | 2
        self.longest = max(map(len, self.places), default=1)
        self.letters = dict(enumerate(byte_letters()))
        self.pairs: dict[tuple[str, str, bool], bool] = {}
        self.states: dict[str, tuple[int, str, int]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours of lowest rank, leftmost first; for short runs."""
        while len(symbols) > 1:
            ranks = [self.ranks.get(p) for p in zip(symbols, symbols[1:], strict=False)]
            known = [r for r in ranks if r is not None]
            if not known:
                break
            at = ranks.index(min(known))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def neighbours(self, first: str, second: str, ends: bool) -> bool:
        """Does merging leave these two tokens apart, and otherwise whole?"""
        key = (first, second, ends)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > _MOST_PAIRS:
                self.pairs.clear()
            last = second + WORD_END if ends else second
            symbols = [*first, *second[:-1], second[-1] + WORD_END if ends else second[-1]]
            self.pairs[key] = known = self.merged(symbols) == [first, last]
        return known

    def _state(self, text: str, i: int, count: list[int], last: list[str]) -> tuple[int, str, int]:
        """Tokens of the first ``i`` letters inside a word, the last of them, and tokens if the word ends there."""
        inside, token, whole = 0, "", 0
        places, neighbours = self.places, self.neighbours
        for j in range(i - self.longest if i > self.longest else 0, i):
            part = text[j:i]
            place = places.get(part)
            if place is None:
                continue
            if place & 1 and not inside and (not j or neighbours(last[j], part, False)):
                inside, token = count[j] + 1, part
                if whole:
                    break
            if place & 2 and not whole and (not j or neighbours(last[j], part, True)):
                whole = count[j] + 1
                if inside:
                    break
        return inside, token, whole

    def prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix, by code points, taken as a word of its own."""
        data = word.encode()
        text = data.decode("latin-1").translate(self.letters)
        n = len(text)
        count, last, ended = [0], [""], [0]
        states = self.states
        if len(states) > _MOST_STATES:
            states.clear()
        for i in range(1, n + 1):
            # Words share beginnings: the state after one is kept, if it is short.
            key = text[:i] if i <= _SHORT else ""
            state = states.get(key)
            if state is None:
                state = self._state(text, i, count, last)
                if key:
                    states[key] = state
            inside, token, whole = state
            count.append(inside)
            last.append(token)
            ended.append(whole)
        if n == len(word):
            return ended[1:]
        return [ended[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]


class _Lower(dict):
    """What each code point becomes in lower case, as the library has it."""

    def __missing__(self, code: int) -> str:
        self[code] = low = normalizers.Lowercase().normalize_str(chr(code))
        return low


class _Kinds(dict):
    """A stand-in of the same kind for each code point beyond ASCII, kinds as the library sees them."""

    def __init__(self, split: pre_tokenizers.Split):
        super().__init__({c: chr(c) for c in range(128)})
        self.split = split

    def __missing__(self, code: int) -> str:
        c = chr(code)
        around = [p for p, _ in self.split.pre_tokenize_str(f"a{c}{c}a")]
        if len(around) == 1:
            kind = "é"
        elif len(around) == 2:
            kind = " "
        else:
            kind = "·" if len(around) == 3 else "²"
        self[code] = kind
        return kind


class _Known(dict):
    """Numbers of words, and their counts end to end."""

    def __init__(self, counts_of: Callable[[str], list[int]]):
        super().__init__()
        self.counts_of = counts_of
        self.begin, self.size, self.flat = array("q"), array("q"), array("i")

    def __missing__(self, word: str) -> int:
        counts = self.counts_of(word)
        self.begin.append(len(self.flat))
        self.size.append(len(counts))
        self.flat.extend(counts)
        self[word] = code = len(self)
        return code

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's counts begin, how many there are, and all counts; views, to be dropped soon."""
        return (
            np.frombuffer(self.begin, dtype=np.int64), np.frombuffer(self.size, dtype=np.int64),
            np.frombuffer(self.flat, dtype=np.int32),
        )


class TextCounts:
    """Counts at the prefixes of whole texts, for a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        if model["end_of_word_suffix"] != WORD_END:
            raise ValueError(f"{path} has no word ends")
        self.words = WordCounts(list(model["vocab"]), [tuple(m) for m in model["merges"]])
        pattern = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # Texts are cut by stand-ins, which are few: letters, digits and white space can be listed.
        listed = pattern.replace(r"\p{L}", "a-zA-Zé").replace(r"\p{N}", "0-9²").replace(r"\s", r"\t-\r ")
        if "\\p" in listed:
            raise ValueError(f"{path} cuts words by classes other than letters and numbers")
        self.split = re.compile(listed).findall
        self.tiles = re.compile(rf"[\t-\r ]+|{listed}").findall
        self.lower = _Lower()
        self.kinds = _Kinds(pre_tokenizers.Split(Regex(pattern), "removed", invert=True))
        # Longest first, so that of two that begin at one place the longer is taken.
        special = sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self._forget()

    def _forget(self) -> None:
        self.known = _Known(self._counts_of_word)

    def _counts_of_word(self, word: str) -> list[int]:
        kind = word if word.isascii() else word.translate(self.kinds)
        if not self.split(kind):  # white space
            return [0] * len(word)
        found = self.words.prefixes(word)
        for i in range(2, len(word)):  # a contraction that is cut short is no contraction
            parts = self.split(kind[:i])
            if len(parts) == 1:
                break
            found[i - 1] = sum(self.words.prefixes(p)[-1] for p in parts)
        return found

    def _part(self, text: str) -> np.ndarray:
        """Counts after each code point of a text that holds no special string."""
        if len(self.known) > _MOST_WORDS:
            self._forget()
        lower = text.lower() if text.isascii() else text.translate(self.lower)
        if lower.isascii():
            words = self.tiles(lower)
        else:
            ends = list(accumulate(map(len, self.tiles(lower.translate(self.kinds)))))
            words = [lower[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if not words:
            return np.zeros(0, dtype=np.int64)
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        begin, size, flat = self.known.arrays()
        begin, size = begin[codes], size[codes]
        ends = np.cumsum(size)
        inside = flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
        whole = flat[begin + size - 1]
        counts = inside + np.repeat(np.cumsum(whole) - whole, size)
        if len(lower) != len(text):
            counts = counts[np.cumsum([len(c.translate(self.lower)) for c in text]) - 1]
        return counts

    def _plain(self, text: str) -> np.ndarray:
        """The same, in parts if the text is long."""
        found, begin, held = [], 0, 0
        while begin < len(text):
            gap = _GAP.search(text, begin + _PART_CHARS) if len(text) - begin > _PART_CHARS else None
            end = gap.end() if gap else len(text)
            counts = self._part(text[begin:end]) + held
            held = int(counts[-1])
            found.append(counts)
            begin = end
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def of(self, text: str) -> np.ndarray:
        """The exact number of tokens of every prefix of ``text`` in NFC, from the empty one on."""
        found, at, held = [np.zeros(1, dtype=np.int64)], 0, 0
        for match in self.special.finditer(text) if self.special else ():
            # Until it is complete, a special string is text like any other.
            before = unicodedata.normalize("NFC", text[at : match.start()])
            counts = self._plain(before + match[0]) + held
            held = (int(counts[len(before) - 1]) if before else held) + 1
            counts[-1] = held
            found.append(counts)
            at = match.end()
        found.append(self._plain(unicodedata.normalize("NFC", text[at:])) + held)
        return np.concatenate(found)


@cache
def _counter(path: str) -> TextCounts:
    return TextCounts(path)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Length of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_bytes, n_chars`` and packed ``counts`` at every prefix of each text.

    ``vocabulary`` is the path of a tokenizer file that every machine has.  Prefixes
    are counted in code points of the text in NFC; the first is the empty one.
    Null texts count as empty, repeated rows stay repeated, and other columns are
    not read.  ``tokens_at`` and ``cut_to_budget`` answer from this table alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for rows, texts in pieces(batches):
            counts = [counter.of(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(c) - 1 for c in counts], pa.int64()),
                    pa.array([pack(c.astype(np.int32)) for c in counts], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_chars", "counts"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_chars long, counts binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def tokens_at(counted: DataFrame, places: list[int]) -> DataFrame:
    """``doc_id, place, n_tokens``: tokens of the first ``place`` code points, or of all if fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for packed in batch.column("counts").to_pylist():
                counts = unpack(packed, np.int32)
                found += [int(counts[min(p, len(counts) - 1)]) for p in places]
            ids = [i for i in batch.column("doc_id").to_pylist() for _ in places]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(places * len(batch), pa.int64()), pa.array(found, pa.int64())],
                names=["doc_id", "place", "n_tokens"],
            )

    return counted.select("doc_id", "counts").mapInArrow(run, "doc_id long, place long, n_tokens long")


def cut_to_budget(counted: DataFrame, budget: int) -> DataFrame:
    """``doc_id, kept_chars``: the longest prefix of at most ``budget`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [longest_within(unpack(c, np.int32), budget) for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.int64())], names=["doc_id", "kept_chars"]
            )

    return counted.select("doc_id", "counts").mapInArrow(run, "doc_id long, kept_chars long")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` and ``kept_chars``, the longest prefix within the limit.

    As ``prefix_counts``, whose table each text has for as long as it is looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for rows, texts in pieces(batches):
            found = []
            for text in texts:
                counts = counter.of(text.decode())
                found.append((len(text), int(counts[-1]), bool(counts[-1] > limit), longest_within(counts, limit)))
            n_bytes, n_tokens, over, kept = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                    pa.array(over), pa.array(kept, pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"],
            )

    return _texts(docs).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long"
    )
