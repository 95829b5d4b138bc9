"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A run of three letters is the
product of its letters' vectors, each turned by its place; a text is the sum
of its runs' vectors, a language the sum over its texts.  A text has the
language whose sum has the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.blocks import carried_schema
from bazaar.llm.shared import held_out, lean_group, lean_map, pieces

DIMENSIONS = 512
LETTERS = 64  # 0 is whatever is no letter
RUNS = LETTERS**3
UNDETERMINED = "und"
_PIECE = 1 << 19
_KEPT_VECTORS = 32_768


@cache
def _letter_of() -> np.ndarray:
    """A letter number for every code point; rare letters share numbers."""
    letter = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            plain = 97 <= low <= 122
            letter[point] = low - 96 if plain else 27 + (low * 2654435761 >> 12) % (LETTERS - 27)
    return letter


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, run number) of every run of three letters with a letter in its middle.

    Whatever is between words counts as one letter of its own, so runs tell how
    words begin and end.
    """
    chars = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("\n".join(["", *chars, ""]).encode("utf-32-le"), dtype=np.uint32)
    letters = _letter_of()[points]
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
    text_of = np.repeat(np.arange(len(chars)), [len(c) + 1 for c in chars])
    text_of = np.concatenate(([0], text_of))[keep]
    letters = letters[keep].astype(np.int32)
    if len(letters) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    middle = letters[1:-1] > 0
    run = (letters[:-2] * LETTERS + letters[1:-1]) * LETTERS + letters[2:]
    return text_of[1:-1][middle], run[middle]


@cache
def _letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).integers(0, 2, size=(LETTERS, dimensions))
    return (2 * signs - 1).astype(np.float32)


def run_vectors(runs: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    letter = _letter_vectors(dimensions, seed)
    first, second, third = runs // LETTERS**2, runs // LETTERS % LETTERS, runs % LETTERS
    return np.roll(letter, 2, axis=1)[first] * np.roll(letter, 1, axis=1)[second] * letter[third]


class _Vectors:
    """Run vectors, the first ones met kept for the pieces to come."""

    def __init__(self, dimensions: int, seed: int):
        self.made_with = (dimensions, seed)
        self.place = np.full(RUNS, -1, dtype=np.int32)
        self.kept = np.zeros((_KEPT_VECTORS, dimensions), dtype=np.float32)
        self.used = 0

    def of(self, runs: np.ndarray) -> np.ndarray:
        new = runs[self.place[runs] < 0][: _KEPT_VECTORS - self.used]
        if len(new):
            self.kept[self.used : self.used + len(new)] = run_vectors(new, *self.made_with)
            self.place[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        at = self.place[runs]
        out = self.kept[at]
        if (at < 0).any():
            out[at < 0] = run_vectors(runs[at < 0], *self.made_with)
        return out


# Texts whose counts of runs are laid out at once.
_TEXTS = 256


def text_vectors(texts: list[bytes], vectors: _Vectors) -> np.ndarray:
    """The vector of each text; counts are damped by a root, as common runs say less."""
    parts = [_text_vectors(texts[i : i + _TEXTS], vectors) for i in range(0, len(texts), _TEXTS)]
    return np.concatenate(parts) if parts else np.zeros((0, vectors.kept.shape[1]), dtype=np.float32)


def _text_vectors(texts: list[bytes], vectors: _Vectors) -> np.ndarray:
    text_of, run = runs_of(texts)
    present = np.flatnonzero(np.bincount(run, minlength=RUNS))
    place = np.zeros(RUNS, dtype=np.int32)
    place[present] = np.arange(len(present))
    cells = np.bincount(text_of * len(present) + place[run], minlength=len(texts) * len(present))
    counts = np.sqrt(cells.astype(np.float32)).reshape(len(texts), len(present))
    out = np.zeros((len(texts), vectors.kept.shape[1]), dtype=np.float32)
    for i in range(0, len(present), 8192):
        out += counts[:, i : i + 8192] @ vectors.of(present[i : i + 8192])
    return out


def learn_profiles(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = 11) -> dict[str, np.ndarray]:
    """A vector of length 1 for each non-null ``lang`` of ``docs``, from all its texts.

    Sums are linear, so runs are counted by language first and only the counts,
    ``RUNS`` per language at most, become vectors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                    names=["lang", "run", "n"],
                )

        for rows, texts in pieces(batches, size=_PIECE):
            langs = np.array(rows.column("lang").to_pylist(), dtype=object)
            text_of, run = runs_of(texts)
            of_run = langs[text_of]
            for lang in set(langs.tolist()):
                found = np.bincount(run[of_run == lang], minlength=RUNS)
                counts[lang] = counts[lang] + found if lang in counts else found
            if len(counts) > 32:
                yield from flush()
                counts.clear()
        yield from flush()

    spoken = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    found = spoken.mapInArrow(lean_map(count), "lang string, run int, n long")
    by_run = found.groupBy("lang", "run").agg(F.sum("n").alias("n"))

    def bundle(table: pa.Table) -> pa.Table:
        runs, n = table.column("run").to_numpy(), table.column("n").to_numpy()
        runs, n = runs[order := np.argsort(runs)], n[order]
        total = np.zeros(dimensions, dtype=np.float64)
        for i in range(0, len(runs), 8192):
            total += np.sqrt(n[i : i + 8192]) @ run_vectors(runs[i : i + 8192], dimensions, seed)
        total /= max(np.linalg.norm(total), 1e-12)
        return pa.table([table.column("lang").slice(0, 1), pa.array([total.tolist()])], names=["lang", "vector"])

    # The driver gets a few kilobytes for each language, whatever its texts.
    known = by_run.groupBy("lang").applyInArrow(lean_group(bundle), "lang string, vector array<double>").collect()
    found = {r["lang"]: np.array(r["vector"]) for r in known}
    langs = sorted(r["lang"] for r in spoken.select("lang").distinct().collect())
    return {lang: found.get(lang, np.zeros(dimensions)) for lang in langs}


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict_languages(
    docs: DataFrame,
    profiles: dict[str, np.ndarray],
    dimensions: int = DIMENSIONS,
    seed: int = 11,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` and columns to ``carry`` for each row of ``docs``.

    ``score`` is the cosine of the text and its language, 0 at least.  A text
    without a letter, null or empty, is ``und`` with score 0, as is every text
    if there is no profile.  Equal cosines go to the first language by name.
    """
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names], dtype=np.float32).reshape(len(names), dimensions)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(dimensions, seed)
        for rows, texts in pieces(batches, size=_PIECE):
            found = text_vectors(texts, vectors)
            length = np.linalg.norm(found, axis=1)
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if names:
                cosine = found @ matrix.T / np.maximum(length, 1e-12)[:, None]
                best = cosine.argmax(axis=1)
                langs = [names[b] if n > 0 else UNDETERMINED for b, n in zip(best, length, strict=True)]
                scores = np.clip(cosine.max(axis=1), 0, 1) * (length > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("held_out"),
                    pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                    *[rows.column(c) for c in carry],
                ],
                names=["doc_id", "held_out", "lang_pred", "score", *carry],
            )

    others = [c for c in carry if c != "text"]
    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", *others
    )
    return picked.mapInArrow(lean_map(predict), SCHEMA + carried_schema(docs, carry))


def identify_languages(
    docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = 11, carry: Sequence[str] = ()
) -> DataFrame:
    """Learn from the documents that are not held out, then predict all of them.

    A null text, and one without a letter, is ``und``; a null id is never held out,
    and a null lang is not learnt from.  Without any language to learn every text
    is ``und``.  Texts are taken whole, repeated rows stay repeated, ties go to the
    first language by name.  Columns to ``carry`` come out with their rows.
    """
    profiles = learn_profiles(docs.where(~held_out()), dimensions, seed)
    return predict_languages(docs, profiles, dimensions, seed, carry)
