"""License scans by matching template markup.

A license template is its wording with marked regions: optional ones may be
absent, replaceable ones may hold any words within bounds.  Templates compile
to automata over words.  A place in a text is accepted where the mandatory
wording stands exactly, word by word.

Markup: ``<<optional>>...<<end>>`` and ``<<var;0-8>>`` (any 0 to 8 words).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bazaar.llm.shared import NOT_ALNUM, Words, mix, pieces

# The phrases that are looked for in any case, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of well-known license notices, with the parts that vary marked.
TEMPLATES = {
    "mit": [
        "released under the<<optional>> terms of the<<end>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2<<optional>> 0<<end>>",
        "spdx license identifier apache 2 0",
    ],
    "cc-by-nc": [
        "licensed under<<optional>> a<<end>><<optional>> the<<end>> creative commons attribution "
        "noncommercial<<var;0-3>> license",
        "licensed under cc by nc<<optional>> 4<<end>><<optional>> 0<<end>>",
    ],
    "gpl": [
        "licensed under the<<optional>> terms of the<<end>> gnu general public license"
        "<<optional>> as published by the free software foundation<<end>>"
        "<<optional>> either<<end>><<optional>> version<<var;1-2>><<end>>",
        "spdx license identifier gpl<<var;1-3>>",
    ],
    "lgpl": [
        "licensed under the<<optional>> terms of the<<end>> gnu lesser general public license",
    ],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        "licensed under the<<optional>> <<var;1-2>> clause<<end>> bsd license",
    ],
    "proprietary": ["copyright c<<var;1-8>> all rights reserved"],
}

_PARTS = re.compile(r"<<(optional|end|var;(\d+)-(\d+))>>|[^\s<]+")


@dataclass
class Automaton:
    """Steps from state to state: by a certain word, by any word, or by none."""

    label: str
    phrase: bool
    by_word: list[dict[str, list[int]]] = field(default_factory=list)
    by_any: list[list[int]] = field(default_factory=list)
    by_none: list[list[int]] = field(default_factory=list)
    wording: int = 0

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.by_none.append([])
        return len(self.by_word) - 1

    def reach(self, states: set[int]) -> set[int]:
        """All states reached from ``states`` without reading a word."""
        todo = list(states)
        while todo:
            for nxt in self.by_none[todo.pop()]:
                if nxt not in states:
                    states.add(nxt)
                    todo.append(nxt)
        return states

    def match(self, words: list[str], at: int) -> tuple[int, int] | None:
        """The end of the longest accepted run of words from ``at`` and how many words
        of the wording it has at most."""
        states = {s: 0 for s in self.reach({0})}
        best, final = None, len(self.by_word) - 1
        for i in range(at, len(words) + 1):
            if final in states:
                best = (i, states[final])
            if i == len(words):
                break
            found: dict[int, int] = {}
            for s, seen in states.items():
                ways = [(n, seen + 1) for n in self.by_word[s].get(words[i], ())]
                ways += [(n, seen) for n in self.by_any[s]]
                for nxt, count in ways:
                    for r in self.reach({nxt}):
                        found[r] = max(found.get(r, 0), count)
            states = found
            if not states:
                break
        return best


def compile_template(text: str, label: str, phrase: bool = False) -> Automaton:
    """The automaton of a template; optional regions may be nested."""
    out = Automaton(label, phrase)
    here, open_regions = out._state(), []
    for part in _PARTS.finditer(text):
        kind = part.group(1)
        if kind is None:
            nxt = out._state()
            out.by_word[here].setdefault(part.group(0), []).append(nxt)
            here = nxt
            out.wording += 1
        elif kind == "optional":
            open_regions.append(here)
        elif kind == "end":
            nxt = out._state()
            out.by_none[here].append(nxt)
            out.by_none[open_regions.pop()].append(nxt)
            here = nxt
        else:
            least, most = int(part.group(2)), int(part.group(3))
            skips = []
            for i in range(most):
                if i >= least:
                    skips.append(here)
                nxt = out._state()
                out.by_any[here].append(nxt)
                here = nxt
            end = out._state()
            for s in [*skips, here]:
                out.by_none[s].append(end)
            here = end
    if open_regions:
        raise ValueError(f"unclosed optional region: {text}")
    if any(out.by_any[s] for s in out.reach({0})) or len(out.by_word) - 1 in out.reach({0}):
        raise ValueError(f"a template must begin with mandatory wording: {text}")
    return out


@dataclass
class Scanner:
    """All automata, and the word pairs each of their matches must begin with."""

    automata: list[Automaton]
    first: np.ndarray  # hashes of first words, sorted
    pairs: np.ndarray  # hashes of word pairs, sorted
    by_pair: dict[int, list[int]]

    def places(self, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(word number, automaton) wherever a match may begin."""
        at = np.flatnonzero(np.isin(hashes[:-1], self.first))
        both = _pair(hashes[at], hashes[at + 1])
        keep = np.isin(both, self.pairs)
        for i, h in zip(at[keep].tolist(), both[keep].tolist(), strict=True):
            for a in self.by_pair[h]:
                yield i, a


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b))


def word_hashes(words: list[str]) -> np.ndarray:
    spans = Words([w.encode() for w in words], NOT_ALNUM)
    return spans.hashes()


def scanner(templates: Mapping[str, list[str]], phrases: Mapping[str, str]) -> Scanner:
    automata = [compile_template(text, label, phrase=True) for text, label in phrases.items()]
    automata += [compile_template(t, label) for label, texts in templates.items() for t in texts]
    first, by_pair = set(), {}
    for a, automaton in enumerate(automata):
        starts = automaton.reach({0})
        for s in starts:
            for word, nexts in automaton.by_word[s].items():
                after = automaton.reach(set(nexts))
                if any(automaton.by_any[n] for n in after) or len(automaton.by_word) - 1 in after:
                    raise ValueError("the first two words of a template must be wording")
                second = {w for n in after for w in automaton.by_word[n]}
                for other in second:
                    one, two = word_hashes([word, other])[[0, 1]][:, None]
                    first.add(int(one[0]))
                    by_pair.setdefault(int(_pair(one, two)[0]), []).append(a)
    as_array = lambda values: np.array(sorted(values), dtype=np.uint64)
    return Scanner(automata, as_array(first), as_array(by_pair), by_pair)


@cache
def _known(templates: tuple, phrases: tuple) -> Scanner:
    return scanner({k: list(v) for k, v in templates}, dict(phrases))


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:int,last:int>>"
)


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, list[str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
) -> DataFrame:
    """License wording in every text.

    A row for each row of ``docs``: ``n_words``; ``n_base``, ``first_word``,
    ``last_word`` and ``base_labels`` of the places where a phrase stands;
    ``labels`` of phrases and accepted templates; ``score``, the largest part of
    a template's wording that an accepted place holds (1 for a phrase, 0 without
    any); ``spans``, the first and last word of each accepted place.  Null and
    empty texts have no words and empty labels.  Every row is on its own, so
    repeated rows give repeated results.
    """
    known = (
        tuple((k, tuple(v)) for k, v in templates.items()),
        tuple(phrases.items()),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            found = _scan_piece(_known(*known), texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *found], names=[f.split()[0] for f in SCHEMA.split(", ")]
            )

    picked = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return picked.mapInArrow(scan, SCHEMA)


def _scan_piece(known: Scanner, texts: list[bytes]) -> list[pa.Array]:
    words = Words(texts, NOT_ALNUM, lower=True)
    found: dict[int, list[tuple[int, Automaton, int, int]]] = {}
    for at, a in known.places(words.hashes()) if len(words.start) > 1 else ():
        automaton = known.automata[a]
        doc = int(np.searchsorted(words.first, at, side="right")) - 1
        # No match is longer than the automaton has states.
        end = min(int(words.first[doc + 1]), at + len(automaton.by_word))
        spans = zip(words.start[at:end].tolist(), words.end[at:end].tolist(), strict=True)
        run = [words.bytes[s:e].tobytes().decode("utf-8", "replace") for s, e in spans]
        match = automaton.match(run, 0)
        if match:
            first = at - int(words.first[doc])
            found.setdefault(doc, []).append((first, automaton, first + match[0] - 1, match[1]))
    n_words = np.diff(words.first)
    columns: list[list] = [[], [], [], [], [], [], []]
    for doc in range(len(texts)):
        hits = found.get(doc, [])
        base = [h for h in hits if h[1].phrase]
        values = (
            len(base),
            min((h[0] for h in base), default=None),
            max((h[0] for h in base), default=None),
            ",".join(sorted({h[1].label for h in base})),
            ",".join(sorted({h[1].label for h in hits})),
            max((h[3] / h[1].wording for h in hits), default=0.0),
            [{"label": h[1].label, "first": h[0], "last": h[2]} for h in hits],
        )
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    long, text = pa.int64(), pa.string()
    span = pa.list_(pa.struct([("label", text), ("first", pa.int32()), ("last", pa.int32())]))
    types = [long, long, long, text, text, pa.float64(), span]
    return [pa.array(n_words, type=long)] + [
        pa.array(c, type=t) for c, t in zip(columns, types, strict=True)
    ]
