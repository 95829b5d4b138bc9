"""Plain versions of the operators, for small tables only.  Rows are (doc_id, text) pairs."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

import public_tokenizers
import tiktoken

LAST = 1 << 70


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None) -> frozenset:
    w = words(lower(text))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def linked(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), LAST))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def encoder() -> tiktoken.Encoding:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(rows: list[tuple]) -> list[tuple]:
    known, out = encoder(), []
    for doc_id, text in rows:
        ids = known.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    return out


def without_bytes(rows: list[tuple], window: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row."""
    order = [LAST if d is None else d for d, _ in rows]
    data = [(t or "").encode() for _, t in rows]
    first: dict[bytes, int] = {}
    for o, b in zip(order, data, strict=True):
        for i in range(len(b) - window + 1):
            first[b[i : i + window]] = min(o, first.get(b[i : i + window], o))
    out = []
    for (doc_id, _), o, b in zip(rows, order, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < o:
                gone[i : i + window] = b"\1" * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), spans, kept))
    return out


def without_words(rows: list[tuple], window: int = 35) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept) of each row."""
    texts = [words(t) for _, t in rows]
    times = collections.Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def license_places(text: str | None, phrases: dict[str, str]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels)."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [
        (i, label)
        for phrase, label in phrases.items()
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), labels)


def edited(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_chars, edited_sha256) of rows in order of id."""
    texts = [t or "" for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        out.append((doc_id, len(text), sha(text[: len(text) - half] + following[:half])))
    return out


def phrases_of(data: bytes) -> set[bytes]:
    known, current = set(), b""
    for i in range(len(data)):
        current += data[i : i + 1]
        if current not in known:
            known.add(current)
            current = b""
    return known | ({current} if current else set())
