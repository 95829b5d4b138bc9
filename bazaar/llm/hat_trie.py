"""A HAT-trie over sequences of word numbers: hash containers below a shallow trie.

Sequences are packed into one or more 64-bit keys, first word highest.  A leaf
is a hash table for a range of sequences that share their first words; one that
grows too large bursts into leaves for ranges of the next word.  When the trie
holds too much, the largest subtree below the root leaves as a sorted run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from bazaar.llm.shared import mix

# Leaves one burst makes at most.
FANOUT = 16

Run = tuple[np.ndarray, np.ndarray]


class Packing:
    """Sequences of ``length`` words of ``bits`` bits each as rows of 64-bit keys; 0 is no word."""

    def __init__(self, bits: int, length: int):
        self.bits, self.length = max(bits, 1), length
        self.per_key = 64 // self.bits
        self.keys = -(-length // self.per_key)

    def shift(self, place: int) -> np.uint64:
        """How far left of its key's last bit the word at ``place`` stands."""
        return np.uint64((self.per_key - 1 - place % self.per_key) * self.bits)

    def pack(self, words: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(words[0]), self.keys), dtype=np.uint64)
        for place, column in enumerate(words):
            out[:, place // self.per_key] |= column.astype(np.uint64) << self.shift(place)
        return out

    def unpack(self, keys: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return [(keys[:, p // self.per_key] >> self.shift(p)) & low for p in range(self.length)]


def in_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of keys."""
    if keys.shape[1] == 1:
        return np.argsort(keys[:, 0], kind="stable")
    return np.lexsort(keys.T[::-1])


def merged(keys: np.ndarray, counts: np.ndarray) -> Run:
    """The distinct rows of keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = in_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    return keys[first], np.add.reduceat(counts[order], first)


class Container:
    """A hash table from rows of keys to counts, open addressing; equal hashes are told apart by the keys."""

    def __init__(self, width: int, slots: int = 1 << 10):
        self.size = 0
        self._allot(width, slots)

    def _allot(self, width: int, slots: int) -> None:
        self.keys = np.zeros((slots, width), dtype=np.uint64)
        self.counts = np.zeros(slots, dtype=np.int64)
        self.used = np.zeros(slots, dtype=bool)

    def entries(self) -> Run:
        return self.keys[self.used], self.counts[self.used]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if 2 * (self.size + len(keys)) > len(self.used):
            held = self.entries()
            self._allot(keys.shape[1], 1 << int(2 * (self.size + len(keys))).bit_length())
            self.size = 0
            self._put(*held)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = len(self.used) - 1
        h = np.zeros(len(keys), dtype=np.uint64)
        for column in keys.T:
            h = mix(h ^ column)
        slot = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(keys))
        claim = np.empty(len(self.used), dtype=np.int32)
        while len(left):
            at = slot[left]
            free = ~self.used[at]
            # Of several that want a free slot the last to claim it gets it.
            claim[at[free]] = left[free]
            won = left[free][claim[at[free]] == left[free]]
            self.keys[slot[won]], self.used[slot[won]] = keys[won], True
            self.size += len(won)
            here = (self.keys[at] == keys[left]).all(axis=1)
            np.add.at(self.counts, at[here], counts[left[here]])
            left = left[~here]
            slot[left] = (slot[left] + 1) & mask


class HatTrie:
    """Counts of packed sequences; ``add`` returns runs that had to leave, ``runs`` the rest."""

    def __init__(self, packing: Packing, burst: int, hold: int):
        self.packing, self.burst, self.hold = packing, burst, hold
        self.low = np.zeros(1, dtype=np.uint64)  # where the range of each leaf begins, by the first key
        self.leaves = [Container(packing.keys)]
        self.root = self.low  # where the subtrees below the root begin

    @property
    def size(self) -> int:
        return sum(leaf.size for leaf in self.leaves)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[Run]:
        leaf = np.searchsorted(self.low, keys[:, 0], side="right") - 1
        order = np.argsort(leaf, kind="stable")
        edges = np.searchsorted(leaf[order], np.arange(len(self.leaves) + 1))
        for i, (begin, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if end > begin:
                self.leaves[i].add(keys[order[begin:end]], counts[order[begin:end]])
        while (full := self._full()) is not None:
            self._burst(*full)
        while self.size > self.hold:
            yield self._spill()

    def _full(self) -> tuple[int, np.ndarray] | None:
        """A leaf that is too large, and where its range can be cut."""
        for i, leaf in enumerate(self.leaves):
            if leaf.size > self.burst and len(cuts := self._cuts(leaf)):
                return i, cuts
        return None

    def _cuts(self, leaf: Container) -> np.ndarray:
        """Borders between first words, or next ones where all first words are one, that halve and halve again."""
        first = np.sort(leaf.keys[leaf.used, 0])
        for place in range(min(self.packing.per_key, self.packing.length)):
            starts = first & ~((np.uint64(1) << self.packing.shift(place)) - np.uint64(1))
            if starts[0] != starts[-1]:
                wanted = len(starts) * np.arange(1, FANOUT) // FANOUT
                cuts = np.unique(starts[wanted])
                return cuts[cuts > starts[0]] if cuts[-1] > starts[0] else starts[-1:]
        return first[:0]  # the trie stays shallow: this container grows

    def _burst(self, i: int, cuts: np.ndarray) -> None:
        keys, counts = self.leaves[i].entries()
        lows = np.concatenate((self.low[i : i + 1], cuts))
        leaf = np.searchsorted(lows, keys[:, 0], side="right") - 1
        made = []
        for j in range(len(lows)):
            container = Container(self.packing.keys)
            if (of := np.flatnonzero(leaf == j)).size:
                container.add(keys[of], counts[of])
            made.append(container)
        if len(self.leaves) == 1:
            self.root = lows
        self.leaves[i : i + 1] = made
        self.low = np.concatenate((self.low[:i], lows, self.low[i + 1 :]))

    def _spill(self) -> Run:
        """Take out the largest subtree; an empty leaf stands in for it."""
        tree = np.searchsorted(self.root, self.low, side="right") - 1
        held = np.bincount(tree, weights=[leaf.size for leaf in self.leaves], minlength=len(self.root))
        of = np.flatnonzero(tree == int(held.argmax()))
        begin, end = int(of[0]), int(of[-1]) + 1
        run = self._sorted(self.leaves[begin:end])
        self.leaves[begin:end] = [Container(self.packing.keys)]
        self.low = np.concatenate((self.low[: begin + 1], self.low[end:]))
        return run

    @staticmethod
    def _sorted(leaves: list[Container]) -> Run:
        parts = [leaf.entries() for leaf in leaves]
        ordered = [(k[o], c[o]) for k, c in parts for o in (in_order(k),)]
        return tuple(np.concatenate(x) for x in zip(*ordered, strict=True))

    def runs(self) -> Iterator[Run]:
        """What is left, as one sorted run; leaves lie in the order of their ranges."""
        if self.size:
            yield self._sorted(self.leaves)
