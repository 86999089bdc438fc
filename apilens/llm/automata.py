"""Weighted acyclic automata over words: sorted n-grams with counts, which share their beginnings.

Every state is reached by one path, and states are numbered level by level in the order of their paths, so an automaton
is a sorted alphabet and three arrays a level: the state an arc leaves, its word, and the weight of the path that ends with
it. The states behind the last words have no arcs and are not stored. Union, lookup and output work on whole levels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

Level = tuple[np.ndarray, np.ndarray, np.ndarray]


class Transducer:
    """Counts of n-grams; ``levels[d]`` holds the arcs with the words at place d: (from, word, weight)."""

    def __init__(self, words: list[bytes], levels: list[Level]) -> None:
        self.words = words
        self.levels = levels

    @property
    def arcs(self) -> int:
        return sum(len(label) for _, label, _ in self.levels)

    @classmethod
    def of_ids(cls, words: Sequence[bytes], runs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Transducer:
        """From (ids, counts) with one row of word numbers per n-gram; repeated n-grams add up."""
        paths = [_sorted_levels(ids, counts, len(words)) for ids, counts in runs if len(ids)]
        return union([cls(list(words), levels) for levels in paths])

    @classmethod
    def of_phrases(cls, phrases: Sequence[bytes], counts: Sequence[int]) -> Transducer:
        """From n-grams of words joined by spaces."""
        numbers: dict[bytes, int] = {}
        by_length: dict[int, tuple[list[int], list[int]]] = {}
        for phrase, count in zip(phrases, counts, strict=True):
            words = phrase.split(b" ")
            ids, weights = by_length.setdefault(len(words), ([], []))
            ids += [numbers.setdefault(w, len(numbers)) for w in words]
            weights.append(count)
        runs = [
            (np.array(ids, dtype=np.int64).reshape(-1, n), np.array(weights, dtype=np.int64))
            for n, (ids, weights) in by_length.items()
        ]
        return cls.of_ids(list(numbers), runs)

    def select(self, firsts: np.ndarray) -> Transducer:
        """The part of the automaton behind a choice of its two-word beginnings (of its words, where it ends there)."""
        depth = min(1, len(self.levels) - 1)
        keep = [np.zeros(len(label), dtype=bool) for _, label, _ in self.levels]
        keep[depth] = firsts
        for d in range(depth, 0, -1):
            keep[d - 1][self.levels[d][0][keep[d]]] = True
        for d in range(depth + 1, len(self.levels)):
            keep[d] = keep[d - 1][self.levels[d][0]]
        used = np.zeros(len(self.words), dtype=bool)
        for (_, label, _), k in zip(self.levels, keep):
            used[label[k]] = True
        number = np.cumsum(used) - 1
        levels = []
        for d, (parent, label, weight) in enumerate(self.levels):
            k = keep[d]
            parent = (np.cumsum(keep[d - 1]) - 1)[parent[k]] if d else parent[k]
            levels.append((parent, number[label[k]], weight[k]))
        return Transducer([self.words[i] for i in np.nonzero(used)[0].tolist()], levels)

    def weights_of(self, phrases: Sequence[bytes]) -> np.ndarray:
        """The weight of every phrase, 0 where the automaton has no such path: its composition with the acceptor of
        the phrases, walked level by level."""
        number = {w: i for i, w in enumerate(self.words)}
        split = [p.split(b" ") for p in phrases]
        found = np.zeros(len(phrases), dtype=np.int64)
        active = np.arange(len(phrases))
        state = np.zeros(len(phrases), dtype=np.int64)
        size = max(1, len(self.words))
        for d, (parent, label, weight) in enumerate(self.levels):
            word = np.array([number.get(split[i][d], -1) for i in active.tolist()], dtype=np.int64)
            wanted = state * size + word
            codes = parent * size + label
            at = np.minimum(np.searchsorted(codes, wanted), max(0, len(codes) - 1))
            hit = (codes[at] == wanted) & (word >= 0) if len(codes) else np.zeros(len(active), dtype=bool)
            active, state = active[hit], at[hit]
            ends = np.array([len(split[i]) == d + 1 for i in active.tolist()], dtype=bool)
            found[active[ends]] = weight[state[ends]]
            active, state = active[~ends], state[~ends]
        return found

    def paths(self, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, ids, weights) of the n-grams with a weight of ``least`` or more, sorted."""
        before = np.zeros((1, 0), dtype=np.int64)
        for d, (parent, label, weight) in enumerate(self.levels):
            before = np.column_stack((before[parent], label))
            good = weight >= least
            yield d + 1, before[good], weight[good]

    def pack(self) -> bytes:
        """One message: sizes, alphabet, arrays of 32-bit integers (64-bit weights where they need it)."""
        alphabet = b" ".join(self.words)
        wide = any(len(w) and int(w.max()) >> 32 for _, _, w in self.levels)
        head = np.array([len(alphabet), wide, *(len(label) for _, label, _ in self.levels)], dtype="<i8")
        arrays = [
            a.astype(kind).tobytes()
            for parent, label, weight in self.levels
            for a, kind in ((parent, "<u4"), (label, "<u4"), (weight, "<u8" if wide else "<u4"))
        ]
        return b"".join([np.array([len(head)], dtype="<i8").tobytes(), head.tobytes(), alphabet, *arrays])

    @classmethod
    def unpack(cls, message: bytes) -> Transducer:
        (count,) = np.frombuffer(message, "<i8", 1)
        head = np.frombuffer(message, "<i8", int(count), 8).tolist()
        at = 8 + 8 * len(head)
        words = message[at : at + head[0]].split(b" ") if any(head[2:]) else []
        at += head[0]
        levels = []
        for n in head[2:]:
            arrays = []
            for kind, size in (("<u4", 4), ("<u4", 4), ("<u8", 8) if head[1] else ("<u4", 4)):
                arrays.append(np.frombuffer(message, kind, n, at).astype(np.int64))
                at += n * size
            levels.append(tuple(arrays))
        return cls(words, levels)


def _sorted_levels(ids: np.ndarray, counts: np.ndarray, size: int) -> list[Level]:
    """Levels of n-grams of one length, whose words are numbered from 0 to ``size`` in any order."""
    levels = []
    parent = np.zeros(len(ids), dtype=np.int64)
    for d in range(ids.shape[1]):
        codes, state = np.unique(parent * size + ids[:, d], return_inverse=True)
        last = d == ids.shape[1] - 1
        # counts are exact in doubles up to 2^53, more than one block can hold
        weight = np.bincount(state, counts, len(codes)).astype(np.int64) if last else np.zeros(len(codes), np.int64)
        levels.append((codes // size, codes % size, weight))
        parent = state
    return levels


def union(parts: Sequence[Transducer]) -> Transducer:
    """All paths of the parts; weights of equal paths add up. Parts need not have sorted alphabets."""
    words = sorted({w for p in parts for w in p.words})
    number = {w: i for i, w in enumerate(words)}
    size = max(1, len(words))
    labels = [np.array([number[w] for w in p.words], dtype=np.int64) for p in parts]
    states = [np.zeros(1, dtype=np.int64) for _ in parts]
    levels: list[Level] = []
    for d in range(max((len(p.levels) for p in parts), default=0)):
        codes, weights, lengths = [], [], []
        for p, label, state in zip(parts, labels, states):
            if d < len(p.levels):
                parent, own, weight = p.levels[d]
                codes.append(state[parent] * size + label[own])
                weights.append(weight)
            lengths.append(len(p.levels[d][1]) if d < len(p.levels) else 0)
        merged, place = np.unique(np.concatenate(codes), return_inverse=True)
        weight = np.zeros(len(merged), dtype=np.int64)
        np.add.at(weight, place, np.concatenate(weights))
        levels.append((merged // size, merged % size, weight))
        states = np.split(place, np.cumsum(lengths)[:-1])
    return Transducer(words, levels)
