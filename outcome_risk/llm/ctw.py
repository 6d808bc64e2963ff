"""Context-tree weighting over bytes that are decomposed into binary decisions.

A byte is eight yes/no decisions; decision ``node`` (1..255: a one followed by the bits so
far) has a context tree of its own, whose branches are the bytes before, nearest first. A
tree node counts the zeros and ones that followed its context, its Krichevsky-Trofimov
estimate gives their probability, and weighting mixes it half and half with the product of
its children's weighted probabilities, down to a fixed depth. After learning the counts
stay as they are; the next bit's probability is the same mixture at the posterior weights.

A context with its next byte is one number, ``c1 c2 .. cD x`` with the nearest byte on top,
so that sorted numbers list the tree's branches in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EDGE = 0xFF  # never part of UTF-8: what stands before a text and what ends it
LOG2 = float(np.log(2.0))
_TABLE = 4096
_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))])  # log of (1/2)(3/2)..(n-1/2)
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 1.0))])  # log n!


def _stirling(x: np.ndarray) -> np.ndarray:
    """log Gamma of large numbers."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _rising(n: np.ndarray, table: np.ndarray, start: float) -> np.ndarray:
    small = table[np.minimum(n, _TABLE).astype(np.int64)]
    large = n > _TABLE
    if large.any():
        shift = table[_TABLE] - _stirling(np.array([_TABLE + start]))[0]
        small[large] = _stirling(n[large] + start) + shift
    return small


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _rising(zeros, _HALVES, 0.5) + _rising(ones, _HALVES, 0.5) - _rising(zeros + ones, _WHOLES, 1.0)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability that the next bit is a one."""
    return (ones + 0.5) / (zeros + ones + 1.0)


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability of inner nodes, and the posterior weight of their own estimate."""
    both = np.logaddexp(own, below) - LOG2
    return both, np.exp(own - LOG2 - both)


def stream(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``depth`` edges before, between and after them, and which places count.

    A text's places are its bytes and the edge that ends it.
    """
    sizes = np.diff(offsets)
    stops = depth + np.cumsum(sizes) + depth * np.arange(len(sizes))
    text = np.ones(len(data) + depth * (len(sizes) + 1), dtype=bool)
    text[:depth] = False
    text[(stops[:, None] + np.arange(depth)).ravel()] = False
    padded = np.full(len(text), EDGE, dtype=np.uint8)
    padded[text] = data
    text[stops] = True
    return padded, text


def context_keys(padded: np.ndarray, depth: int) -> np.ndarray:
    """The number of every place from ``depth`` on: its context, nearest byte on top, then its byte."""
    count = len(padded) - depth
    keys = padded[depth:].astype(np.uint64)
    wide, have, taken = padded.astype(np.uint64), 1, 0  # ``wide`` at i: bytes i, i-1, .. with the latest on top
    runs = {1: wide}
    while have * 2 <= depth:
        wide = (wide[have:] << np.uint64(8 * have)) | wide[:-have]
        have *= 2
        runs[have] = wide  # starts at place have - 1
    for size in sorted(runs, reverse=True):
        while depth - taken >= size:
            # bytes taken+1 .. taken+size before each place, the nearest of them on top
            start = depth - taken - size
            part = runs[size][start : start + count]
            keys |= part << np.uint64(8 * (depth - taken - size + 1))
            taken += size
    return keys


@dataclass
class Level:
    """Nodes of one depth for one decision: entries ``first[i]..`` share node ``i``."""

    run: np.ndarray
    first: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_w: np.ndarray
    weight: np.ndarray | None


class Forest:
    """The subtrees of all given contexts, from depth ``top`` to the whole depth.

    ``keys`` are sorted distinct context numbers, ``counts`` how often training has them;
    numbers that training lacks are given with count 0, so that they can be asked for.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top, self.keys = depth, top, keys
        self.parent: dict[int, np.ndarray] = {}
        self.entries: dict[int, tuple[np.ndarray, np.ndarray]] = {depth: (keys, counts)}
        for d in range(depth - 1, top - 1, -1):
            below, n = self.entries[d + 1]
            shorter = ((below >> np.uint64(16)) << np.uint64(8)) | (below & np.uint64(255))
            own, self.parent[d + 1] = np.unique(shorter, return_inverse=True)
            self.entries[d] = own, _sums(self.parent[d + 1], n, len(own))
        self.levels: dict[tuple[int, int], Level] = {}
        for d in range(depth, top - 1, -1):
            for j in range(8):
                self.levels[d, j] = self._level(d, j)

    def _level(self, d: int, j: int) -> Level:
        keys, counts = self.entries[d]
        prefix = keys >> np.uint64(8 - j)
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = prefix[1:] != prefix[:-1]
        first, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        bit = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        zeros = _sums(run, np.where(bit, 0, counts), len(first))
        ones = _sums(run, np.where(bit, counts, 0), len(first))
        own, weight = log_kt(zeros, ones), None
        if d < self.depth:
            child = self.levels[d + 1, j]
            below = np.bincount(run[self.parent[d + 1][child.first]], weights=child.log_w, minlength=len(first))
            own, weight = weighted(own, below)
        return Level(run, first, zeros, ones, own, weight)

    def roots(self) -> tuple[np.ndarray, ...]:
        """(context of depth top - 1, decision, zeros, ones, log weight) summed over the roots below it."""
        keys = self.entries[self.top][0]
        parts = []
        for j in range(8):
            level = self.levels[self.top, j]
            at = keys[level.first]
            node = np.uint64(1 << j) | ((at & np.uint64(255)) >> np.uint64(8 - j))
            parts.append(((at >> np.uint64(16)) << np.uint64(8) | node, level.zeros, level.ones, level.log_w))
        name, zeros, ones, log_w = (np.concatenate(p) for p in zip(*parts))
        names, at = np.unique(name, return_inverse=True)
        n = len(names)
        return (
            (names >> np.uint64(8)).astype(np.int64),
            (names & np.uint64(255)).astype(np.int64),
            _sums(at, zeros, n),
            _sums(at, ones, n),
            np.bincount(at, weights=log_w, minlength=n),
        )

    def log10_probabilities(self, above: np.ndarray, mass: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Of each key's byte after its context.

        ``above`` are sorted numbers (context of depth top - 1, decision); ``mass[0]`` and
        ``mass[1]`` the share of the mixture that the depths above give a zero and a one,
        ``rest`` the weight left for the depths of this forest.
        """
        x = self.keys & np.uint64(255)
        outer = (self.keys >> np.uint64(8 * (self.depth - self.top + 2))) << np.uint64(8)
        total = np.zeros(len(self.keys))
        for j in range(8):
            node = np.uint64(1 << j) | (x >> np.uint64(8 - j))
            bit = ((x >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
            at = np.searchsorted(above, outer | node)
            p, left = mass[bit, at], rest[at]
            entry = np.arange(len(self.keys))
            chain = {self.depth: entry}
            for d in range(self.depth, self.top, -1):
                chain[d - 1] = self.parent[d][chain[d]]
            for d in range(self.top, self.depth + 1):
                level = self.levels[d, j]
                own = level.run[chain[d]]
                one = kt_one(level.zeros, level.ones)[own]
                said = np.where(bit == 1, one, 1.0 - one)
                if level.weight is None:
                    p = p + left * said
                else:
                    weight = level.weight[own]
                    p, left = p + left * weight * said, left * (1.0 - weight)
            total += np.log10(p)
        return total


def _sums(group: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums by group (below 2^53)."""
    return np.bincount(group, weights=counts, minlength=n).astype(np.int64)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    own, at = np.unique(keys, return_inverse=True)
    return own, _sums(at, counts, len(own))
