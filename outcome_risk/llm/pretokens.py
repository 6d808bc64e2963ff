"""Cutting texts into pieces that byte-level BPE encodes independently of each other.

A single space between two characters that are not white space always ends a pre-token,
and the next one starts with that space. So a text falls into units ``" word"`` whose ids
can be remembered: every distinct unit is encoded once per worker while a bounded memory
holds it, however often it occurs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import regex

# The pre-token pattern of the vocabulary family.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

#: White space other than plain spaces and line feeds (a superset of the pattern's own).
_ODD = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000]")
_SAFE = re.compile(r"(?<=[^\s\u180e\u200b]) (?=[^\s\u180e\u200b])")

#: Units, of at most ``LONGEST`` characters, that one generation of a memory holds: about 200
#: bytes each with key, value and slot, so two generations take some 60 MB of a worker.
UNITS_KEPT = 150_000
LONGEST = 48


def units(text: str) -> list[str]:
    """Pieces of a text, all but the first without their leading space."""
    if "  " in text or " \n" in text or "\n " in text or _ODD.search(text):
        return _SAFE.split(text)
    return text.split(" ")


def special_splitter(special: dict[str, int]) -> Callable[[str], Sequence[str]]:
    """Cuts a unit at special strings, which stay as pieces of their own."""
    if any(c.isspace() for text in special for c in text):
        raise ValueError("special strings with white space are not supported")
    if not special:
        return lambda unit: (unit,)
    longest_first = sorted(special, key=len, reverse=True)
    cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
    shared = set.intersection(*map(set, special))
    mark = min(shared, key=lambda c: (c.isalnum(), c)) if shared else ""  # in every special string

    def split(unit: str) -> Sequence[str]:
        if mark not in unit:
            return (unit,)
        return [piece for piece in cut.split(unit) if piece]

    return split


class Remembered(dict):
    """Values by key, computed when missing; two generations bound the memory.

    ``compute`` is a pure function, so forgetting costs time only. Long keys are not kept.
    """

    def __init__(self, compute: Callable, kept: int = UNITS_KEPT, longest: int | None = None):
        super().__init__()
        self.compute = compute
        self.kept = kept
        self.longest = longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if self.longest is not None and len(key) > self.longest:
                return value
        if len(self) >= self.kept:
            self.old = {}  # freed first, so that there are never three generations
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def unit_memory(compute: Callable[[str], object], kept: int = UNITS_KEPT) -> Remembered:
    """Values of units by the key that ``lookup`` gives them."""
    return Remembered(lambda key: compute(key[1:] if key[:1] == " " else " " + key), kept, LONGEST)


def lookup(text: str, memory: Remembered) -> list:
    """Values of a text's units.

    Units but the first are keyed without their space, and none of these begins with one;
    so the first unit, which has no space before it, is keyed with one.
    """
    pieces = units(text)
    values = [memory[" " + pieces[0]]] if pieces[0] else []
    values.extend(map(memory.__getitem__, pieces[1:]))
    return values
