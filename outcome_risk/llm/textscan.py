"""Words and word n-grams of whole Arrow text columns as 64-bit hashes, in NumPy.

Texts are read as UTF-8 bytes in slices of bounded size, so memory does not follow the
length of an Arrow batch. Both word patterns in use end words at ASCII bytes only, hence
bytes can be classified one by one without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> _S30)) * _C2
    x = (x ^ (x >> _S27)) * _C3
    return x ^ (x >> _S31)


@dataclass
class Words:
    """Hashes of the words of some texts; words of text ``i`` are ``first[i]:first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of consecutive slices; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        own = offsets[start : stop + 1]
        yield start, data[own[0] : own[-1]], own - own[0]
        start = stop


def word_spans(lowered: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; words never cross a text's end."""
    inside = np.zeros(len(lowered) + 1, dtype=bool)
    inside[:-1] = alphabet[lowered]
    before = np.zeros(len(lowered) + 1, dtype=bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(lowered))]
    cuts = cuts[inside[cuts] & before[cuts]]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(before & ~inside)
    if len(cuts):
        cuts = np.unique(cuts)
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    lengths = ends - starts
    hashes = mix((eights[starts] & _MASKS[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _C1)
    rest = np.flatnonzero(lengths > 8)
    at = 8
    while len(rest):
        piece = eights[starts[rest] + at] & _MASKS[np.minimum(lengths[rest] - at, 8)]
        hashes[rest] = mix(hashes[rest] * _C3 + piece + _C1)
        at += 8
        rest = rest[lengths[rest] > at]
    return hashes


def words_of(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> Words:
    """Word hashes of one slice, A-Z lower-cased."""
    lowered = LOWER[data]
    starts, ends = word_spans(lowered, offsets, alphabet)
    return Words(span_hashes(lowered, starts, ends), np.searchsorted(starts, offsets))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbouring words, across text ends too."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(count, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        total = total * _C1 + hashes[j : j + count]
        total ^= total >> _S31
    return mix(total)
