"""Vectorised word splitting and hashing over the UTF-8 bytes of many texts."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240131))
BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SHIFT = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)

#: Bytes that end a word: space and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that stand in a term: letters, digits and every byte of a non-ASCII character.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    """base ** 0 .. n modulo 2 ** 64, grown by doubling and kept for the next batch."""
    have = _powers.get(name)
    if have is None or len(have) <= n:
        have = np.ones(1, np.uint64)
        while len(have) <= n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if n < 32 << 20:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    doc: np.ndarray  # index of its text
    count: np.ndarray  # words of each text


def split(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Runs of bytes for which inside[byte] holds; runs end with their text."""
    n = len(raw)
    docs = len(offsets) - 1
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(docs, np.int64))
    ok = inside[raw]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    borders = offsets[(offsets < n)]
    first[borders] |= ok[borders]
    last = ok.copy()
    last[:-1] &= ~ok[1:]
    inner = offsets[(offsets > 0) & (offsets <= n)] - 1
    last[inner] |= ok[inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, end, doc, np.bincount(doc, minlength=docs))


class Rolling:
    """64-bit hashes of any pieces of a byte array: a polynomial over coded bytes, finalised."""

    def __init__(self, raw: np.ndarray, lower: bool = False):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            coded = BYTE_CODE[LOWER[raw]] if lower else BYTE_CODE[raw]
            np.cumsum(coded * _power(BASE, n, "up")[:n], out=self.sums[1:])
        self.down = _power(BASE_INVERSE, n, "down")

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each raw[start:end]."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each piece raw[start:end]."""
    return Rolling(raw, lower).of(start, end) if len(start) else np.zeros(0, np.uint64)


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word n-grams of each text, as (text index, hash) ordered by both.

    A text with fewer words than width has its whole sequence as one shingle;
    one without words has none. A-Z count as a-z.
    """
    w = split(raw, offsets, ~SPACES)
    h = hashes(raw, w.start, w.end)
    ends = np.cumsum(w.count)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out_doc, out_hash = [], []
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            total += h[j : n - width + 1 + j] * SHIFT[j]
        whole = w.doc[: n - width + 1] == w.doc[width - 1 :]
        out_doc.append(w.doc[: n - width + 1][whole])
        out_hash.append(mix(total[whole]))
    for k in np.flatnonzero((w.count > 0) & (w.count < width)):
        total = np.uint64(w.count[k])
        with np.errstate(over="ignore"):
            for j in range(w.count[k]):
                total = total + h[ends[k] - w.count[k] + j] * SHIFT[j]
        out_doc.append(np.array([k]))
        out_hash.append(mix(np.array([total ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
    doc, hsh = np.concatenate(out_doc), np.concatenate(out_hash)
    if not (doc[1:] >= doc[:-1]).all():
        order = np.argsort(doc, kind="stable")
        doc, hsh = doc[order], hsh[order]
    ends = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]])
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        hsh[i:j].sort()
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hsh[1:] != hsh[:-1])
    return doc[keep], hsh[keep]
