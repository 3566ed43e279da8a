"""Vectorised words: 64-bit hashes of all words of a batch of texts, without a Python loop over words.

A word's hash is a polynomial of its bytes modulo 2**64 (from one running sum over the batch), mixed at the
end, or a digest where it is so long that some words are known to be equal under every such polynomial; equal words
have equal hashes in every batch and on every machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: Bytes of a word from which its hash is a digest.
LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = ~_SPACE
_FOLDED = np.zeros(256, bool)
_FOLDED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.ones(256, bool)
_BLANK[32] = False
_KINDS = {"plain": _PLAIN, "folded": _FOLDED, "blank": _BLANK}
_BYTE = np.random.Generator(np.random.PCG64(20240131)).integers(1, 2**63, 256, dtype=np.uint64)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _power, _inverse
    if len(_power) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words(NamedTuple):
    hash: np.ndarray  # uint64, of all words of all texts
    first: np.ndarray  # int64, len(texts) + 1: text i has the words first[i] to first[i + 1]
    start: np.ndarray  # byte positions in buffer
    end: np.ndarray
    buffer: bytes


def words(texts: list[str | None], kind: str) -> Words:
    """Words of each text (None: none). "plain": runs between ASCII white space, unchanged; "blank": runs
    between blanks; "folded": in lower case, runs of ASCII letters, ASCII digits and all other non-ASCII
    characters."""
    lower = kind == "folded"
    parts = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buffer = b" ".join([*parts, b""])
    raw = np.frombuffer(buffer, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _KINDS[kind][raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    _grow(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power[: len(raw)], out=total[1:])
    hashed = mix((total[end] - total[start]) * _inverse[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG).tolist():
        hashed[i] = int.from_bytes(hashlib.blake2b(buffer[start[i] : end[i]], digest_size=8).digest(), "little")
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return Words(hashed, np.searchsorted(start, bounds), start, end, buffer)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, over the whole array: callers leave out runs that cross a text's end."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += h[j : j + n]
    return mix(out)


def rolling(h: np.ndarray) -> Callable[[int], np.ndarray]:
    """Running Karp-Rabin hashes: of a run length k, the hashes of all runs of k words. The sums are made once, each k then
    costs one pass, whatever it is. Equal runs have equal hashes in all arrays."""
    _grow(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power[: len(h)], out=total[1:])
    return lambda k: mix((total[k:] - total[: len(total) - k]) * _inverse[: len(total) - k]) if k <= len(h) else total[:0]


def prefixes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of over n bytes, as their places in w, and hashes of their first n bytes."""
    at = np.flatnonzero(w.end - w.start > n)
    raw, start = np.frombuffer(w.buffer, np.uint8), w.start[at]
    out = np.full(len(at), n, np.uint64)
    for j in range(n):
        out *= np.uint64(_BASE)
        out += _BYTE[raw[start + j]]
    return at, mix(out)


def shingles(w: Words, i: int, k: int, all_grams: np.ndarray) -> np.ndarray:
    """The sorted distinct k-word shingles of text i; of a shorter text the one run of all its words."""
    a, b = w.first[i], w.first[i + 1]
    if b - a >= k:
        return np.unique(all_grams[a : b - k + 1])
    return grams(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def blocks(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of about `most` characters (one text at least), so that the arrays stay small."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)
