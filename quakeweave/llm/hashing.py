"""Vectorised hashing of words, windows and sets in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
import xxhash

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words; a bounded memory of what was hashed."""

    def __init__(self, keep: int = 400_000):
        self.known, self.keep = {}, keep

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            new = {w for w in words if w not in known}
            if len(known) + len(new) > self.keep:
                known.clear()
                new = set(words)
            h = xxhash.xxh3_64_intdigest
            known.update((w, h(w)) for w in new)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def flat_words(texts: list[str | None], hasher: WordHasher, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words per text).  bytes.split() parts exactly at space and \\t\\n\\v\\f\\r; lower() is A-Z only."""
    counts, out = np.zeros(len(texts), np.int64), []
    for k, t in enumerate(texts):
        if t:
            b = t.encode()
            w = (b.lower() if lower else b).split()
            counts[k] = len(w)
            if w:
                out.append(hasher(w))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def shingles(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every n-word window; a text of fewer words has its whole sequence as one; none has none.

    Sorted by text and hash, each pair once.
    """
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(h):
        return doc, h
    acc = np.full(len(h), np.uint64(n))
    for j in range(n):
        nxt = np.zeros(len(h), np.uint64)
        nxt[: len(h) - j] = h[j:]
        acc = mix(acc * M3 + nxt)
    whole = np.arange(len(h)) + n <= ends[doc]
    d, s = doc[whole], acc[whole]
    for k in np.flatnonzero((counts > 0) & (counts < n)):
        a = np.array([counts[k]], np.uint64)
        for j in range(ends[k] - counts[k], ends[k]):
            a = mix(a * M3 + h[j : j + 1])
        d, s = np.append(d, k), np.append(s, a)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[first], s[first]


def small(batches, rows: int = 2000, most: int = 8 << 20) -> Iterator:
    """Arrow batches cut so that a few MB of text are held at a time, very long texts alone."""
    for b in batches:
        text = b.column("text")
        lengths = np.array([x or 0 for x in pc.binary_length(text).to_pylist()], np.int64)
        at, n = 0, len(lengths)
        while at < n:
            k = int(np.searchsorted(np.cumsum(lengths[at:]), most, "right"))
            k = max(1, min(k, rows))
            yield b.slice(at, k)
            at += k
