"""Shingle sets of texts as arrays of 64-bit hashes, made in numpy.

Two different shingles get one hash with probability 2^-64; sets are compared
by these hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 3
SEGMENT = 1 << 16  # bytes hashed at once: numpy takes some 100 bytes for each of them
ROWS = 512  # texts held as Python strings at once
SPACES = b" \t\n\x0b\x0c\r"
_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, dtype=np.uint8))
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64) + np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in the bytes of several texts, and each word's first
    byte.  starts_at: where the texts begin; words don't reach across."""
    inside = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[starts_at] = True
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & (~before | fresh[:-1]))
    if not len(first):
        return np.empty(0, np.uint64), first
    which = np.flatnonzero(inside)
    at = np.searchsorted(which, first)
    size = np.diff(np.append(at, len(which)))
    place = (np.arange(len(which)) - np.repeat(at, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(mixed(_FOLD[data[which]] + place * _A), at)), first


def _segments(data: bytes) -> Iterator[bytes]:
    """A long text in pieces cut before a space."""
    at = 0
    while len(data) - at > SEGMENT:
        cut = max(data.rfind(bytes([c]), at + 1, at + SEGMENT) for c in SPACES)
        if cut < 0:
            more = [x for x in (data.find(bytes([c]), at + SEGMENT) for c in SPACES) if x >= 0]
            if not more:
                break
            cut = min(more)
        yield data[at:cut]
        at = cut
    yield data[at:]


def words_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text, several texts at a time."""
    group: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        bounds = np.cumsum([0] + [len(x) for x in group])
        hashes, first = word_hashes(np.frombuffer(b"".join(group), dtype=np.uint8), bounds[:-1])
        cut = np.searchsorted(first, bounds)
        for a, b in zip(cut[:-1], cut[1:]):
            yield hashes[a:b]

    for text in texts:
        data = (text or "").encode()
        if len(data) > SEGMENT:
            yield from flush()
            group, held = [], 0
            yield np.concatenate([word_hashes(np.frombuffer(x, dtype=np.uint8), np.array([0]))[0] for x in _segments(data)])
            continue
        group.append(data)
        held += len(data)
        if held >= SEGMENT:
            yield from flush()
            group, held = [], 0
    yield from flush()


def shingle_set(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct k-word shingles; with fewer words the whole sequence as one."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(k))
        for i in range(k):
            out = mixed(out * _A + words[i:n - k + 1 + i])
    return np.unique(out.view(np.int64))


def sets_of(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The set of each text of an Arrow column, a few texts in memory at a time."""
    for lo in range(0, len(texts), ROWS):
        for words in words_of(texts.slice(lo, ROWS).to_pylist()):
            yield shingle_set(words, k)
    pa.default_memory_pool().release_unused()


def digest(s: np.ndarray) -> bytes | None:
    """One name for equal sets (16 bytes); None for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
