"""Hashes of words, word n-grams and their sets, vectorised over batches of texts.

Words are runs of ASCII letters, digits and non-ASCII bytes after A-Z are
lower-cased. A word's hash is a polynomial over its bytes, from running sums
over the whole batch, so no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

from lexaspark.llm.decontamination import FOLD

_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
GRAM_KEYS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None]):
    """(first, end) ranges of texts of about ``CHUNK_BYTES``."""
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's words begin (one
    more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    word = np.concatenate([[False], joined != 32, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    powers = np.full(len(joined) + 1, INVERSE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[joined] * powers[:-1], dtype=np.uint64)])
    back = np.full(len(joined) + 1, BASE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    h = mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, bounds)


def gram_hashes(words: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of each text and where each text's begin. A
    text of fewer words, but not none, is one shingle."""
    size = np.diff(at)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(count)])
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    first = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    left = np.repeat(size, count)
    short = left < n
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        h += np.where(short & (k >= left), np.uint64(0), padded[first + k]) * GRAM_KEYS[k]
    return mixed(h), to


def gram_sets(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and where they begin."""
    grams, to = gram_hashes(*word_hashes(texts), n)
    owner = np.repeat(np.arange(len(texts)), np.diff(to))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
        grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(grams: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """MinHash signatures (texts x size, uint32); rows of empty sets are 0."""
    keys = np.random.default_rng(7).integers(0, 1 << 32, (2, size), dtype=np.uint64).astype(np.uint32)
    out = np.zeros((len(to) - 1, size), np.uint32)
    some = np.flatnonzero(np.diff(to))
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = grams.astype(np.uint32)
    for j in range(size if len(some) else 0):
        out[some, j] = np.minimum.reduceat((x ^ keys[0, j]) * (keys[1, j] | np.uint32(1)) ^ low, to[some])
    return out
