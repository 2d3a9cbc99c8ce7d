"""64-bit hashes of words and word n-grams of many texts at once, in NumPy.

Words are runs of bytes other than space and U+0009 to U+000D; where case is folded,
A to Z count as a to z.  A word's hash is a polynomial in random 64-bit values of its bytes,
taken from differences of running sums, and then mixed.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = 1 << 20  # texts are hashed in runs of about so many bytes
LONG_WORD = 1 << 16  # longer words are hashed one by one
_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[ord("A"):ord("Z") + 1] = BYTE_VALUE[ord("a"):ord("z") + 1]
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which close values land far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n + 1, BASE), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of words that lie within ``STEP`` plus ``LONG_WORD`` bytes of the first one's start."""
    first = starts[0]
    up, down = _powers(STEP + LONG_WORD)
    part = raw[first:ends[-1]]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(values[part] * up[:len(part)], out=sums[1:])
    starts, ends = starts - first, ends - first
    return (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)


def _hash_long(raw: np.ndarray, start: int, end: int, fold: bool) -> int:
    word = raw[start:end].tobytes()
    return int.from_bytes(hashlib.blake2b(word.lower() if fold else word, digest_size=8).digest(), "little")


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hashes of spans of a run of bytes, in order of their starts."""
    hashes = np.empty(len(starts), np.uint64)
    long = ends - starts > LONG_WORD
    for k in np.flatnonzero(long).tolist():
        hashes[k] = _hash_long(raw, starts[k], ends[k], fold)
    short = np.flatnonzero(~long)
    step = starts[short] // STEP
    cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True]) if len(short) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        some = short[a:b]
        hashes[some] = _hash_words(raw, starts[some], ends[some], FOLDED_VALUE if fold else BYTE_VALUE)
    return mix(hashes)


def words_in(raw: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words of a run of bytes."""
    edge = np.diff(BLANK[raw].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return hash_spans(raw, starts, ends, fold), starts, ends


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by a line break, and one past each text's break."""
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words before each text and in all."""
    raw, text_ends = joined(texts)
    hashes, starts, _ = words_in(raw, fold)
    return hashes, np.r_[0, np.searchsorted(starts, text_ends)]


def runs(texts: list[bytes]):
    """Cuts a list of texts into runs of about ``STEP`` bytes."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text) + 1
        if size >= STEP:
            yield run
            run, size = [], 0
    if run:
        yield run


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    count = max(len(words) - n + 1, 0)
    total = np.full(count, n, np.uint64)
    for k in range(n):
        total = total * BASE + words[k:k + count]
    return mix(total)


def shingle_sets(texts: list[bytes], n: int):
    """The sorted distinct hashes of each text's word n-grams.

    Of a text with fewer words, the whole sequence is the only one; a text without words has none.
    """
    for run in runs(texts):
        hashes, bounds = word_hashes(run)
        grams = gram_hashes(hashes, n)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            else:
                yield gram_hashes(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64)
