"""Words and five-word shingles of whole texts as 64-bit hashes (helpers inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .tables import slabs

SHINGLE_WORDS = 5
# Bytes of text hashed at a time (a longer text is hashed alone).
HASHED_BYTES = 1_000_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_MIX_A = _U(0xBF58476D1CE4E5B9)
_MIX_B = _U(0x94D049BB133111EB)

# Words end at \x20 and \x09-\x0D only; A-Z count as a-z.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
# A number for every byte and the base of a polynomial in them, modulo 2^64.
_NUMBERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _MIX_A
    x = (x ^ (x >> _U(27))) * _MIX_B
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begins): the words of all texts in order; text i has begins[i]:begins[i+1].

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. All words of the texts are hashed
    at once: a polynomial over the bytes before each place is summed up, and a word is
    the difference of two sums, shifted to its own start.
    """
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    powers, inverse = _powers_to(n)
    in_word = ~_BLANK[raw]
    fresh = np.zeros(n + 1, bool)
    fresh[ends] = True  # a text begins
    begins_word = in_word & fresh[:-1]
    begins_word[1:] |= in_word[1:] & ~in_word[:-1]
    ends_word = in_word & fresh[1:]
    ends_word[:-1] |= in_word[:-1] & ~in_word[1:]
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(_NUMBERS[raw] * powers[:n], out=upto[1:])
    first, last = np.flatnonzero(begins_word), np.flatnonzero(ends_word) + 1
    hashes = mix((upto[last] - upto[first]) * inverse[first])
    return hashes, np.searchsorted(first, ends)


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash per shingle, in order; fewer words than ``size`` are one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, size)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : n - width + 1 + j]) * _STEP
        out ^= out >> _U(32)
    return mix(out)


def each_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text; none for null."""
    for _, part in slabs(texts, HASHED_BYTES):
        hashes, begins = hash_words(part)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            yield hashes[a:b]


def each_set(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted; none without words."""
    for _, part in slabs(texts, HASHED_BYTES):
        hashes, begins = hash_words(part)
        # of all words at once; those that reach into the next text are left out
        rolled = shingle_hashes(hashes) if len(hashes) >= SHINGLE_WORDS else None
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            if b - a >= SHINGLE_WORDS:
                found = np.sort(rolled[a : b - SHINGLE_WORDS + 1])
                fresh = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=fresh[1:])
                yield found[fresh]
            else:
                yield shingle_hashes(hashes[a:b])


def words_of(text: str | None) -> np.ndarray:
    return next(each_words(pa.array([text], pa.string())))


def shingle_set(text: str | None) -> np.ndarray:
    return next(each_set(pa.array([text], pa.string())))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
