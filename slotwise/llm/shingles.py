"""Word shingles of a text as 64-bit numbers.

A shingle is the value of a polynomial over its bytes, modulo 2^64. Such values are alike
for some long texts that are made for it, so shingles of LONG bytes or more, which are few,
are hashed byte by byte instead.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
#: Bytes of a shingle from which on its own digest is taken, and words looked at together:
#: the powers held are those of so many words of less than LONG bytes.
LONG, TOGETHER = 64, 1 << 14

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
#: Odd factors and offsets of the permutations behind a sketch.
_FACTORS = _rng.integers(0, 1 << 64, 8, dtype=np.uint64)[:, None] | np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 64, 8, dtype=np.uint64)[:, None]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for n places at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(1 << (n - 1).bit_length(), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The distinct shingles of ``size`` words, as sorted hashes.

    A-Z is lower-cased; words are parted by blanks and the ASCII controls 9 to 13. Fewer
    words than ``size``: the whole sequence is one shingle; no words: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= TOGETHER:
        return _distinct(_hashes(words, size))
    parts = [_hashes(words[k: k + TOGETHER + size - 1], size) for k in range(0, len(words) - size + 1, TOGETHER)]
    return _distinct(np.concatenate(parts))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]


def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text with single blanks starts and ends."""
    blanks = np.flatnonzero(data == 32)
    return np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(data)]))


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hash of every shingle, in order."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    data, whole = np.frombuffer(b" ".join(words), dtype=np.uint8), words
    starts, ends = _bounds(data)
    if (ends - starts).max() > LONG:  # every shingle with such a word is long
        words = [w[:LONG] for w in words]
        data = np.frombuffer(b" ".join(words), dtype=np.uint8)
        starts, ends = _bounds(data)
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    if len(words) < size:
        size, starts, ends = len(words), starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts])
    for k in np.flatnonzero(ends - starts >= LONG).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(b" ".join(whole[k: k + size]), digest_size=8).digest(), "little")
    return hashes


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Eight numbers; sets of similarity s share each of them with probability s."""
    parts = [hashes[k: k + TOGETHER] for k in range(0, len(hashes), TOGETHER)]
    return np.min([((part ^ _OFFSETS) * _FACTORS).min(1) for part in parts], axis=0)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; empty sets are similar to nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
