"""Word and window hashes of UTF-8 text, vectorised over many texts at once.

A text is hashed bytewise: every byte value has a random 64-bit number, and a word is the polynomial of its
bytes' numbers modulo 2 ** 64. Prefix sums of number x base ** -i give the polynomial of any stretch, so
neither words nor windows are looped over in Python. Windows of words are polynomials of the word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at a time; a longer text is hashed alone.
BLOCK = 1 << 20

_random = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _random.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_BASE, _WORD_BASE = (int(x) | 1 for x in _random.integers(2**62, 2**64, 2, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        row = np.full(max(n, 1 << 16), base & (2**64 - 1), dtype=np.uint64)
        row[0] = 1
        known = _powers[base] = np.cumprod(row)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair."""
    inverse = pow(base, -1, 2**64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(inverse, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(base, len(values) + 1)[starts])


def word_hashes(texts: list[bytes], lower: bool = False, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text begins (one more than texts).

    Words are runs of bytes that ``between`` (a flag for each byte value, set for the line feed) does not mark,
    by default bytes other than ASCII white space; ``lower`` maps A-Z to a-z first.
    """
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = between[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = stretches((_LOWER if lower else _BYTES)[data], starts, ends, _BYTE_BASE)
    return hashes, np.searchsorted(starts, begins)


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every window of ``width`` consecutive words, whatever text they belong to."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    values = words if not salt else mix(words + np.uint64(salt))
    return stretches(values, at, at + width, _WORD_BASE)


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about ``most`` bytes together."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > most:
            yield begin, i
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)
