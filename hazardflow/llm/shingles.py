"""Word shingles of whole texts as sets of 64-bit numbers, computed on byte arrays for many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
_U64 = np.uint64
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of the public splitmix64 generator)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


# Random 64-bit values of the bytes; upper-case ASCII letters have those of the lower-case ones.
_BYTE = _mix(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE, _STEP = 0xD1342543DE82EF95 | 1, 0xA24BAED4963EE407 | 1
_powers = {"up": np.ones(1, dtype=_U64), "down": np.ones(1, dtype=_U64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        series = np.full(n, base, dtype=_U64)
        series[0] = 1
        _powers[kind] = np.multiply.accumulate(series)
    return _powers[kind][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and where each text's words begin (one more entry: the end)."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in encoded])
    data = np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    begin, end = edge[0::2], edge[1::2]
    # A word's polynomial is a difference of prefix sums, moved back to exponent zero.
    prefix = np.zeros(len(data) + 1, dtype=_U64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=prefix[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    hashes = (prefix[end] - prefix[begin]) * _power("down", inverse, len(data))[begin]
    hashes = _mix(hashes ^ _mix((end - begin).astype(_U64)))
    return hashes, np.concatenate([[0], np.searchsorted(begin, ends, side="left")])


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``words`` consecutive words, or the whole of a shorter text.

    Words are what stands between the six ASCII white-space characters, A-Z in lower case. A text without words
    has the empty set.
    """
    hashes, at = word_hashes(texts)
    n = max(0, len(hashes) - words + 1)
    grams = np.zeros(n, dtype=_U64)
    for k in range(words):
        grams += hashes[k : k + n] * _U64(pow(_STEP, k, 1 << 64))
    grams = _mix(grams)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(grams[a : b - words + 1]))
        elif b > a:  # a sequence of fewer words never equals one of another length
            value = sum(int(h) * pow(_STEP, k, 1 << 64) for k, h in enumerate(hashes[a:b])) + (b - a)
            sets.append(_mix(np.array([value & _MASK], dtype=_U64)))
        else:
            sets.append(np.zeros(0, dtype=_U64))
    return sets


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
