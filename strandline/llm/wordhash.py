"""Words of whole texts as 64-bit hashes, vectorised over many texts at once.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A word's hash is a polynomial in random byte values modulo 2**64:
prefix sums over the joined bytes give every word's value with one subtraction, without a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled as needed."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        k = 1
        while k < size:
            out[k : 2 * k] = out[:k] * np.uint64(pow(base, k, 2**64))
            k *= 2
        _powers[which] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the offsets at which each text's words begin (n + 1 of them).

    Null and empty texts have no words.
    """
    arr = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    base, end = int(off[0]), int(off[-1])
    if end == base:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(arr.buffers()[2], np.uint8)[base:end]
    off = off - base
    solid = ~_SPACE[raw]
    edge = solid.copy()  # a word starts where a solid byte follows a blank or a text's start
    edge[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < len(raw)]
    edge[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = solid[tails]
    start, stop = np.flatnonzero(edge), np.flatnonzero(last) + 1
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * _power("p", _P, len(raw))[: len(raw)], out=total[1:])
    h = (total[stop] - total[start]) * _power("i", _PINV, len(raw))[start]
    return mix(h + (stop - start).astype(np.uint64)), np.searchsorted(start, off)


def word_hash(word: str | bytes) -> int:
    """The hash of one word, for tables and tests."""
    w = word.encode() if isinstance(word, str) else word
    return int(words(pa.array([w.decode("utf-8", "surrogateescape") if isinstance(w, bytes) else w], pa.string()))[0][0])


_MUL = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted set of hashed k-word shingles; a text of fewer words has the whole sequence as its one shingle, one without words none."""
    n = len(h)
    window = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        window += h[j : j + len(window)] * _MUL[j]
    window = mix(window)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(window[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            whole = (h[a:b] * _MUL[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
            s = mix(whole ^ np.uint64(0x5BD1E995))
        else:
            s = np.empty(0, np.uint64)
        out.append(s)
    return out
