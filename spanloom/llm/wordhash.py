"""Word and shingle hashes of whole Arrow batches, in numpy: no Python object per document or word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = [np.uint64(x | 1) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SPAN = 1 << 17
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            powers = np.full(n, base, dtype=np.uint64)
            powers[0] = 1
            _powers[name] = np.multiply.accumulate(powers)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data and data.size else np.zeros(0, np.uint8), at


def word_hashes(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, n + 1 word offsets) for runs of rows of about 128 KB; a longer text makes a longer run."""
    data, at = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + _SPAN, "right")) - 1)
        part, cuts = data[at[row] : at[end]], at[row : end + 1] - at[row]
        part = _LOWER[part] if lower else part
        solid = ~_WHITE[part]
        first = np.zeros(len(part) + 1, bool)
        first[cuts] = True
        before = np.empty_like(solid)
        before[:1], before[1:] = False, solid[:-1]
        starts = np.flatnonzero(solid & (~before | first[:-1]))
        after = np.empty_like(solid)
        after[-1:], after[:-1] = False, solid[1:]
        ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        up, down = _tables(max(_SPAN * 2, len(part) + 1))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP[0])
        yield row, hashes, np.searchsorted(starts, cuts)
        row = end


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of every k consecutive words, from running sums of words times powers of the base."""
    up, down = _tables(max(_SPAN * 2, len(words) + 1))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    n = max(0, len(words) - k + 1)
    return (sums[k : k + n] - sums[:n]) * down[:n]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles); fewer words: the whole sequence as one; no word: empty."""
    steps = [np.uint64(pow(int(_STEP[j % 5]), j // 5 + 1, 1 << 64)) for j in range(k)]
    for row, words, cuts in word_hashes(column):
        total = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            total += words[j : len(words) - k + 1 + j] * steps[j] if len(total) else 0
        total = mix(total)
        for i in range(len(cuts) - 1):
            a, b = int(cuts[i]), int(cuts[i + 1])
            if b - a >= k:
                own = np.sort(total[a : b - k + 1])
                yield row + i, own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                parts = np.append(words[a:b] * np.array(steps[: b - a]), np.array([b - a], np.uint64) * _STEP[1])
                yield row + i, mix(parts.sum(dtype=np.uint64, keepdims=True))
            else:
                yield row + i, np.zeros(0, np.uint64)
