"""Hashes of all words of a text at once, by running sums over its bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

A = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes that are hashed together, up to the next end of a word: few enough that their numbers stay in a core's cache.
CHUNK = 1 << 16
#: A word's hash is the sum of its bytes' values times powers of an odd base, so that running sums give those of all words.
BASE = 0x5851F42D4C957F2D
#: Longer spans are hashed by themselves: sums of powers modulo 2**64 agree for some pairs of long words, whatever the base.
LONG = 128
_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _powers_of(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 2 * CHUNK), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 2 * CHUNK:
            _powers[base] = known
    return known[:n]


def span_hashes(value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of a sequence of values: from running sums, and by xxh3 for those over ``LONG``."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * _powers_of(BASE, len(value)), out=total[1:])
    h = mixed((total[last] - total[first]) * _powers_of(pow(BASE, -1, 1 << 64), len(value))[first])
    for k in np.flatnonzero(last - first > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(value[first[k] : last[k]].tobytes())
    return h


def word_spans(raw: bytes, finer: Callable | None = None, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of a text; words end at ASCII white space.

    ASCII letters count as lower case if ``lower``. ``finer`` (bytes, starts, ends) may give other starts and ends for the words of a chunk.
    """
    data = np.frombuffer(raw.translate(LOWER) if lower else raw, np.uint8)
    space, value = (data == 32) | (data - np.uint8(9) < 5), mixed(np.arange(1, 257, dtype=np.uint64) * A)
    starts, ends, hashes, x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while x < len(data):
        z = x + CHUNK
        while z < len(data) and not space[z : z + CHUNK].any():
            z += CHUNK
        z = min(len(data), z if z >= len(data) else z + int(space[z : z + CHUNK].argmax()))
        blank = np.r_[True, space[x:z], True]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = edge[::2], edge[1::2]
        if finer is not None:
            first, last = finer(data[x:z], first, last)
        hashes.append(span_hashes(value[data[x:z]], first, last))
        starts.append(first + x)
        ends.append(last + x)
        x = z
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def word_hashes(raw: bytes, finer: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word, of lower-cased ASCII letters."""
    start, _, h = word_spans(raw, finer)
    return start, h


class Known:
    """Numbers for hashes, in order of first sight by batch."""

    def __init__(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each hash, and where the first of each new number stands, in order of the new numbers."""
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        out = self.codes[at] if len(self.keys) else np.zeros(len(h), np.int64)
        miss = np.flatnonzero(~hit)
        if not len(miss):
            return out, miss
        new, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
        numbers = len(self.keys) + np.arange(len(new))
        out[miss] = numbers[which]
        place = np.searchsorted(self.keys, new)
        self.keys, self.codes = np.insert(self.keys, place, new), np.insert(self.codes, place, numbers)
        return out, miss[first]
