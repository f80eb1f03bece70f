"""Vectorised byte, word and window hashing over Arrow string arrays.

Every function works on a whole slice of documents at once: the UTF-8 buffer of the Arrow array
is viewed as one numpy array and documents are ranges of it, so no Python loop runs per word or
per character. Hashes depend only on the bytes hashed, never on the batch, the task or the
process, so equal words, shingles and windows meet in later shuffles.

Nulls count as empty texts. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which
are the code points outside these in UTF-8 too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are worked on in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit words (a new array)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _table(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0xD1B54A32D192ED03 % (1 << 64)))


class Ranges:
    """Hashes of ranges of a sequence of 64-bit values: the sum of each value times a random odd number that
    belongs to its place in the range, modulo 2**64, mixed with the length. Places have unrelated factors, so
    no pattern of values can cancel out, as it can in a polynomial. Rangers with other seeds are independent."""

    def __init__(self, seed: int):
        self.seed, self._factors = seed, np.empty(0, dtype=U64)

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranges, none of them empty, from start to end; they may overlap."""
        size = end - start
        if not len(size):
            return np.empty(0, dtype=U64)
        longest = int(size.max())
        if len(self._factors) < longest:
            self._factors = _table(self.seed * 1000 + 19, max(longest, 4096)) | U64(1)
        first = np.cumsum(size) - size
        place = np.arange(int(first[-1] + size[-1])) - np.repeat(first, size)
        x = values[place + np.repeat(start, size)]
        x *= self._factors[place]
        return mix(np.add.reduceat(x, first) + size.astype(U64) * U64(0x9E3779B97F4A7C15))


#: How many bytes of a word are taken in steps of eight; longer words are summed by Ranges.
_STEPS = 256
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    data = np.ascontiguousarray(data)
    return np.ndarray(max(0, len(data) - 7), dtype="<u8", buffer=data, strides=(1,))


def byte_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """The hashes of ranges of bytes, none of them empty: eight bytes a step, each step mixed."""
    keys = _table(seed * 1000 + 29, 2) | U64(1)
    eight = _eights(np.concatenate([data, np.zeros(8, dtype=np.uint8)]))
    size = end - start
    h = eight[start] & _MASK[np.minimum(size, 8)]
    h += size.astype(U64) * keys[0]
    live, at = np.flatnonzero(size > 8), 8
    live = live[size[live] <= _STEPS]
    while len(live):
        x = h[live] * keys[1]
        x ^= x >> U64(32)
        x += eight[start[live] + at] & _MASK[np.minimum(size[live] - at, 8)]
        h[live] = x
        at += 8
        live = live[size[live] > at]
    h = mix(h)
    long = np.flatnonzero(size > _STEPS)
    if len(long):
        # random but for the lowest byte, which tells any two bytes apart
        values = (_table(seed * 1000 + 17, 256) << U64(8)) | np.arange(256, dtype=U64)
        h[long] = Ranges(seed).ranges(values[data], start[long], end[long])
    return h


def windows(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hash of every range of k 64-bit values (none if there are fewer), as a tree: two hashes of halves
    make one of the whole, each step mixed, so that no pattern of values is bad. Seeds are independent."""
    keys = _table(seed * 1000 + 23, 66) | U64(1)
    return _finished(_doubled(values * keys[65], 1, k, keys), keys)


def byte_windows(data: np.ndarray, k: int, seed: int, part: int = 1 << 15) -> np.ndarray:
    """The hash of every range of k bytes (none if there are fewer)."""
    keys = _table(seed * 1000 + 23, 66) | U64(1)
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.empty(n, dtype=U64)
    for lo in range(0, n, part):  # in parts that a processor's cache holds
        piece = data[lo : lo + part + k - 1]
        x, size = (_eights(piece), 8) if k >= 8 else (piece.astype(U64), 1)
        x = x * keys[65]
        x ^= x >> U64(32)
        out[lo : lo + part] = _finished(_doubled(x, size, k, keys), keys)
    return out


def _finished(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x = x * keys[64]
    x ^= x >> U64(32)
    x *= keys[63]
    return x


def _doubled(x: np.ndarray, size: int, k: int, keys: np.ndarray) -> np.ndarray:
    """Hashes of ranges of k, given those of ranges of size."""
    level = 0
    while size < k:
        step = min(size, k - size)
        if len(x) <= step:
            return np.empty(0, dtype=U64)
        left = x[:-step] * keys[level]
        left ^= left >> U64(32)
        left += x[step:]
        x, size, level = left, size + step, level + 1
    return x


def text_slices(arr: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about SLICE_BYTES; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < len(arr):
        end = int(np.searchsorted(offs, offs[first] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(arr))
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


class Words:
    """The words of a slice: starts and ends in bytes, and offs, the first word of each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        inside = ~_SPACE[data]
        self.data, self.text_offs = data, offs
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offs] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offs = np.searchsorted(self.starts, offs)

    def hashes(self, seed: int, lower: bool = False) -> np.ndarray:
        return byte_ranges(_LOWER[self.data] if lower else self.data, self.starts, self.ends, seed)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every range of w values, by doubling."""
    if len(x) < w:
        return x[:0]
    done, cur = 1, x
    while done * 2 <= w:
        cur = np.minimum(cur[:-done], cur[done:])
        done *= 2
    return cur if done == w else np.minimum(cur[: len(x) - w + 1], cur[w - done : w - done + len(x) - w + 1])
