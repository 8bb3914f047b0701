"""Vectorised text primitives shared by the corpus operators.

All of them work on the flat UTF-8 buffer of an Arrow string column, a few
hundred kilobytes at a time, so a worker's memory does not depend on the size
of a batch (a single document larger than a chunk is a chunk of its own).

Hashes are 64 bits wide. Spans of bytes are taken in eight bytes at a time, and
spans of a sequence by doubling blocks; every step is a multiplication and a
shift, so that no arrangement of a text (periodic or self-similar) makes terms
cancel. A given pair of different strings agrees with a probability of about
2**-64; over N strings some pair does with N**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
# Arbitrary odd multipliers.
STEP = 0x9E3779B97F4A7C15
SHIFT = 0xD6E8FEB86659FD93
LENGTH = 0xA24BAED4963EE407
#: Spans of more bytes are hashed one by one.
LONG = 2048
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes."""
    left = ends - starts
    h = mix(left.astype(U64) * U64(LENGTH) + U64(STEP))
    for i in np.flatnonzero(left > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    eight, which = _eights(data), np.flatnonzero((left > 0) & (left <= LONG))
    at, left = starts[which], left[which]
    while len(which):
        h[which] = mix((h[which] ^ (eight[at] & _MASK[np.minimum(left, 8)])) * U64(STEP))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return h


class Spans:
    """Hashes of spans of a sequence: two overlapping blocks of a power of two cover a span.

    Blocks double from one call to the next, and only the last size is held, so
    calls must not go back to shorter spans than half of an earlier one's.
    """

    def __init__(self, units: np.ndarray) -> None:
        """units: bytes, or 64-bit hashes of a sequence's members."""
        self.n = len(units)
        self.data = units if units.dtype == np.uint8 else None
        self.size, self.block = (0, None) if self.data is not None else (1, units)

    def _reach(self, size: int) -> np.ndarray:
        if self.size > size:
            raise ValueError("blocks have grown past this size")
        if self.data is not None and self.size < 8:
            self.size = min(size, 8)
            self.block = mix((_eights(self.data)[: self.n] & _MASK[self.size]) * U64(STEP))
        while self.size < size:
            h = self.block[: max(0, len(self.block) - self.size)]
            self.block = (h ^ (h >> U64(32))) * U64(STEP) + self.block[self.size :] * U64(SHIFT)
            self.size *= 2
        return self.block

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        out = np.zeros(len(start), U64)
        sizes = np.left_shift(1, np.frexp(length.astype(np.float64))[1] - 1)
        for size in np.unique(sizes).tolist():
            of = sizes == size
            block, a, b = self._reach(size), start[of], end[of] - size
            h = block[a]
            out[of] = mix((h ^ (h >> U64(32))) * U64(STEP) + block[b] * U64(SHIFT) + length[of].astype(U64) * U64(LENGTH))
        return out

    def hash_all(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length, as hash gives them."""
        size = 1 << (length.bit_length() - 1)
        block, n = self._reach(size), max(0, self.n - length + 1)
        h = block[:n]
        return mix((h ^ (h >> U64(32))) * U64(STEP) + block[length - size : length - size + n] * U64(SHIFT) + U64(length * LENGTH & (1 << 64) - 1))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off.astype(np.int64)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole rows of about `size` bytes."""
    data, off = flat(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and per row the index of its first word."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hash_spans(data, starts, ends)


_PLACES = [pow(SHIFT, j + 1, 1 << 64) ^ (j << 17) for j in range(64)]


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; those across rows are the caller's to skip."""
    n = max(0, len(w) - k + 1)
    h = np.zeros(n, U64)
    for j in range(k):
        h += w[j : j + n] * U64(_PLACES[j] | 1)
    return mix(h)


def shingle_set(w: np.ndarray, shingles: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one row: w are its words, shingles those that start in it.

    Fewer than k words make one shingle of the whole sequence, none an empty set.
    """
    if len(w) >= k:
        return np.unique(shingles[: len(w) - k + 1])
    if not len(w):
        return np.zeros(0, U64)
    places = np.array([p | 1 for p in _PLACES[: len(w)]], U64)
    return mix(np.array([np.sum(w * places) + U64(len(w))], U64))


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of each w consecutive values (compared by their upper 32 bits)."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    padded = -(-len(values) // w) * w
    keys = np.full(padded, np.iinfo(U64).max, U64)
    keys[: len(values)] = (values >> U64(32) << U64(32)) | np.arange(len(values), dtype=U64)
    blocks = keys.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & U64(0xFFFFFFFF)).astype(np.int64)


def anchor_runs(units: Spans, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Hashes of all k-unit strings, and windows of `length` units of every row, grouped by their anchor.

    A window's anchor is the leftmost minimum of the hashes of its k-unit
    strings, so equal windows have equal anchors at equal places. Windows with
    one anchor are consecutive: `lo` to `hi` are their starts, `at` the anchor.
    """
    n = int(off[-1])
    empty = {x: np.zeros(0, np.int64) for x in ("row", "lo", "hi", "at")}
    if n < length:
        return np.zeros(0, U64), empty
    strings = units.hash_all(k)
    at = sliding_argmin(strings, length - k + 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    valid = np.flatnonzero(np.arange(len(at)) + length <= off[1:][row])
    if not len(valid):
        return strings, empty
    at, row = at[valid], row[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return strings, {"row": row[first], "lo": valid[first], "hi": valid[last], "at": at[first]}
