"""Words, shingles and windows of Arrow text columns, hashed in numpy.

Texts of a batch are handled as one byte buffer with row offsets, in pieces of a bounded
size (a longer text is a piece of its own). Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

#: Bytes of words: all but blank and 0x09-0x0D.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words: ASCII letters and digits, and every byte of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes that are hashed at a time.
_CHUNK = 1 << 18
_POWERS, _INVERSES = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_CHUNK, x, np.uint64)])) for x in (_BASE, _BASE_INV))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; starts ascend, and so do ends.

    Ranges are differences of running sums, which are made for some bytes at a time.
    """
    low, high, before = np.empty(len(start), np.uint64), np.empty(len(end), np.uint64), U64(0)
    for at in range(0, len(data) + 1, _CHUNK):
        part = data[at : at + _CHUNK]
        scale = U64(pow(int(_BASE), at, 2**64))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = before
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[part] * _POWERS[: len(part)] * scale, out=sums[1:])
            sums[1:] += before
        before = sums[-1]
        for place, out in ((start, low), (end, high)):
            own = slice(*np.searchsorted(place, (at, at + _CHUNK)))
            out[own] = sums[place[own] - at]
    scales = np.array([pow(int(_BASE_INV), k * _CHUNK, 2**64) for k in range(len(data) // _CHUNK + 1)], np.uint64)
    return mix((high - low) * _INVERSES[start % _CHUNK] * scales[start // _CHUNK] + (end - start).astype(np.uint64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the row offsets (rows + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some texts: row, start and end byte of each, and per row the first word's number."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray = PLAIN, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.rows = len(offs) - 1
        n = len(data)
        if n:
            inside = table[data]
            before = np.empty(n, bool)
            before[0] = False
            before[1:] = inside[:-1]
            cuts = offs[:-1][offs[:-1] < n]
            before[cuts] = False
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = inside[1:]
            after[cuts[cuts > 0] - 1] = False
            self.start = np.flatnonzero(inside & ~before)
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return byte_hashes(self.data, self.start, self.end)


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every k consecutive word hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = mix(np.array([2 * seed + 0x51ED27], np.uint64))[0] | U64(1)
    out, done, scale = np.zeros(n, np.uint64), 0, U64(1)
    part, size, step = h, 1, q
    left = k
    with np.errstate(over="ignore"):
        while left:  # by doubling: part holds the sums over `size` words
            if left & 1:
                out += part[done : done + n] * scale
                done += size
                scale = scale * step
            left >>= 1
            if left:
                part = part[: len(part) - size] + part[size:] * step
                step = step * step
                size *= 2
    return mix(out + U64(k))


def whole_window(words: Words, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows at these word numbers lie in one row."""
    return words.row[starts] == words.row[starts + k - 1]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of every row, as (row, hash), sorted by both.

    A row with fewer words, but not none, has its whole word sequence as its one shingle.
    """
    h = words.hashes()
    g = windows(h, k)
    keep = whole_window(words, np.arange(len(g)), k) if len(g) else np.zeros(0, bool)
    row, value = words.row[: len(g)][keep], g[keep]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        row = np.concatenate([row, short])
        value = np.concatenate([value, np.array([windows(h[words.first[r] : words.first[r + 1]], int(words.counts[r]))[0] for r in short], np.uint64)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]
