"""Vectorised text kernels shared by the corpus operators.

Every kernel works on the UTF-8 bytes of a whole Arrow batch at once: words are
found by a byte table, and a word's hash is the scrambled sum of its bytes, each
scrambled with its place in the word.  The hash of any run of units, which only ever
chooses what is compared, is a difference of prefix sums of ``(unit + 1) * R**position``,
shifted back by the inverse of ``R`` modulo 2**64.  No kernel makes a Python object per
word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for i below n, kept up to four million entries."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up, down = np.full(size, BASE, U64), np.full(size, BASE_INVERSE, U64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 22:
            return up[:n], down[:n]
        _powers["up"], _powers["down"] = up, down
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x = x * U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


class RunHash:
    """Hashes of arbitrary runs ``units[start:end]`` of one sequence of integers."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.up, self.down = powers(n + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, U64)
            np.cumsum((units.astype(U64) + U64(1)) * self.up[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.total[end] - self.total[start]) * self.down[start]
            return mix(x + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def fixed(self, q: int) -> np.ndarray:
        """The hash of every run of q units."""
        n = len(self.total) - q
        with np.errstate(over="ignore"):
            return mix((self.total[q:] - self.total[:n]) * self.down[:n])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data`` and the n + 1 offsets of each text's words."""
    inside = ~separator[data]
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        before[edge] = False
        after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of every text."""
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        _, _, w = words(data[offsets[i] : offsets[j]], at)
        out[i:j] = np.diff(w)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every word, and the texts' word offsets."""
    starts, ends, at = words(data, offsets, separator)
    return span_hashes(data, starts, ends), starts, ends, at


#: Scrambled (byte, place) pairs of the first places; further ones are scrambled as they come.
_pairs = np.zeros((0, 256), U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each span ``data[start:end]``, a sum that is no polynomial, so periodic words don't collide."""
    global _pairs
    if not len(_pairs):
        _pairs = mix(np.arange(64 * 256, dtype=U64).reshape(64, 256) + U64(0x5851F42D4C957F2D))
    size = ends - starts
    out = np.zeros(len(starts), U64)
    with np.errstate(over="ignore"):
        order = np.argsort(-np.minimum(size, 64).astype(np.int8), kind="stable")
        begin, n = starts[order], size[order]
        total = np.zeros(len(order), U64)
        live = len(order)
        for place in range(int(min(64, n.max(initial=0)))):
            live = int(np.searchsorted(-np.minimum(n[:live], 64), -place))
            total[:live] += _pairs[place][data[begin[:live] + place]]
        for i in np.flatnonzero(n > 64):
            rest = data[begin[i] + 64 : begin[i] + n[i]].astype(U64)
            total[i] += mix((np.arange(64, n[i], dtype=U64) * U64(256) + rest) + U64(0x5851F42D4C957F2D)).sum(dtype=U64)
        out[order] = mix(total + n.astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries, by doubling."""
    n, have = len(x) - w + 1, 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n]) if have < w else x[:n]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers ``starts[i] .. starts[i] + counts[i] - 1``, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, counts)


_trim = None


def release() -> None:
    """Gives freed memory back to the system; a worker that serves many groups else keeps the largest one's."""
    global _trim
    if _trim is None:
        import ctypes

        try:
            _trim = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # not glibc
            _trim = lambda _: 0
    pa.default_memory_pool().release_unused()
    _trim(0)
