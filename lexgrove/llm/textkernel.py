"""Vectorised text kernel shared by the operators of this subpackage.

Texts arrive as Arrow string columns; one column is one byte buffer plus
offsets, and everything here works on that buffer with numpy: token spans,
64-bit token hashes and window hashes cost a handful of array passes per byte
and no Python object per token.  Buffers are walked in pieces of about one
megabyte that end between tokens, so the temporary arrays stay small however
long a single text is.

A token's hash is the sum of its eight-byte blocks, each mixed together with its
place, and of its length, mixed once more: there is no structure (as in polynomials
modulo 2**64) by which regular words share a hash.  Hashes are the same in every
process and at every size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise; returns a new array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = stream(11, 64) | _U(1)
_PLACE, _LENGTH = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Masks of the first 0 to 8 bytes of a block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; A-Z count as a-z."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data]
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    total = mix((words[starts] & _FIRST[np.minimum(size, 8)]) + _PLACE)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # blocks behind the first
        first = np.cumsum(more) - more
        nth = np.arange(1, int(more.sum()) + 1) - np.repeat(first, more)
        at = np.repeat(starts[long], more) + 8 * nth
        block = words[at] & _FIRST[np.minimum(np.repeat(ends[long], more) - at, 8)]
        total[long] += np.add.reduceat(mix(block + (nth + 1).astype(np.uint64) * _PLACE), first)
    total += size.astype(np.uint64) * _LENGTH
    return mix(total)


#: ASCII white space of the word contracts: space and \t \n \v \f \r.
SPACE_TABLE = np.ones(256, np.uint8)
SPACE_TABLE[[32, 9, 10, 11, 12, 13]] = 0


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about PIECE bytes that cut no token (class 0 of table separates)."""
    lo, end = 0, len(data)
    while lo < end:
        hi = min(end, lo + PIECE)
        if hi < end:
            start = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            base = max(lo, hi - 4096)
            gaps = np.flatnonzero(table[data[base:hi]] == 0)
            cut = max(start, base + int(gaps[-1]) if len(gaps) else 0)
            if cut <= lo:  # one very long token: go on to where it ends
                cut = int(offsets[np.searchsorted(offsets, lo, "right")])
                at = hi
                while at < cut:
                    gaps = np.flatnonzero(table[data[at : min(cut, at + PIECE)]] == 0)
                    if len(gaps):
                        cut = at + int(gaps[0])
                        break
                    at += PIECE
            hi = cut
        yield lo, hi
        lo = hi


class Tokens:
    """Spans and hashes of the tokens of a column; text d has tokens bounds[d]:bounds[d + 1]."""

    __slots__ = ("starts", "ends", "hashes", "bounds")

    def __init__(self, starts, ends, hashes, bounds):
        self.starts, self.ends, self.hashes, self.bounds = starts, ends, hashes, bounds


def tokenize(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACE_TABLE, single: int = -1, refine=None) -> Tokens:
    """Cuts texts where the byte class changes; class 0 separates, each byte of class `single` is a token.

    A-Z count as a-z in the hashes.  refine(classes, piece) may change the byte
    classes of a piece in place.
    """
    all_starts, all_ends, all_hashes = [], [], []
    with np.errstate(over="ignore"):
        for lo, hi in _pieces(data, offsets, table):
            piece = data[lo:hi]
            kind = table[piece]
            if refine is not None:
                refine(kind, piece)
            edge = np.empty(len(piece), bool)
            edge[0] = True
            np.not_equal(kind[1:], kind[:-1], out=edge[1:])
            if single >= 0:
                edge |= kind == single
                edge[1:] |= kind[:-1] == single
            first, last = np.searchsorted(offsets, (lo, hi), "left")
            inner = offsets[first:last] - lo
            edge[inner[inner < len(piece)]] = True
            starts = np.flatnonzero(edge)
            ends = np.append(starts[1:], len(piece))
            keep = kind[starts] != 0
            starts, ends = starts[keep], ends[keep]
            all_starts.append(starts + lo)
            all_ends.append(ends + lo)
            all_hashes.append(span_hashes(piece, starts, ends))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts = join(all_starts, np.int64)
    return Tokens(starts, join(all_ends, np.int64), join(all_hashes, np.uint64), np.searchsorted(starts, offsets, "left"))


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each window of k hashes (order counts); shorter by k - 1 than its input."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > len(_STEP):
        return mix(Runs(hashes).windows(k) + _U(salt))
    with np.errstate(over="ignore"):
        total = hashes[:n] * _STEP[0]
        for i in range(1, k):
            total += hashes[i : i + n] * _STEP[i]
        total += _U(salt + k) * _U(0xA0761D6478BD642F)
        return mix(total)


class Runs:
    """Window hashes of any length over one sequence, from those of lengths that are powers of two."""

    def __init__(self, hashes: np.ndarray):
        self.levels = [hashes]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(mix(a) * _STEP[0] + b * _STEP[1])

    def windows(self, k: int) -> np.ndarray:
        """Hash of each window of k, to be compared with those of the same k; two windows that overlap make one."""
        n, top = len(self.levels[0]) - k + 1, k.bit_length() - 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        while len(self.levels) <= top:
            half, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(self._pair(half[:-step], half[step:]))
        last = k - (1 << top)
        return self._pair(self.levels[top][:n], self.levels[top][last : last + n])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text.

    A text of fewer than k words has its whole sequence as one shingle; a text
    without words has none.
    """
    words = tokenize(data, offsets)
    whole = windows(words.hashes, k)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        else:
            yield windows(words.hashes[a:b], b - a, salt=1000) if b > a else np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, column: str | int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts hold about `most` bytes together."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), n)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(a, b - a)
    _give_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _give_back() -> None:
    """Memory that a batch no longer needs goes back to the system: workers outlive their tasks."""
    if _trim is not None:
        _trim(0)
    pa.default_memory_pool().release_unused()
