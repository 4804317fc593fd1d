"""Vectorised text primitives over UTF-8 buffers.

Texts of an Arrow batch lie in one byte buffer.  They are taken in chunks of a
few hundred kilobytes (one text, where a text is longer), so that the arrays
below stay in the processor's cache.  Hashes are polynomials modulo 2**64 from
prefix sums, passed through a 64-bit finaliser.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIBRARY = ctypes.CDLL(None)
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 18

_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_POWERS[0]) < n:
        for k, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, _U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=_U)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    h = h ^ (h >> _U(31))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j for j < i."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values.astype(_U, copy=False) * up[: len(values)], out=out[1:])
    return out


def spans_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each [start, end) of the sequence behind prefix sums p."""
    _, down = powers(len(p))
    h = (p[ends] - p[starts]) * down[starts]
    h += (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix(h)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of h."""
    if len(h) < n:
        return np.zeros(0, _U)
    p = prefix(h)
    _, down = powers(len(p))
    return mix((p[n:] - p[:-n]) * down[: len(h) - n + 1] + _U(n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive entries."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : len(x) - have + 1])
    return out


def class_table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true in the given inclusive ranges of bytes."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


# Bytes of words split at [\x20\x09-\x0D], and the symbols.
NOT_SPACE = ~class_table((0x20, 0x20), (0x09, 0x0D))
SYMBOLS = class_table(*[(b, b) for b in b"#*$%&|<>"])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "")
    else:
        column = pc.fill_null(column, b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), off


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows."""
    data, off = utf8(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of the texts of a chunk: byte spans, and the first word of each text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, inside: np.ndarray = NOT_SPACE):
        word = inside[buf]
        first = np.zeros(len(buf) + 1, bool)
        first[off] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | first[1 : len(buf)]
        end = word.copy()
        end[:-1] &= ~word[1:] | first[1 : len(buf)]
        self.buf, self.off = buf, off
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)  # of each text; one more at the end
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, p: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word; p: prefix sums over the bytes plus one."""
        p = prefix(self.buf.astype(_U) + _U(1)) if p is None else p
        return spans_hash(p, self.starts, self.ends)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))


def repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, equals an earlier entry) for each entry of h."""
    n = len(h)
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return many, later
    bits = max(1, int(n - 1).bit_length())
    low = _U((1 << bits) - 1)
    key = (h & ~low) | np.arange(n, dtype=_U)
    key.sort()
    pos = (key & low).astype(np.int64)
    near = (key[1:] >> _U(bits)) == (key[:-1] >> _U(bits))
    at = np.flatnonzero(near)
    if len(at) and not np.array_equal(h[pos[at]], h[pos[at + 1]]):  # high bits alone agree
        pos = np.argsort(h, kind="stable")
        s = h[pos]
        near = s[1:] == s[:-1]
    many[pos[1:][near]] = True
    later[pos[1:][near]] = True
    many[pos[:-1][near]] = True
    return many, later


def covered(at: np.ndarray, n: int, length: int) -> np.ndarray:
    """Mask of length entries, true within n of each position in at."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, at, 1) if len(at) < 64 else step.__iadd__(np.bincount(at, minlength=length + 1)[: length + 1].astype(np.int32))
    stop = at + n
    step -= np.bincount(stop, minlength=length + 1)[: length + 1].astype(np.int32)
    return np.cumsum(step[:-1]) > 0


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBRARY, "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """run (over batches or for a group) that gives memory back at its end."""

    @functools.wraps(run)
    def one(rows):
        out = run(rows)
        if not isinstance(out, Iterator):
            give_back()
            return out
        return _to_the_end(out)

    return one


def _to_the_end(batches: Iterator) -> Iterator:
    try:
        yield from batches
    finally:
        give_back()


#: Bytes of an Arrow batch, from which Spark closes it.
BATCH_BYTES = 4 << 20


def modest_batches(spark, rows: int = 2048) -> None:
    """Arrow batches bounded by rows and by bytes, for tables with long texts.

    The bounds stay set on the session: plans read them when they run.
    """
    have = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < have <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
