"""Substring deduplication by level-wise doubling of repeated windows.

The first level takes windows of ``first`` words, each level twice as many as
the one before, the last one ``window``.  Every span of ``window`` words holds
windows of a level's length; the one of least hash stands for the span there.
Windows that occur in one document alone are dropped with their spans; only
spans whose window repeats are extended to the next length and compared again,
until none survives.  The last comparison, of whole spans, finds the smallest
identifier of each.

A word is removed if a span that covers it also starts in a document with a
smaller identifier.

Defined results: null texts have no words; texts shorter than ``window`` words
lose nothing; rows with equal identifiers are one document and do not remove
each other's words; rows with a null identifier are left whole and remove
nothing; an empty table gives no row; extra columns are never read
(identifiers that are no whole numbers are an error).  Spans are compared by 96
hash bits.  A text is never split: a task holds one block of a few megabytes
or one text, about 60 bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import blocks as bl
from weft.llm import textops as tx
from weft.shared import materialise

WINDOW = 13
#: Words of a window of the first level.
FIRST = 4
_U = np.uint64
_NONE = np.iinfo(np.int64).max


def levels(window: int, first: int = FIRST) -> list[int]:
    """Lengths of windows: doubled from the first on, the last one ``window``."""
    out = []
    while first < window:
        out.append(first)
        first *= 2
    return [*out, window]


class _Block:
    """Words of a block's texts, and the windows that stand for its spans at each level."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        column = table["id"].combine_chunks()
        self.ids = column.fill_null(_NONE).to_numpy(zero_copy_only=False)
        named = ~np.asarray(column.is_null())
        self.parts, self.hashes, spans, owner = [], [], [], []
        base = 0
        for i, j, buf, off in tx.chunks(table["text"]):
            words = tx.Words(buf, off)
            self.parts.append((i, j, words, base))
            text = words.text_of() + i
            at = np.flatnonzero((words.room() >= window) & named[text])
            self.hashes.append((words.hashes(), at))
            spans.append(base + at)
            owner.append(text[at])
            base += len(words)
        self.n_words = base
        self.start = _joint(spans, np.int64)  # first word of each span
        self.doc = self.ids[_joint(owner, np.int64)]  # identifier of the span's document

    def windows(self, n: int) -> np.ndarray:
        """Hash of the window of n words that stands for each span."""
        out = []
        for h, at in self.hashes:
            g = tx.grams(h, n)
            out.append(g[bl.owners(g, self.window - n + 1)[at]] if len(at) else g[:0])
        return _joint(out, _U)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each span: a hash and a check."""
        other = lambda h: tx.mix(h ^ _U(0x5851F42D4C957F2D))
        hashes = [(tx.grams(h, self.window)[at], tx.grams(other(h), self.window)[at]) if len(at) else (h[:0], h[:0]) for h, at in self.hashes]
        return _joint([a for a, _ in hashes], _U), (_joint([b for _, b in hashes], _U) >> _U(32)).astype(np.uint32)

    def level(self, alive: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of n words of some spans: (distinct ones in order, held by two identifiers here, each span's)."""
        h, d = self.windows(n)[alive], self.doc[alive]
        order = np.lexsort((d, h))
        hs, ds = h[order], d[order]
        new = np.ones(len(hs), bool)
        new[1:] = hs[1:] != hs[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hs)) - 1 if len(hs) else first
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        return hs[first], ds[last] != ds[first], place

    def survivors(self, lengths: list[int], replies: list[dict[int, bytes]], n_buckets: int) -> np.ndarray:
        """Spans whose windows of all these lengths repeat."""
        alive = np.arange(len(self.start))
        for n, reply in zip(lengths, replies, strict=True):
            if not reply:
                return alive[:0]
            kinds, _, place = self.level(alive, n)
            alive = alive[bl.bits_of(reply, _bucket(kinds, n_buckets))[place]]
        return alive

    def last_level(self, alive: np.ndarray, n_buckets: int) -> tuple[np.ndarray, ...]:
        """(hashes, checks, least identifiers, buckets, entry of each alive span)."""
        h, c = self.whole()
        h, c, d = h[alive], c[alive], self.doc[alive]
        order = np.lexsort((d, c, h))
        hs, cs = h[order], c[order]
        new = np.append(True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])) if len(hs) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        entry = np.empty(len(h), np.int64)
        entry[order] = np.cumsum(new) - 1
        return hs[first], cs[first], d[order][first], _bucket(hs[first], n_buckets), entry


def _joint(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hash space."""
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _repeated(data: list[bytes]) -> list[bytes | None]:
    """For arrays of distinct windows, with a byte each that tells if one repeats in its own block: which
    repeat there or are in another array too."""
    sizes = [len(d) // 9 for d in data]
    here = [np.frombuffer(d, np.uint8, offset=8 * n).astype(bool) for d, n in zip(data, sizes, strict=True)]
    other = bl.in_many([d[: 8 * n] for d, n in zip(data, sizes, strict=True)])
    hits = [own if x is None else own | np.unpackbits(np.frombuffer(x, np.uint8), count=len(own)).astype(bool) for own, x in zip(here, other, strict=True)]
    return [np.packbits(h).tobytes() if h.any() else None for h in hits]


def _least(data: list[bytes]) -> list[bytes | None]:
    """Which entries have a smaller identifier in another block."""
    kind = np.dtype([("h", "<u8"), ("c", "<u4"), ("d", "<i8")])
    arrays = [np.frombuffer(x, kind) for x in data]
    every = np.concatenate(arrays)
    h, c, d = (np.ascontiguousarray(every[k]) for k in "hcd")
    order = np.lexsort((d, c, h))
    hs, cs, ds = h[order], c[order], d[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1]))
    least = ds[np.flatnonzero(new)][np.cumsum(new) - 1]
    beaten = np.empty(len(every), bool)
    beaten[order] = least < ds
    out: list[bytes | None] = []
    at = 0
    for a in arrays:
        part = beaten[at : at + len(a)]
        out.append(np.packbits(part).tobytes() if part.any() else None)
        at += len(a)
    return out


def remove_repeated(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, first: int = FIRST, texts: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, if asked for, kept (text).

    Each level but the last is an exchange of packed window hashes, whose
    answers, a bit for each distinct window, are checkpointed.
    """
    packed = bl.pack(documents, id_col, text_col)
    n = bl.buckets_for(packed, 0.6)
    lengths, done, answers = levels(window, first), [], []

    def ask(lengths: list[int], size: int):
        def run(table: pa.Table, replies: list) -> Iterator[tuple[int, bytes]]:
            block = _Block(table, window)
            kinds, here, _ = block.level(block.survivors(lengths, replies, n), size)
            for b, i, j in bl.split(_bucket(kinds, n)):
                yield b, kinds[i:j].tobytes() + here[i:j].astype(np.uint8).tobytes()

        return run

    for size in lengths[:-1]:
        found = materialise(bl.exchange(bl.with_replies(packed, *answers), ask(list(done), size), _repeated))
        done.append(size)
        answers.append(found)
        if found.isEmpty():  # no candidate survives
            break

    kind = np.dtype([("h", "<u8"), ("c", "<u4"), ("d", "<i8")])

    def ask_last(table: pa.Table, replies: list) -> Iterator[tuple[int, bytes]]:
        block = _Block(table, window)
        h, c, d, buckets, _entry = block.last_level(block.survivors(done, replies, n), n)
        out = np.empty(len(h), kind)
        out["h"], out["c"], out["d"] = h, c, d
        for b, i, j in bl.split(buckets):
            yield b, out[i:j].tobytes()

    def cut(table: pa.Table, replies: list) -> pa.RecordBatch:
        block = _Block(table, window)
        alive = block.survivors(done, replies[:-1], n)
        _h, _c, least, buckets, entry = block.last_level(alive, n)
        beaten = bl.bits_of(replies[-1], buckets)
        gone = alive[beaten[entry] | (least[entry] < block.doc[alive])] if len(alive) else alive
        mark = tx.covered(block.start[gone], window, block.n_words)
        counts, removed, digests, kept = [], [], [], []
        for i, j, words, base in block.parts:
            m = mark[base : base + len(words)]
            counts.append(words.counts)
            removed.append(tx.per_text(m, words.first))
            data, bounds = _joined(words, ~m)
            raw = data.tobytes()
            for k in range(j - i):
                text = raw[bounds[k] : max(bounds[k], bounds[k + 1] - 1)]
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
        columns = [table["id"].combine_chunks(), pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), pa.array(digests)]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()).cast(pa.string())] if texts else columns, names=[*names, "kept"] if texts else names)

    last = bl.exchange(bl.with_replies(packed, *answers), ask_last, _least)
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return bl.finish(bl.with_replies(packed, *answers, last), cut, schema).withColumnRenamed("id", id_col)


def _joined(words: tx.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words, each followed by a space, and each text's bounds in them."""
    starts, lengths = words.starts[keep], (words.ends - words.starts)[keep] + 1
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    at = np.repeat(starts - (total - lengths), lengths) + np.arange(n)
    out = words.buf[np.minimum(at, len(words.buf) - 1)] if n else np.zeros(0, np.uint8)
    out[total - 1] = 32
    upto = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(np.where(keep, words.ends - words.starts + 1, 0), out=upto[1:])
    return out, upto[words.first]
