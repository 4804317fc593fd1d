"""Removal of repeated byte strings by a sparse suffix order.

Of each string of ``length`` bytes the 64 bytes of least hash inside it are its
lead; the suffixes that begin at leads are the ones that are ordered.
Splitters sampled from their leading bytes range-partition them.  First, leads
that occur once are dropped.  For the rest each block sends the bytes around
the lead that its strings cover.  A bucket sorts the suffixes from the leads
on, and the bytes before the leads read backwards, by multikey quicksort, and
compares neighbours byte by byte; two strings are equal if they lie in one run
of both orders, at the depths that their place around the lead asks for.  A
splitter is a suffix's first eight bytes, so what a bucket's last suffix shares
with the next bucket's first one is less than a lead: the comparison across
boundaries is made when suffixes are dealt, and no repeat can cross one.

A lead with more than ``hot`` different surroundings would load one bucket with
all of them; the fingerprints (64 bits) of its strings are spread over buckets
of their own.

Defined results: a null text is empty; texts shorter than ``length`` bytes
lose nothing; a string that repeats inside one text counts as repeated, with
overlaps; repeated rows repeat each other; an empty table gives no row;
identifiers play no part, nor do extra columns (identifiers that are no whole
numbers are an error).  A text is never split: a task holds one block of a few
megabytes or one text, about 60 bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import blocks as bl
from weft.llm import textops as tx

LENGTH, LEAD = 200, 64
#: Blocks sampled for splitters, and keys taken of each.
SAMPLE_BLOCKS, SAMPLE_KEYS = 64, 512
#: Different surroundings of a lead from which its strings are spread.
HOT = 4096
_U = np.uint64


def _leading(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First eight bytes at each place, as a number in byte order."""
    out = np.zeros(len(at), _U)
    for k in range(8):
        out = (out << _U(8)) | buf[at + k].astype(_U)
    return out


class _Block:
    """Leads of a block's texts: runs of neighbouring strings with one lead."""

    def __init__(self, table: pa.Table, length: int, lead: int):
        self.parts, run = [], []
        base = 0
        for i, j, buf, off in tx.chunks(table["text"]):
            self.parts.append((i, j, buf, off, base))
            base += len(buf)
            if len(buf) < length:
                continue
            p = tx.prefix(buf.astype(_U) + _U(1))
            _, down = tx.powers(len(p))
            g = tx.mix((p[lead:] - p[:-lead]) * down[: len(buf) - lead + 1])
            own = bl.owners(g, length - lead + 1)
            room = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))
            ok = room[: len(own)] >= length
            own = np.where(ok, own, -1)
            new = np.append(True, (own[1:] != own[:-1]))
            # neighbours with one lead lie in one text: the lead would not fit otherwise
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(own)) - 1
            good = own[first] >= 0
            first, last = first[good], last[good]
            at = own[first]
            run.append((g[at], _leading(buf, at), base - len(buf) + first, base - len(buf) + last, base - len(buf) + at))
        cat = lambda k, kind: np.concatenate([r[k] for r in run]) if run else np.zeros(0, kind)
        self.lead, self.key = cat(0, _U), cat(1, _U)
        self.first, self.last = cat(2, np.int64), cat(3, np.int64)  # strings that start in [first, last]
        self.at = cat(4, np.int64)  # the lead's first byte
        self.n_bytes = base

    def bytes(self) -> np.ndarray:
        return np.concatenate([b for _, _, b, _, _ in self.parts]) if self.parts else np.zeros(0, np.uint8)

    def ordered(self, splitters: np.ndarray) -> None:
        """Orders the runs by bucket and lead."""
        bucket = np.searchsorted(splitters, self.key, "right")
        order = np.lexsort((self.first, self.lead, bucket))
        self.bucket, self.lead, self.first, self.last, self.at = bucket[order], self.lead[order], self.first[order], self.last[order], self.at[order]
        new = np.append(True, self.lead[1:] != self.lead[:-1]) if len(order) else np.zeros(0, bool)
        self.kind = np.cumsum(new) - 1
        self.heads = np.flatnonzero(new)

    def loads(self, length: int) -> np.ndarray:
        """Different surroundings of each lead, up to 255."""
        runs = np.bincount(self.kind, minlength=len(self.heads))
        out = np.minimum(runs, 1)
        several = np.flatnonzero(runs[self.kind] > 1)
        if len(several):
            distinct, _, _ = self.contexts(several, length)
            out = np.maximum(out, np.bincount(self.kind[distinct], minlength=len(self.heads)))
        return np.minimum(out, 255).astype(np.uint8)

    def survivors(self, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(runs whose lead repeats, here or in another block; of all runs, those with a hot lead)."""
        here = np.bincount(self.kind, minlength=len(self.heads)) > 1
        buckets = self.bucket[self.heads]
        alive = here | bl.bits_of(replies, buckets)
        hot = bl.bits_of({b: d[len(d) // 2 :] for b, d in replies.items()}, buckets)
        return np.flatnonzero(alive[self.kind]), hot[self.kind]

    def contexts(self, alive: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """(run that stands for each distinct context, is it repeated here, context of each alive run)."""
        buf = self.bytes()
        p = tx.prefix(buf.astype(_U) + _U(1))
        a, b = self.first[alive], self.last[alive] + length
        h = tx.spans_hash(p, a, b)
        order = np.lexsort((h, self.lead[alive], self.bucket[alive]))
        hs, ls = h[order], self.lead[alive][order]
        new = np.append(True, (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])) if len(hs) else np.zeros(0, bool)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        many = np.bincount(place, minlength=int(new.sum())) > 1
        return alive[order[np.flatnonzero(new)]], many, place


#: First byte of what a bucket gets: fingerprints of strings, or leads with their surroundings.
_SPREAD, _AROUND = b"\x01", b"\x00"
_HEAD = np.dtype([("lead", "<u8"), ("n", "<u4"), ("at", "<u4"), ("many", "u1")])  # at: the lead's place
#: Surroundings that are sorted at once, in expectation; those of one lead stay together.
SORTED = 8_192


def _gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    return buf[np.repeat(starts - (total - lengths), lengths) + np.arange(n)]


def _leads(hot: int):
    def resolve(data: list[bytes]) -> list[bytes | None]:
        """For arrays of distinct leads and their loads: which are in another array too, and which are hot."""
        sizes = [len(d) // 9 for d in data]
        every = np.concatenate([np.frombuffer(d, _U, count=n) for d, n in zip(data, sizes, strict=True)])
        load = np.concatenate([np.frombuffer(d, np.uint8, offset=8 * n) for d, n in zip(data, sizes, strict=True)])
        _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        many = counts > 1
        heavy = many & (np.bincount(inverse, weights=load) > hot)
        out: list[bytes | None] = []
        at = 0
        for n in sizes:
            part = inverse[at : at + n]
            hit = many[part]
            out.append(np.packbits(hit).tobytes() + np.packbits(heavy[part]).tobytes() if hit.any() else None)
            at += n
        return out

    return resolve


def _strings(buf: np.ndarray, lead: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the strings of runs: count of them from first on, each with its lead."""
    p = tx.prefix(buf.astype(_U) + _U(1))
    _, down = tx.powers(len(p))
    upto = np.cumsum(count)
    total = int(upto[-1]) if len(upto) else 0
    at = np.repeat(first - (upto - count), count) + np.arange(total)
    return tx.mix((p[at + length] - p[at]) * down[at] ^ np.repeat(lead, count))


class _Spread:
    """Distinct strings of a block's runs with a hot lead, in order of fingerprint, and their buckets."""

    def __init__(self, block: _Block, runs: np.ndarray, many: np.ndarray, length: int, n: int):
        """Buckets follow the n of the leads."""
        count = (block.last - block.first + 1)[runs]
        h = _strings(block.bytes(), block.lead[runs], block.first[runs], count, length) if len(runs) else np.zeros(0, _U)
        self.kinds, self.inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        twice = np.bincount(self.inverse, weights=np.repeat(many, count), minlength=len(self.kinds)) > 0
        self.here = (times > 1) | twice
        self.buckets = n + ((self.kinds >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of words (row, place) by multikey quicksort.

    All segments that are still open are parted at once, three ways around a
    median of three at their depth; equal parts go on with the next word.
    """
    n, deep = words.shape
    order = np.arange(n)
    start, stop, depth = np.zeros(1, np.int64), np.full(1, n), np.zeros(1, np.int64)
    while True:
        wide = (stop - start > 1) & (depth < deep)
        start, stop, depth = start[wide], stop[wide], depth[wide]
        if not len(start):
            return order
        size = stop - start
        upto = np.cumsum(size)
        base = upto - size
        at = np.repeat(start - base, size) + np.arange(upto[-1])
        segment = np.repeat(np.arange(len(size)), size)
        rows = order[at]
        w = words[rows, depth[segment]]
        a, b, c = w[base], w[base + size // 2], w[upto - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        part = segment * 3 + (w >= pivot) + (w > pivot)
        order[at] = rows[np.argsort(part, kind="stable")]
        counts = np.bincount(part, minlength=3 * len(size))
        begin = np.cumsum(counts) - counts + np.repeat(start - base, 3)
        start, stop = begin, begin + counts
        depth = np.repeat(depth, 3) + np.tile([0, 1, 0], len(size))


def _table(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from each start on (backwards for step -1), zeros after the end: (bytes by row, words with the size last)."""
    wide = max(8, -(-int(sizes.max(initial=1)) // 8) * 8)
    k = np.arange(wide)
    inside = k[None, :] < sizes[:, None]
    rows = np.where(inside, buf[np.clip(starts[:, None] + step * k[None, :], 0, len(buf) - 1)], 0).astype(np.uint8)
    return rows, np.concatenate([rows.view(">u8").astype(_U), sizes[:, None].astype(_U)], axis=1)


def _runs(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int, depths: np.ndarray) -> np.ndarray:
    """(depth, row): number of the run of the sorted order, of rows alike in that many first bytes."""
    rows, words = _table(buf, starts, sizes, step)
    order = multikey_order(words)
    differ = rows[order[1:]] != rows[order[:-1]]
    same = np.where(differ.any(1), differ.argmax(1), rows.shape[1])  # bytes that neighbours share
    same = np.minimum(same, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    out = np.zeros((len(depths), len(order)), np.int32)
    out[:, order[1:]] = np.cumsum(same[None, :] < depths[:, None], axis=1)
    return out


def equal_strings(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, leads: np.ndarray, length: int) -> np.ndarray:
    """A number for each string of ``length`` bytes in each surrounding, alike for equal strings alone.

    buf[starts : starts + sizes] are surroundings with the same lead at their
    byte ``leads``; strings are in order of surrounding and place.
    """
    place = np.arange(int(leads.max(initial=0)) + 1)  # of the lead in a string
    after = _runs(buf, starts + leads, sizes - leads, 1, length - place)
    before = _runs(buf, starts + leads - 1, leads, -1, place)
    count = sizes - length + 1
    upto = np.cumsum(count)
    row = np.repeat(np.arange(len(starts)), count)
    at = np.repeat(leads + upto - count, count) - np.arange(int(upto[-1]))
    return (at.astype(_U) << _U(48)) ^ (before[at, row].astype(_U) << _U(24)) ^ after[at, row].astype(_U)


def _compare(length: int):
    def resolve(data: list[bytes]) -> list[bytes | None]:
        if data[0][:1] == _SPREAD:
            return bl.in_many([d[1:] for d in data])
        data = [d[1:] for d in data]
        z = zstandard.ZstdDecompressor()
        heads, bodies = [], []
        for d in data:
            raw = z.decompress(d)
            n = int.from_bytes(raw[:4], "little")
            heads.append(np.frombuffer(raw, _HEAD, count=n, offset=4))
            bodies.append(np.frombuffer(raw, np.uint8, offset=4 + n * _HEAD.itemsize))
        head, buf = np.concatenate(heads), np.concatenate(bodies)
        size, leads = head["n"].astype(np.int64), head["at"].astype(np.int64)
        start = np.cumsum(size) - size
        strings = size - length + 1  # in each surrounding
        upto = np.cumsum(strings)
        many = np.repeat(head["many"].astype(bool), strings)
        order = np.argsort(head["lead"], kind="stable")
        lead = head["lead"][order]
        edges = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
        edges = edges[np.unique(edges // SORTED, return_index=True)[1]]
        for i, j in zip(edges, np.append(edges[1:], len(order)), strict=True):
            own = np.sort(order[i:j])
            if len(own) < 2:
                continue
            found, _ = tx.repeated(tx.mix(equal_strings(buf, start[own], size[own], leads[own], length)))
            total = np.cumsum(strings[own])
            at = np.repeat(upto[own] - total, strings[own]) + np.arange(int(total[-1]))
            many[at] |= found
        out: list[bytes | None] = []
        a = k = 0
        for x in heads:
            b = int(upto[k + len(x) - 1]) if len(x) else a
            part = many[a:b]
            out.append(np.packbits(part).tobytes() if part.any() else None)
            a, k = b, k + len(x)
        return out

    return resolve


def remove_repeated_bytes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, texts: bool = True, hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (start, stop), kept_sha256 and, if asked for, kept."""
    lead = min(LEAD, max(8, length // 2))
    if not 16 <= length < 1 << 16:
        raise ValueError("strings of 16 to 65,535 bytes")
    packed = bl.pack(documents, id_col, text_col)
    n = bl.buckets_for(packed, 1.3)
    splitters = _splitters(packed, n, length, lead)

    def load(table: pa.Table) -> _Block:
        block = _Block(table, length, lead)
        block.ordered(splitters)
        return block

    def ask(table: pa.Table, _: list) -> Iterator[tuple[int, bytes]]:
        block = load(table)
        kinds, buckets, loads = block.lead[block.heads], block.bucket[block.heads], block.loads(length)
        for b, i, j in bl.split(buckets):
            yield b, kinds[i:j].tobytes() + loads[i:j].tobytes()

    def ask_again(table: pa.Table, replies: list) -> Iterator[tuple[int, bytes]]:
        block = load(table)
        alive, heavy = block.survivors(replies[0])
        runs, many, _ = block.contexts(alive, length)
        spread = _Spread(block, runs[heavy[runs]], many[heavy[runs]], length, n)
        for b, i, j in bl.split(spread.buckets):
            yield b, _SPREAD + spread.kinds[i:j].tobytes()
        runs, many = runs[~heavy[runs]], many[~heavy[runs]]
        buf, z = block.bytes(), zstandard.ZstdCompressor(level=1)
        for b, i, j in bl.split(block.bucket[runs]):
            own = runs[i:j]
            head = np.empty(j - i, _HEAD)
            sizes = block.last[own] + length - block.first[own]
            head["lead"], head["n"], head["at"], head["many"] = block.lead[own], sizes, block.at[own] - block.first[own], many[i:j]
            yield b, _AROUND + z.compress((j - i).to_bytes(4, "little") + head.tobytes() + _gather(buf, block.first[own], sizes).tobytes())

    def cut(table: pa.Table, replies: list) -> pa.RecordBatch:
        block = load(table)
        alive, heavy = block.survivors(replies[0])
        runs, many, place = block.contexts(alive, length)
        strings = (block.last - block.first + 1)[runs]
        found = np.repeat(many, strings)
        hot_runs = heavy[runs]
        mild = ~np.repeat(hot_runs, strings)
        found[mild] |= bl.bits_of(replies[1], np.repeat(block.bucket[runs], strings)[mild])
        if hot_runs.any():
            spread = _Spread(block, runs[hot_runs], many[hot_runs], length, n)
            found[~mild] |= (spread.here | bl.bits_of(replies[1], spread.buckets))[spread.inverse]
        own = (block.last - block.first + 1)[alive]
        upto = np.cumsum(strings) - strings
        total = np.cumsum(own)
        count = int(total[-1]) if len(total) else 0
        inner = np.arange(count) - np.repeat(total - own, own)
        hit = found[np.repeat(upto[place], own) + inner] if count else np.zeros(0, bool)
        starts = (np.repeat(block.first[alive], own) + inner)[hit]
        gone = tx.covered(starts, length, block.n_bytes)
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for i, j, buf, off, base in block.parts:
            m = gone[base : base + len(buf)]
            sizes.append(np.diff(off))
            removed.append(tx.per_text(m, off))
            rest = buf[~m].tobytes()
            bounds = np.concatenate([[0], np.cumsum(np.diff(off) - removed[-1])])
            for k in range(j - i):
                text = rest[bounds[k] : bounds[k + 1]]
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
                if removed[-1][k]:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], m[off[k] : off[k + 1]].view(np.int8), [0]])))
                    spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                else:
                    spans.append([])
        pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        columns = [table["id"].combine_chunks(), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), pa.array(spans, pair), pa.array(digests)]
        names = ["id", "n_bytes", "n_removed", "spans", "kept_sha256"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if texts else columns, names=[*names, "kept"] if texts else names)

    first = bl.exchange(bl.with_replies(packed), ask, _leads(hot))
    second = bl.exchange(bl.with_replies(packed, first), ask_again, _compare(length))
    schema = "id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string" + ", kept binary" * texts
    return bl.finish(bl.with_replies(packed, first, second), cut, schema).withColumnRenamed("id", id_col)


def _splitters(packed: DataFrame, n: int, length: int, lead: int) -> np.ndarray:
    """n - 1 splitters of the leads' first bytes, from a bounded sample of blocks."""
    blocks = packed.count()
    share = min(1.0, SAMPLE_BLOCKS / max(1, blocks))
    some = packed.where(F.pmod(F.xxhash64("block"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("block", "blob")

    def sample(table: pa.Table, _: list) -> pa.RecordBatch:
        keys = np.sort(_Block(table, length, lead).key)
        take = keys[np.linspace(0, len(keys) - 1, min(SAMPLE_KEYS, len(keys))).astype(np.int64)] if len(keys) else keys
        return pa.RecordBatch.from_arrays([pa.array(take.view(np.int64), pa.int64())], names=["key"])

    got = bl.finish(some, sample, "key long").toArrow()["key"].to_numpy().astype(np.int64).view(_U)
    got = np.sort(got)
    if not len(got):
        return np.zeros(0, _U)
    return np.unique(got[np.linspace(0, len(got) - 1, n + 1).astype(np.int64)[1:-1]])
