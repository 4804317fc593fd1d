"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of identifier::

    magic | block ... block | block index | Bloom filter | footer

A block is a Zstandard frame of a run of entries; an entry is (bytes shared
with the previous key, bytes not shared, the unshared bytes, number of ids),
and the ids of the block's entries follow its keys, little-endian, in two or
four bytes each.  The index is sparse: the first key, offset, length and
entries of each block.  The Bloom filter is over keys.  The footer gives the
places of both, the number of entries and ids, and ends in the magic.  A key is
the signed 64-bit identifier, offset by 2**63, in big-endian, so byte order is
numeric order.  ``Shard.get`` finds a document through filter, index and one
block.

Texts are range-partitioned by identifier and each partition writes shards of
bounded size; a manifest row per shard gives its ids, whose running sum is the
position of each document in the whole corpus.

Defined results: null and empty texts give the end id alone; rows with equal
identifiers are kept, ordered by text; rows with a null identifier come first
under the least key and read back as null; an identifier that is no whole
number is an error; an empty table gives no shard; extra columns are never
read.  A text is never split: a task holds one text, about 60 bytes a byte.
Retries write other file names and only files in the manifest are read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import files
from weft.llm import textops as tx
from weft.shared import fresh_path, materialise

MAGIC = b"WEFTSST1"
FOOTER = struct.Struct("<QQQQQQB7x8s")
#: Ids in a block, bytes in a shard (before compression), bits a key in the filter.
BLOCK_IDS, SHARD_BYTES, BLOOM_BITS = 1 << 16, 32 << 20, 10
HASHES = 7
#: Segments whose ids a Python worker keeps.
CACHE = 600_000
#: Bytes of text encoded together.
ENCODE_BYTES = 1 << 19


# ---- format -----------------------------------------------------------------


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else struct.pack(">Q", int(identifier) + (1 << 63))


def identifier_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_bits(key: bytes, m: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % m for i in range(HASHES)]


class ShardWriter:
    """Builds one shard; keys must come in ascending order."""

    def __init__(self, width: int):
        self.width, self.kind = width, np.dtype("<u2" if width == 2 else "<u4")
        self.out, self.at, self.index, self.keys = [MAGIC], len(MAGIC), [], []
        self.entries, self.values, self.block_ids, self.first, self.prior = [], [], 0, None, b""
        self.n_ids = self.n_entries = 0
        self.z = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first, self.prior = key, b""
        shared = len(os.path.commonprefix([self.prior, key]))
        self.entries.append(_varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids)))
        self.values.append(ids.astype(self.kind, copy=False).tobytes())
        self.block_ids += len(ids)
        self.prior = key
        self.keys.append(key)
        if self.block_ids >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.first is None:
            return
        heads = b"".join(self.entries)
        raw = struct.pack("<II", len(self.entries), len(heads)) + heads + b"".join(self.values)
        frame = self.z.compress(raw)
        self.index.append((self.first, self.at, len(frame), self.n_entries, len(self.entries), self.n_ids))
        self.out.append(frame)
        self.at += len(frame)
        self.n_entries += len(self.entries)
        self.n_ids += self.block_ids
        self.entries, self.values, self.block_ids, self.first = [], [], 0, None

    def finish(self) -> bytes:
        self._flush()
        m = max(64, BLOOM_BITS * len(self.keys))
        bits = np.zeros(m, bool)
        for key in self.keys:
            bits[_bloom_bits(key, m)] = True
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQQQQ", *rest) for k, *rest in self.index)
        bloom = struct.pack("<Q", m) + np.packbits(bits).tobytes()
        footer = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_entries, self.n_ids, self.width, MAGIC)
        return b"".join([*self.out, index, bloom, footer])


class Shard:
    """Reads a shard from its bytes."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER.size + len(MAGIC) or data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard, or cut short")
        i_at, i_len, b_at, _, self.n_entries, self.n_ids, width, _ = FOOTER.unpack(data[-FOOTER.size :])
        self.data, self.kind = data, np.dtype("<u2" if width == 2 else "<u4")
        self.blocks, at = [], i_at
        while at < i_at + i_len:
            n = data[at]
            self.blocks.append((data[at + 1 : at + 1 + n], *struct.unpack_from("<QQQQQ", data, at + 1 + n)))
            at += 1 + n + 40
        self.firsts = [b[0] for b in self.blocks]
        (self.m,) = struct.unpack_from("<Q", data, b_at)
        self.bits_at = b_at + 8

    def may_hold(self, key: bytes) -> bool:
        return all(self.data[self.bits_at + (b >> 3)] >> (7 - (b & 7)) & 1 for b in _bloom_bits(key, self.m))

    def block(self, k: int) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
        """(keys, ids of all entries, bounds of each entry's ids, ids before the block)."""
        _, at, size, _, _, before = self.blocks[k]
        raw = zstandard.ZstdDecompressor().decompress(self.data[at : at + size])
        n, heads = struct.unpack_from("<II", raw)
        keys, counts, p, key = [], np.zeros(n + 1, np.int64), 8, b""
        for i in range(n):
            shared, p = _read_varint(raw, p)
            fresh, p = _read_varint(raw, p)
            key = key[:shared] + raw[p : p + fresh]
            count, p = _read_varint(raw, p + fresh)
            keys.append(key)
            counts[i + 1] = count
        return keys, np.frombuffer(raw, self.kind, offset=8 + heads), np.cumsum(counts), before

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier."""
        key, found = key_of(identifier), []
        if not self.may_hold(key):
            return found
        k = max(0, bisect_right(self.firsts, key) - 1)
        while k > 0 and self.firsts[k] == key:
            k -= 1
        while k < len(self.blocks) and self.firsts[k] <= key:
            keys, ids, bounds, _ = self.block(k)
            found += [ids[bounds[i] : bounds[i + 1]] for i, x in enumerate(keys) if x == key]
            k += 1
        return found

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray, int]]:
        """(key, ids, ids of the shard before it)."""
        for k in range(len(self.blocks)):
            keys, ids, bounds, before = self.block(k)
            for i, key in enumerate(keys):
                yield key, ids[bounds[i] : bounds[i + 1]], before + int(bounds[i])


# ---- encoding ---------------------------------------------------------------


class Encoder:
    """Ids of texts by the tokenizers library, segment by segment.

    A byte-level BPE with the usual pattern splits texts at places that a few
    neighbouring bytes show.  Texts are cut there; equal segments are encoded
    once.  A file whose pre-tokeniser is not of that kind is given whole texts,
    and so is every text that holds an added token, as that may be found across
    cuts; segments of the others hold none.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("model", {}).get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or [] if t["content"]]
        # Joined segments have a space or a line feed between them, which no added token may hold.
        self.cuts = self.cuts and not any(b" " in t or b"\n" in t for t in self.added)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        if self.cuts:
            vocabulary = self.tok.get_vocab(with_added_tokens=True)
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character a byte
        self._clear()

    def _clear(self) -> None:
        self.known, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, h: np.ndarray, texts: list[bytes]) -> None:
        """Adds segments with hashes h, ascending and new."""
        if len(self.known) + len(h) > CACHE:
            self._clear()
        # Segments that begin and end in solid characters are joined, after a line feed unless they
        # begin with a space: joined texts take half the time. The ids' lengths in bytes tell where
        # each segment's ids end.
        joint = np.array([len(t) > 1 and _SOLID[t[-1]] and (_SOLID[t[0]] or (len(t) > 2 and t[0] == 32 and _SOLID[t[1]])) for t in texts], bool)
        counts, parts = np.zeros(len(texts), np.int64), [[]] * len(texts)
        for k in np.flatnonzero(~joint):
            parts[k] = self.tok.encode(texts[k].decode(), add_special_tokens=False).ids
            counts[k] = len(parts[k])
        run, size, runs = [], 0, []
        for k in np.flatnonzero(joint).tolist():
            run.append(k)
            size += len(texts[k])
            if size > 2000:
                runs.append(run)
                run, size = [], 0
        runs += [run] if run else []
        for members in runs:
            whole = [texts[k] if texts[k][0] == 32 else b"\n" + texts[k] for k in members]
            ids = self.tok.encode_batch_fast([b"".join(whole).decode()], add_special_tokens=False)[0].ids
            bounds = np.concatenate([[0], np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(t) for t in whole])) + 1])
            for k, t, x, y in zip(members, whole, bounds[:-1].tolist(), bounds[1:].tolist()):
                parts[k] = ids[x + (t[0] == 10) : y]
                counts[k] = len(parts[k])
        at = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(parts), np.uint32, int(counts.sum()))])
        place = np.searchsorted(self.known, h)
        self.known, self.at, self.count = np.insert(self.known, place, h), np.insert(self.at, place, at), np.insert(self.count, place, counts)

    def _whole(self, buf: np.ndarray, a: int, b: int) -> np.ndarray:
        return np.array(self.tok.encode(bytes(buf[a:b]).decode(), add_special_tokens=False).ids, np.uint32)

    def _holding(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places of the texts that hold an added token."""
        raw, found = buf.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(off, at, "right")) - 1
                if at + len(token) <= off[k + 1]:
                    found.add(k)
                    at = raw.find(token, int(off[k + 1]))
                else:
                    at = raw.find(token, at + 1)
        return np.array(sorted(found), np.int64)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts of a chunk, without the end id."""
        if not self.cuts:
            got = [self._whole(buf, a, b) for a, b in zip(off[:-1], off[1:])]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.cumsum([0, *map(len, got)])
        holding = self._holding(buf, off)
        if not len(holding):
            return self._segments(buf, off)
        sizes = np.diff(off)
        keep = np.ones(len(sizes), bool)
        keep[holding] = False
        rest, rest_bounds = self._segments(buf[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))
        parts = dict(zip(holding.tolist(), (self._whole(buf, off[k], off[k + 1]) for k in holding)))
        parts |= {k: rest[rest_bounds[i] : rest_bounds[i + 1]] for i, k in enumerate(np.flatnonzero(keep).tolist())}
        got = [parts[k] for k in range(len(sizes))]
        return np.concatenate(got), np.cumsum([0, *map(len, got)])

    def _segments(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts that hold no added token."""
        # A piece of the pattern never spans these places, and what follows them is matched alike
        # whatever stands before: a single space between two characters that aren't white space; before
        # a line feed after such a character, and after it if another follows; an ASCII letter before
        # ASCII punctuation.
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf) > 2:
            ends = _SOLID[buf[:-1]]
            ends[1:] |= buf[:-2] == 0xC3  # the second byte of a Latin-1 letter or sign
            begins = _SOLID[buf[1:]] | (buf[1:] == 0xC3)
            feed = buf == 10
            cut[1 : len(buf)] = (ends & feed[1:]) | (_ALPHA[buf[:-1]] & _PUNCT[buf[1:]])
            cut[1 : len(buf) - 1] |= ends[:-1] & (buf[1:-1] == 32) & begins[1:]
            cut[2 : len(buf)] |= ends[:-1] & feed[1:-1] & begins[1:]  # a lone line feed: in a run of white space the last one would part
        cut[off] = True
        starts = np.flatnonzero(cut[:-1])
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        ends = np.append(starts[1:], len(buf))
        p = tx.prefix(buf.astype(np.uint64) + np.uint64(1))
        h = tx.spans_hash(p, starts, ends)
        place = self._find(h)
        if place is None:
            fresh, first = np.unique(h, return_index=True)
            if len(self.known):
                k = np.minimum(np.searchsorted(self.known, fresh), len(self.known) - 1)
                new = self.known[k] != fresh
                if len(self.known) + int(new.sum()) > CACHE:
                    self._clear()
                    new[:] = True
                fresh, first = fresh[new], first[new]
            raw = buf.tobytes()
            self._learn(fresh, [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())])
            place = self._find(h)
        counts, at = self.count[place], self.at[place]
        total = np.cumsum(counts)
        ids = self.ids[np.repeat(at - (total - counts), counts) + np.arange(int(total[-1]))]
        return ids, np.concatenate([[0], total])[np.searchsorted(starts, off)]

    def _find(self, h: np.ndarray) -> np.ndarray | None:
        if not len(self.known):
            return None
        order = np.argsort(h)
        k = np.empty(len(h), np.int64)
        k[order] = np.searchsorted(self.known, h[order])
        k[k == len(self.known)] = 0
        return k if np.array_equal(self.known[k], h) else None


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """This process's encoder of a file; what it has learnt serves all tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Bytes that are surely no white space: printable ASCII but the space.
_SOLID = tx.class_table((0x21, 0x7E))
_ALPHA = tx.class_table((0x41, 0x5A), (0x61, 0x7A))
_PUNCT = tx.class_table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


# ---- operators --------------------------------------------------------------


def _manifest_schema() -> str:
    return "path string, first binary, last binary, n_entries long, n_ids long"


def write_shards(documents: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards below folder; the manifest, a row per shard, checkpointed.

    Memory of a task: one Arrow batch and one shard.
    """
    spark = documents.sparkSession
    tx.modest_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, first, last, size = None, None, b"", b"", 0

        def close() -> pa.RecordBatch:
            data = writer.finish()
            path = files.write(folder, f"{uuid.uuid4().hex}.sst", data)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([writer.n_entries], pa.int64()), pa.array([writer.n_ids], pa.int64())], names=["path", "first", "last", "n_entries", "n_ids"])

        for batch in batches:
            encoder = encoder or encoder_for(tokenizer)
            keys = [key_of(x) for x in batch.column(0).to_pylist()]
            for i, j, buf, off in tx.chunks(batch.column(1), ENCODE_BYTES):
                ids, bounds = encoder.encode(buf, off)
                for k in range(i, j):
                    if writer is None:
                        writer, first, size = ShardWriter(encoder.width), keys[k], 0
                    own = np.append(ids[bounds[k - i] : bounds[k - i + 1]], np.uint32(end_id))
                    writer.add(keys[k], own)
                    last, size = keys[k], size + len(own) * encoder.width
                    if size >= shard_bytes:
                        yield close()
                        writer = None
        if writer is not None:
            yield close()

    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = docs.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    return materialise(spread.mapInArrow(tx.tidy(run), _manifest_schema()))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document: id, start, n_tokens, ids_crc32, in no order.

    The manifest (a row for each 32 MB of ids) is ordered by first key in one
    task to give each shard its first position; the shards are read by all.
    """
    order = Window.orderBy("first", "last", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long")).select("path", "base")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, base in zip(frame.path, frame.base, strict=True):
                rows = [(identifier_of(key), int(base) + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, ids, at in Shard(files.read(path))]
                out = pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids_crc32"])
                out["id"] = pd.array([r[0] for r in rows], "Int64")
                yield out

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "path").mapInPandas(tx.tidy(run), "id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes, writes and reads back: a row per document of the given ids."""
    folder = folder or fresh_path(documents.sparkSession, "tokens")
    manifest = write_shards(documents, tokenizer, folder, id_col=id_col, text_col=text_col, end_id=end_id)
    return read_shards(manifest).withColumnRenamed("id", id_col)
