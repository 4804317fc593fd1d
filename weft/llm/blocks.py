"""Blocks of documents that ask one another about fingerprints.

Documents are packed into blocks of a few megabytes, written once to the shared
folder.  An exchange has three steps: each block sends, for each bucket of the
fingerprint space, one packed array of its distinct fingerprints; a bucket
compares what it got; and each block gets an answer per bucket, in the order in
which it asked.  A fingerprint that a block holds many times is sent once, so a
group of copies of any size loads a bucket with one entry per block at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.textops import modest_batches, tidy
from weft.shared import materialise

#: Raw bytes of text from which a block is closed.
BLOCK_BYTES = 4 << 20


def pack(documents: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, n_bytes, blob) rows, checkpointed; a block's id is its partition and place in it."""
    modest_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0
        parts: list[pa.RecordBatch] = []
        size = 0
        z = zstandard.ZstdCompressor(level=1)

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([base + count], pa.int64()), pa.array([size], pa.int64()), pa.array([z.compress(sink.getvalue())], pa.binary())], names=["block", "n_bytes", "blob"])

        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            i = 0
            while i < len(lengths):
                fits = np.searchsorted(np.cumsum(lengths[i:]), block_bytes - size) + 1
                j = min(len(lengths), i + int(fits))
                parts.append(batch.slice(i, j - i))
                size += int(lengths[i:j].sum())
                i = j
                if size >= block_bytes:
                    yield close()
                    parts, size, count = [], 0, count + 1
        if parts:
            yield close()

    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialise(docs.mapInArrow(tidy(run), "block long, n_bytes long, blob binary"))


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()


def buckets_for(blocks: DataFrame, ratio: float, bucket_bytes: int = 4 << 20, least: int = 96) -> int:
    """Buckets so that one holds bucket_bytes, if each text byte sends ratio bytes."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(least, int(total * ratio / bucket_bytes) + 1)


Emit = Callable[[pa.Table, list[dict[int, bytes]]], Iterator[tuple[int, bytes]]]
Resolve = Callable[[list[bytes]], list[bytes | None]]


def _replies(batch: pa.RecordBatch, row: int, first: int) -> list[dict[int, bytes]]:
    out = []
    for k in range(first, batch.num_columns):
        cell = batch.column(k)[row].as_py()
        out.append({r["bucket"]: r["data"] for r in cell or []})
    return out


def exchange(blocks: DataFrame, emit: Emit, resolve: Resolve) -> DataFrame:
    """(block, replies): what each block's buckets answered; no row where none did.

    blocks: (block, blob, earlier replies ...).  Memory of a task: one block,
    or one bucket.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column(0)[r].as_py()
                rows = list(emit(unpack(batch.column(1)[r].as_py()), _replies(batch, r, 2)))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["bucket", "block", "data"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        got = resolve(list(frame.data))
        keep = [i for i, x in enumerate(got) if x is not None]
        return pd.DataFrame({"block": frame.block.iloc[keep].to_numpy(np.int64), "bucket": frame.bucket.iloc[keep].to_numpy(np.int32), "data": [got[i] for i in keep]})

    modest_batches(blocks.sparkSession, 256)
    rows = blocks.mapInArrow(tidy(send), "bucket int, block long, data binary")
    solved = rows.groupBy("bucket").applyInPandas(tidy(answer), "block long, bucket int, data binary")
    return solved.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("replies"))


def with_replies(blocks: DataFrame, *replies: DataFrame) -> DataFrame:
    """(block, blob, replies0, replies1, ...)."""
    out = blocks.select("block", "blob")
    for k, r in enumerate(replies):
        out = out.join(r.withColumnRenamed("replies", f"replies{k}"), "block", "left")
    return out


def finish(blocks: DataFrame, run: Callable[[pa.Table, list[dict[int, bytes]]], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows that run makes of each block and its replies."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield run(unpack(batch.column(1)[r].as_py()), _replies(batch, r, 2))

    return blocks.mapInArrow(tidy(each), schema)


def split(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of runs of equal values."""
    if len(buckets):
        cut = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(buckets)), strict=True):
            yield int(buckets[a]), int(a), int(b)


def bits_of(replies: dict[int, bytes], buckets: np.ndarray) -> np.ndarray:
    """Answers, a bit each, in the order of entries with these (sorted) buckets."""
    out = np.zeros(len(buckets), bool)
    for b, i, j in split(buckets):
        if b in replies:
            out[i:j] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=j - i).astype(bool)
    return out


def in_many(data: list[bytes]) -> list[bytes | None]:
    """For arrays of distinct 64-bit values: which occur in another array too."""
    arrays = [np.frombuffer(d, np.uint64) for d in data]
    kinds, counts = np.unique(np.concatenate(arrays), return_counts=True)
    shared = kinds[counts > 1]
    out: list[bytes | None] = []
    for a in arrays:
        k = np.minimum(np.searchsorted(shared, a), max(len(shared) - 1, 0))
        hit = shared[k] == a if len(shared) else np.zeros(len(a), bool)
        out.append(np.packbits(hit).tobytes() if hit.any() else None)
    return out


def owners(h: np.ndarray, w: int) -> np.ndarray:
    """Of each w consecutive hashes, the place of the least (the first of equals).

    Hashes are compared by their upper 32 bits, whatever their place, so equal
    runs own the same place in them.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    from weft.llm.textops import sliding_min

    return (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), w) & low).astype(np.int64)
