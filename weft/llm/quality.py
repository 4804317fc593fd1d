"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the words inside n-grams that
occur twice or more in a text; the rules bound the share of a text's word
characters that such n-grams hold, and the share inside repeated lines.

Defined results: a null text has no words and fails the base rules; an empty
text likewise; lines without a word are never repeated lines; repeated rows
are judged alike, one row each; extra columns are never read.  One pass, no
shuffle; memory of a task: one Arrow batch and one chunk's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import textops as tx

#: Most of a text's word characters that repeated n-grams may hold, by n
#: (both the first and the later occurrences count), and repeated lines.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.30
# The contract's base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_ngram_chars array<long>"


def measure(buf: np.ndarray, off: np.ndarray, sizes: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts per text of a chunk."""
    texts = len(off) - 1
    p = tx.prefix(buf.astype(np.uint64) + np.uint64(1))
    words = tx.Words(buf, off)
    lead = (buf & 0xC0) != 0x80  # one byte of each code point
    inside = tx.NOT_SPACE[buf] & lead
    chars_to = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(inside, out=chars_to[1:])
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": chars_to[off[1:]] - chars_to[off[:-1]],
        "n_symbols": tx.per_text(tx.SYMBOLS[buf], off),
    }
    # Lines: cut after each \n and at the texts' bounds.
    breaks = np.flatnonzero(buf == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    owner = np.concatenate([np.arange(texts), np.searchsorted(off, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.concatenate([starts[1:] - 1, [len(buf)]])
    last = np.concatenate([owner[1:] != owner[:-1], [True]])
    ends[last] = off[owner[last] + 1]
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, owner = starts[full], ends[full], owner[full]
    salt = owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    _, later = tx.repeated(tx.mix(tx.spans_hash(p, starts, ends) + salt))
    out["n_dup_lines"] = np.bincount(owner[later], minlength=texts).astype(np.int64)
    chars = chars_to[ends] - chars_to[starts]
    out["dup_line_chars"] = np.bincount(owner[later], weights=chars[later], minlength=texts).astype(np.int64)

    h, room, owner = words.hashes(p), words.room(), words.text_of()
    own_chars = chars_to[words.ends] - chars_to[words.starts]
    salt = owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    shares = []
    for n in (3, *sizes):
        g = tx.grams(h, n)
        at = np.flatnonzero(room[: len(g)] >= n)
        many, _ = tx.repeated(tx.mix(g[at] + salt[at]))
        mark = tx.covered(at[many], n, len(h))
        if n == 3:
            out["n_repeat_words"] = tx.per_text(mark, words.first)
        if n in sizes:
            shares.append(tx.per_text(np.where(mark, own_chars, 0), words.first))
    out["dup_ngram_chars"] = np.array(shares).reshape(len(shares), texts).T
    return out


def repetition(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """One row per document: id, counts, repetition_failed, base_failed, kept.

    dup_ngram_chars has an entry for each n of ngram_limits, in ascending n.
    """
    limits = dict(sorted((NGRAM_LIMITS if ngram_limits is None else ngram_limits).items()))
    sizes = tuple(limits)
    tx.modest_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tx.chunks(batch.column(1)):
                got = measure(buf, off, sizes)
                wide = got.pop("dup_ngram_chars")
                names = [x.split()[0] for x in _COLUMNS.split(", ")][:-1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(sizes)), pa.array(wide.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(got[n], pa.int64()) for n in names], lists], names=["id", *names, "dup_ngram_chars"])

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = docs.mapInArrow(tx.tidy(run), f"id {dict(docs.dtypes)['id']}, {_COLUMNS}")
    over = F.lit(False)
    for k, limit in enumerate(limits.values()):
        over |= F.get("dup_ngram_chars", F.lit(k)) > F.lit(limit) * F.col("word_chars")
    failed = over | (F.col("dup_line_chars") > F.lit(line_limit) * F.col("word_chars"))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    got = got.withColumn("base_failed", base).withColumn("repetition_failed", failed)
    return got.withColumn("kept", ~F.col("base_failed") & ~F.col("repetition_failed")).withColumnRenamed("id", id_col)
