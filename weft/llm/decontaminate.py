"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (an item of
fewer words, but not none, is one window).  Every span of ``window`` words
holds ``window - k + 1`` k-grams; the one of smallest hash is the span's
fingerprint.  The choice depends on the span's words alone, so a span that a
document shares with an item is found through a fingerprint that both keep.
Fingerprints are joined, and each hit is extended to the windows around it,
which are compared as text.

Defined results: null or wordless texts have no words, no hits and no items;
repeated items count once each by id; items with a null id are ignored; extra
columns of either table are never read.  Repeated documents give one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.shared import materialise, small_enough

# The contract's word pattern and case folding.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of a packed fingerprint that hold the position in the text: as many as an array's places take.
#: The other 32 are of its hash; what they let through is compared as text.
POSITION_BITS = 31
#: Rows, and characters, of the benchmark's windows up to which they are broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 32 << 20


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none of a null."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def _grams(words: Column, k: int) -> Column:
    """Packed (hash, start) of each k-gram of words."""
    mask = (1 << (63 - POSITION_BITS)) - 1

    def packed(_, i):
        digest = F.xxhash64(*[F.get(words, i + j) for j in range(k)]).bitwiseAND(F.lit(mask))
        return F.shiftleft(digest, POSITION_BITS) + i.cast("long")

    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - F.lit(k - 1), F.lit(0))), packed)


def fingerprints(words: Column, window: int, k: int) -> Column:
    """Distinct packed fingerprints: the least k-gram of each window."""
    grams, span = _grams(words, k), window - k + 1
    if span == 1:
        return grams
    least = lambda g: F.array_distinct(F.transform(F.slice(g, F.lit(1), F.greatest(F.size(g) - F.lit(span - 1), F.lit(0))), lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, span)])))
    # transform over a one-element array binds the k-grams to a variable
    return F.get(F.transform(F.array(grams), least), F.lit(0))


def hash_of(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (size, gram, item) windows of all items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where("item is not null and size(words) > 0")
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    grams = F.transform(starts, lambda s: F.slice("words", s, size))
    return items.select("item", size.alias("size"), F.explode(grams).alias("gram")).distinct()


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids), spans.

    spans are the maximal hit runs as (start, stop) in words.  Benchmark-side
    tables are broadcast while they have at most ``broadcast_rows`` rows and
    ``BROADCAST_CHARS`` characters, and are joined by shuffle beyond.  Memory of a task: one document's words.
    """
    windows = materialise(_item_windows(benchmark, item_col, item_text_col, window))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``window`` values
    parts = {size: (min(k, size), size) for size in sizes}
    prints = None
    for size, (kk, _) in parts.items():
        own = windows.where(F.col("size") == size).select(F.explode(fingerprints(F.col("gram"), size, kk)).alias("p")).select(F.lit(size).alias("f_size"), hash_of(F.col("p")).alias("f_hash")).distinct()
        prints = own if prints is None else prints.unionByName(own)
    small = small_enough(windows, broadcast_rows) and (windows.agg(F.sum(F.length(F.array_join("gram", " ")) + F.length("item"))).first()[0] or 0) <= BROADCAST_CHARS
    near = F.broadcast if small else lambda x: x

    docs = documents.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    if not small:  # read twice then, with the same row numbers
        docs = materialise(docs)
    docs = docs.select("id", "row", words_of(F.col("text")).alias("words"))
    empty = docs.select("id", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    if prints is None:
        return empty.withColumnRenamed("id", id_col)

    # One marker row per document, and a row per fingerprint that an item has too.
    none = F.lit(-1).cast("long")
    found = F.transform(F.array(*[F.struct(F.lit(s).alias("size"), fingerprints(F.col("words"), s, kk).alias("p")) for s, (kk, _) in parts.items()]), lambda x: F.transform(x["p"], lambda p: F.struct(x["size"].alias("size"), p.alias("p"))))
    # The fingerprints are a column of their own, so that explode() sees a plain attribute: it is then
    # compiled together with the join, and the words are read only for rows that the join lets through.
    marked = docs.withColumn("all", F.concat(F.array(F.struct(F.lit(0).alias("size"), none.alias("p"))), F.flatten(found)))
    marked = marked.select("id", "row", "words", F.explode_outer("all").alias("f"))  # never empty; the outer form keeps the optimiser from a filter that computes "all" twice
    marked = marked.select("id", "row", "words", F.col("f.size").alias("size"), hash_of(F.col("f.p")).alias("hash"), F.col("f.p").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int").alias("pos"))
    same = (F.col("hash") == F.col("f_hash")) & (F.col("size") == F.col("f_size"))
    if small:
        hits = marked.join(F.broadcast(prints), same, "left").where("size = 0 or f_hash is not null")
    else:
        # Fingerprints travel without words; a document's hits are gathered and meet its words once.
        at = marked.where("size > 0").select("row", "size", "hash", "pos").join(prints, same).groupBy("row").agg(F.collect_set(F.struct("size", "pos")).alias("at"))
        marker = F.array(F.struct(F.lit(0).alias("size"), F.lit(-1).alias("pos")))
        hits = docs.join(at.withColumnRenamed("row", "h_row"), F.col("row") == F.col("h_row"), "left")
        hits = hits.withColumn("all", F.when(F.col("at").isNull(), marker).otherwise(F.concat(marker, "at"))).select("id", "row", "words", F.explode_outer("all").alias("h"))
        hits = hits.select("id", "row", "words", "h.size", "h.pos")

    # Extension: the windows of a document that hold the fingerprint.
    reach = F.lit(None).cast("int")
    for s, (kk, _) in parts.items():
        reach = F.when(F.col("size") == s, F.lit(s - kk)).otherwise(reach)
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    last = F.least(F.col("pos"), F.size("words") - F.col("size"))
    starts = F.when((F.col("size") > 0) & (first <= last), F.sequence(first, last))
    spread = hits.select("id", "row", "size", F.when(F.col("size") == 0, F.size("words")).alias("n"), F.explode_outer(F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.col("size")).alias("gram")))).alias("w"))
    spread = spread.where("n is not null or w is not null")
    known = windows.groupBy("size", "gram").agg(F.collect_set("item").alias("own"))
    known = known.select(F.col("size").alias("k_size"), F.col("gram").alias("k_gram"), "own")
    real = spread.join(near(known), (F.col("size") == F.col("k_size")) & (F.col("w.gram") == F.col("k_gram")), "left").where("n is not null or own is not null")

    # Distinct starts per document; the group is bounded by the document itself.
    span = F.when(F.col("own").isNotNull(), F.struct(F.col("w.start").alias("start"), (F.col("w.start") + F.col("size")).alias("stop")))
    grouped = real.groupBy("row").agg(F.first("id").alias("id"), F.max("n").cast("long").alias("n_words"), F.collect_set(span).alias("raw"), F.array_distinct(F.flatten(F.collect_set("own"))).alias("own"))

    def merged(acc, x):
        prior = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(prior["start"].alias("start"), F.greatest(prior["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["stop"]), joined).otherwise(F.concat(acc, F.array(x)))

    spans = F.aggregate(F.array_sort("raw"), F.array().cast("array<struct<start:int,stop:int>>"), merged)
    out = grouped.select("id", "n_words", F.array_sort("own").alias("items"), spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["stop"] - x["start"]).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")
