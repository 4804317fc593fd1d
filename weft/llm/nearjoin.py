"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its five-word shingles (words as in the benchmark
decontamination: A-Z in lower case, punctuation apart; a text of one to four
words is one shingle).  Documents with equal sets form a class.

The forest has ``trees`` prefix tries.  In each a class has a label of
``depth`` symbols, a byte of a MinHash value each, and the labels are kept in
sorted order, so that a class's longest matched prefix is the one it shares
with its neighbour.  Matched prefixes are shortened symbol by symbol from the
full label until a pair at the threshold is found with the target recall: by
the formula, and as measured on pairs at the threshold that are made from a
bounded sample of the documents.  Classes that share a prefix of that length
are linked in sorted order, each link with the length it matched at;
components of the links are the candidate groups, and within a group every
pair is verified exactly from the whole sets: inside a task, by counting
shared shingles, so the pairs of a group are never rows.  A large group is
verified block against block; blocks are bounded by documents and by shingles.

Defined results: null texts and texts without words are in no group and have
no links; repeated rows have one class; a null identifier is the least of its
class; an empty table gives no row; extra columns are never read.  Sets are
compared by 64-bit shingle hashes, classes by 128 bits of a set, rows by 128
bits of identifier and text.  Identifiers are whole numbers (others are read
as null).  A text is never split: a task holds one text, about 40 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import textops as tx
from weft.operators.components import star_edges
from weft.shared import materialise, small_enough

SHINGLE, THRESHOLD = 5, 0.8
#: Trees, symbols of a full label, and the recall wanted of a pair at the threshold.
TREES, DEPTH, RECALL = 44, 12, 0.999
#: Documents sampled (in expectation) to measure the recall at each depth, and pairs made of each.
PILOT_DOCS, PILOT_PAIRS = 400, 8
#: Documents, and shingles, of a block; blocks are verified against each other.
GROUP_DOCS, BLOCK_SHINGLES = 512, 1 << 19
#: Groups' members up to which their rows are broadcast (two numbers each) to find the texts.
BROADCAST_MEMBERS = 250_000
_U = np.uint64

# Separators of words, as in the decontamination contract; A-Z fold to a-z.
_WORD = ~tx.class_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def recall_of(similarity: float, trees: int, depth: int) -> float:
    """Chance that a pair shares a prefix of this depth in some tree."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def shingles(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts of a chunk, in order in each; bounds of each text)."""
    folded = _FOLD[buf]
    words = tx.Words(folded, off, _WORD)
    h, room, owner = words.hashes(), words.room(), words.text_of()
    g = tx.grams(h, n)
    at = np.flatnonzero(room[: len(g)] >= n)
    values, texts = g[at], owner[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(few):
        p = tx.prefix(h)
        values = np.concatenate([values, tx.spans_hash(p, words.first[few], words.first[few + 1])])
        texts = np.concatenate([texts, few])
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    keep = np.append(True, (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])) if len(values) else np.zeros(0, bool)
    values, texts = values[keep], texts[keep]
    return values, np.searchsorted(texts, np.arange(len(off)))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = tx.mix(np.arange(1, 2 * count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return (seeds[:count] >> _U(32)).astype(np.uint32) | np.uint32(1), (seeds[count:] >> _U(32)).astype(np.uint32)


def labels(values: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Labels (text, tree, symbol), a byte each, of the texts with at least one shingle."""
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.zeros((len(full), trees * depth), np.uint8)
    if len(full):
        starts = bounds[full]
        x = (values >> _U(32)).astype(np.uint32) ^ values.astype(np.uint32)
        mult, add = _functions(trees * depth)
        for k in range(trees * depth):
            least = np.minimum.reduceat(x * mult[k] + add[k], starts)
            out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out.reshape(len(full), trees, depth)


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the labels of a and b (.., symbol) have in common before the first that differs."""
    return np.cumprod(a == b, axis=-1, dtype=np.int64).sum(-1)


def _sketches(documents: DataFrame, id_col: str, text_col: str, n: int, trees: int, depth: int) -> DataFrame:
    """(node, check, id, n_shingles, digest, label): digest and label null without a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tx.chunks(batch.column(3)):
                values, bounds = shingles(buf, off, n)
                sizes = np.diff(bounds)
                p = tx.prefix(values)
                one = tx.spans_hash(p, bounds[:-1], bounds[1:])
                two = tx.spans_hash(tx.prefix(tx.mix(values ^ _U(0x5851F42D4C957F2D))), bounds[:-1], bounds[1:])
                digest = np.stack([one, two], 1).tobytes()
                label = labels(values, bounds, trees, depth).tobytes()
                width, place = trees * depth, np.cumsum(sizes > 0) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k).slice(i, j - i) for k in range(3)],
                        pa.array(sizes, pa.int64()),
                        pa.array([digest[16 * r : 16 * r + 16] if sizes[r] else None for r in range(j - i)], pa.binary()),
                        pa.array([label[width * place[r] : width * (place[r] + 1)] if sizes[r] else None for r in range(j - i)], pa.binary()),
                    ],
                    names=["node", "check", "id", "n_shingles", "digest", "label"],
                )

    docs = _nodes(documents, id_col, text_col)
    return docs.mapInArrow(tx.tidy(run), "node long, check long, id long, n_shingles long, digest binary, label binary")


def _identity(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes of identifier and text, 128 bits together: equal for repeated rows alone."""
    key, text = F.expr(f"try_cast(`{id_col}` as bigint)"), F.col(f"`{text_col}`")
    return F.xxhash64(key, text), F.xxhash64(text, F.lit(7), key)


def _nodes(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, check, id, text)."""
    node, check = _identity(id_col, text_col)
    return documents.select(node.alias("node"), check.alias("check"), F.expr(f"try_cast(`{id_col}` as bigint)").alias("id"), F.col(f"`{text_col}`").alias("text"))


def pilot_recall(documents: DataFrame, share: float, *, text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH) -> list[float]:
    """Measured recall at depths 1 to ``depth`` of pairs at the threshold; 1.0 without any pair.

    The pairs are sets of the sampled texts and what is left of them when as
    many shingles are taken out as the threshold allows.  The share bounds the
    sample; counts alone reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deepest = np.zeros(depth + 1, np.int64)
        for batch in batches:
            for _i, _j, buf, off in tx.chunks(batch.column(0)):
                values, bounds = shingles(buf, off, shingle)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    out = int((b - a) * (1 - threshold) + 1e-9)
                    if not out:
                        continue
                    own = values[a:b]
                    rng = np.random.default_rng(int(own[0]))
                    sets = [own] + [np.delete(own, rng.choice(b - a, out, replace=False)) for _ in range(PILOT_PAIRS)]
                    made = labels(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), trees, depth)
                    np.add.at(deepest, matched(made[1:], made[:1]).max(1), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(depth + 1), pa.int32()), pa.array(deepest, pa.int64())], names=["depth", "pairs"])

    some = documents.where(F.pmod(F.xxhash64(text_col, F.lit(11)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(text_col)
    found = {r[0]: r[1] for r in some.mapInArrow(tx.tidy(run), "depth int, pairs long").groupBy("depth").agg(F.sum("pairs")).collect()}
    total = sum(found.values())
    return [sum(v for d, v in found.items() if d >= at) / total if total else 1.0 for at in range(1, depth + 1)]


def shortened(threshold: float, trees: int, depth: int, target: float, measured: list[float]) -> int:
    """The longest prefix at which both the formula and the measurement reach the target recall.

    The measurement may fall short of the target by what chance allows for
    pairs as rare as those it misses (a third of the target's own misses).
    """
    while depth > 1 and min(recall_of(threshold, trees, depth), measured[depth - 1] + (1 - target) / 3) < target:
        depth -= 1
    return depth


def _tries(batch: pa.RecordBatch, trees: int, depth: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of tree and first ``stop`` symbols, the symbols after it as one number, class) of each label."""
    n = batch.num_rows
    label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, trees, depth)
    key = np.broadcast_to(np.arange(1, trees + 1, dtype=_U) * _U(0xA24BAED4963EE407), (n, trees))
    head = np.zeros((n, trees), _U)
    for k in range(stop):
        head = (head << _U(8)) | label[:, :, k].astype(_U)
        if k % 8 == 7 or k == stop - 1:
            key, head = tx.mix(key ^ head) + _U(k), np.zeros((n, trees), _U)
    rest = np.zeros((n, trees), _U)
    for k in range(stop, min(depth, stop + 8)):
        rest |= label[:, :, k].astype(_U) << _U(8 * (7 - (k - stop)))
    return key.reshape(-1).view(np.int64), rest.reshape(-1).view(np.int64), np.repeat(batch.column(0).to_numpy(), trees)


def _deeper(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Leading symbols that the numbers of _tries have in common, up to most."""
    differ = (a ^ b).view(_U)
    out = np.zeros(len(differ), np.int64)
    for k in range(most):
        out += (differ >> _U(8 * (7 - k))) == 0
    return out


def forest_links(classes: DataFrame, trees: int, depth: int, stop: int) -> DataFrame:
    """(src, dst, matched): links that connect the classes of each prefix of ``stop`` symbols.

    classes: (class, label).  Labels are sorted by tree and symbols; each is
    linked to the one before it in its subtree, with the length of the prefix
    that the two share.  Each batch links what it holds of a subtree and sends
    its first label alone, so a prefix of any number of classes loads the
    exchange with a row per batch at most (a link between batches has the
    length that their first labels share).  Those are dealt by tree and prefix,
    sorted, read as a stream and linked likewise: memory is one batch.
    """
    extra = min(depth - stop, 8)

    def chain(k, r, v, before=None):
        """Links along sorted labels, and which of them begin a subtree."""
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        if before is not None and len(k):
            first[0] = k[0] != before[0]
        pk, pr, pv = (np.concatenate([[b], x[:-1]]) for b, x in zip(before or (0, 0, 0), (k, r, v)))
        at = np.flatnonzero(~first & (pv != v))
        return (v[at], pv[at], stop + _deeper(r[at], pr[at], extra)), first

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, r, v = _tries(batch, trees, depth, stop)
            order = np.lexsort((v, r, k))
            (src, dst, length), first = chain(k[order], r[order], v[order])
            pairs, inverse = np.unique(np.stack([src, dst], 1), axis=0, return_inverse=True)
            most = np.zeros(len(pairs), np.int64)
            np.maximum.at(most, inverse.reshape(-1), length)
            at = order[first]
            # A row whose two classes differ is a finished link, dealt by its own class; the others are first labels.
            columns = [np.concatenate(x) for x in ((k[at], pairs[:, 0]), (r[at], most), (v[at], pairs[:, 0]), (v[at], pairs[:, 1]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "rest", "class", "other"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            k, r, v, o = (batch.column(c).to_numpy() for c in range(4))
            done = v != o
            out = [(v[done], o[done], r[done])]
            k, r, v = k[~done], r[~done], v[~done]
            if len(k):
                out.append(chain(k, r, v, before)[0])
                before = (k[-1], r[-1], v[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=["src", "dst", "matched"])

    rows = classes.select("class", "label").mapInArrow(tx.tidy(combine), "key long, rest long, class long, other long")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "rest", "class")
    links = dealt.mapInArrow(tx.tidy(link), "src long, dst long, matched long")
    return links.groupBy("src", "dst").agg(F.max("matched").alias("matched"))


def _shared(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Shingles that each set of a shares with each of b."""
    left, right = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(np.unique(left), np.unique(right), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b)]
    cols = []
    for side, values in enumerate((left, right)):
        k = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        hit = common[k] == values if len(common) else np.zeros(len(values), bool)
        rows[side], k = rows[side][hit], k[hit]
        cols.append(k)
    for at in range(0, len(common), width):
        m = min(width, len(common) - at)
        both = []
        for side, count in enumerate((len(a), len(b))):
            x = np.zeros((count, m), np.float32)
            inside = (cols[side] >= at) & (cols[side] < at + m)
            x[rows[side][inside], cols[side][inside] - at] = 1
            both.append(x)
        out += both[0] @ both[1].T
    return out


def _roots(linked: np.ndarray, first: list[int], second: list[int]) -> dict[int, int]:
    """Least node reached from each linked node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.flatnonzero(linked.any(1)):
        row = np.flatnonzero(linked[i])
        for x in (second[k] for k in row):
            a, b = find(first[i]), find(x)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _verify(threshold: float, n: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of the pairs of each group (and pair of blocks) in this task."""
        out: list[tuple[int, int, int]] = []
        sets: list[np.ndarray] = []
        for _i, _j, buf, off in tx.chunks(table["text"]):
            values, bounds = shingles(buf, off, n)
            sets += [values[bounds[k] : bounds[k + 1]].copy() for k in range(len(off) - 1)]
        component, left, right, block, names = (table[c].to_numpy() for c in ("component", "left", "right", "block", "class"))
        order = np.lexsort((right, left, component))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(component[order]) != 0) | (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
        for own in np.split(order, np.flatnonzero(new)[1:]) if len(order) else []:
            a, b = left[own[0]], right[own[0]]
            one, two = own[block[own] == a], own[block[own] == b]
            if not len(one) or not len(two):
                continue
            x, y = [sets[k] for k in one], [sets[k] for k in two]
            shared = _shared(x, y)
            total = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :] - shared
            linked = shared >= threshold * total - 1e-6
            if a == b:
                np.fill_diagonal(linked, False)
            first, second = names[one].tolist(), names[two].tolist()
            roots = _roots(linked, first, second)
            out += [(v, c, roots[v]) for v, c in zip(first, linked.sum(1).tolist()) if c]
            if a != b:
                out += [(v, c, roots[v]) for v, c in zip(second, linked.sum(0).tolist()) if c]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["class", "links", "root"])

    return run


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    group_docs: int = GROUP_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document: node, check, id, class_id, class_no, n_copies, n_links.

    class_id: least identifier of the documents connected by links or equal
    sets; n_copies: documents with the same set, this one included; n_links:
    other distinct sets of similarity ``threshold`` or more; class_no: a
    number of the connected documents of this run (null without words).
    """
    spark = documents.sparkSession
    tx.modest_batches(spark)
    sketches = materialise(_sketches(documents, id_col, text_col, shingle, trees, depth))
    least = F.min(F.struct(F.col("id").isNotNull(), "id"))["id"]
    classes = sketches.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n_copies"), least.alias("least"), F.min(F.struct("node", "check")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("label").alias("label"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()))
    share = min(1.0, PILOT_DOCS / max(1, classes.count()))
    stop = shortened(threshold, trees, depth, recall, pilot_recall(documents, share, text_col=text_col, threshold=threshold, shingle=shingle, trees=trees, depth=depth))
    stars = star_edges(forest_links(classes, trees, depth, stop))
    members = stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
    members = materialise(members.join(classes.select("class", "row", "n_shingles"), F.col("id") == F.col("class")).select("class", "component", "row", "n_shingles"))
    found = materialise(_verified(documents, members, id_col, text_col, threshold, shingle, group_docs, block_shingles))

    links = found.groupBy(F.col("class").alias("l_class")).agg(F.sum("links").alias("n_links"))
    groups = star_edges(found.select(F.col("class").alias("src"), F.col("root").alias("dst"))).select(F.col("id").alias("g_class"), "component")
    classed = classes.select("class", "digest", "n_copies", "least").join(links, F.col("class") == F.col("l_class"), "left").join(groups, F.col("class") == F.col("g_class"), "left")
    classed = classed.select("digest", "n_copies", "least", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "class").alias("group"))
    leasts = classed.groupBy(F.col("group").alias("k_group")).agg(F.min(F.struct(F.col("least").isNotNull(), "least"))["least"].alias("class_id"))
    classed = classed.join(leasts, F.col("group") == F.col("k_group")).select(F.col("digest").alias("c_digest"), "n_copies", "n_links", "class_id", F.col("group").alias("class_no"))
    out = sketches.drop("label").join(classed, F.col("digest") == F.col("c_digest"), "left")
    alone = F.col("digest").isNull()
    return out.select("node", "check", F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "class_no", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _verified(documents: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, group_docs: int, block_shingles: int) -> DataFrame:
    """(class, links, root) of members(class, component, row, n_shingles) with a link, a row per block pair."""
    spark = documents.sparkSession
    sizes = members.groupBy(F.col("component").alias("s_component")).agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("mass"))
    blocks = F.greatest(F.ceil(F.col("size") / group_docs), F.ceil(F.col("mass") / block_shingles)).cast("int")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("left"), F.greatest(k, F.col("block")).alias("right")))
    placed = members.join(sizes, F.col("component") == F.col("s_component")).withColumn("blocks", blocks).withColumn("block", block).withColumn("pair", F.explode(pairs))
    placed = materialise(placed.select("class", "component", "row", "n_shingles", "blocks", "block", "pair.left", "pair.right"))
    count, mass = placed.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // group_docs + 1, (mass or 0) // block_shingles + 1)
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", "left", "right"))
    wanted = placed.select(task.alias("task"), "class", "component", "block", "left", "right", F.col("row.node").alias("w_node"), F.col("row.check").alias("w_check"))
    if small_enough(placed, BROADCAST_MEMBERS):
        wanted = F.broadcast(wanted)
    texts = _nodes(documents, id_col, text_col).select("node", "check", "text")
    rows = texts.join(wanted, (F.col("node") == F.col("w_node")) & (F.col("check") == F.col("w_check"))).select("task", "class", "component", "block", "left", "right", "text")
    rows = rows.dropDuplicates(["task", "class", "left", "right"])  # repeated rows bring the same text
    return rows.groupBy("task").applyInArrow(tx.tidy(_verify(threshold, shingle)), "class long, links long, root long")


def drop_near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without all but one of each class (of the least identifier, then row).

    Documents without words all stay, except repeats of a whole row.
    """
    found = near_duplicates(documents, id_col=id_col, text_col=text_col, **options)
    order = F.struct(F.col(id_col).isNotNull(), id_col, "node", "check")
    keep = found.where("class_no is not null").groupBy("class_no").agg(F.min_by(F.struct("node", "check"), order).alias("k")).select(F.col("k.node").alias("k_node"), F.col("k.check").alias("k_check"))
    keep = keep.unionByName(found.where("class_no is null").select(F.col("node").alias("k_node"), F.col("check").alias("k_check")))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])  # whole rows: no column of documents can clash
    node, check = _identity(id_col, text_col)
    marked = documents.select(node.alias("weft_node"), check.alias("weft_check"), row.alias("weft_row"))
    kept = marked.join(keep, (F.col("weft_node") == F.col("k_node")) & (F.col("weft_check") == F.col("k_check")), "left_semi").dropDuplicates(["weft_node", "weft_check"])
    return kept.select(*[F.col(f"weft_row.`{c}`").alias(c) for c in documents.columns])
