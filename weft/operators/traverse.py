"""Breadth-first search, LIFO search, components, k nearest, and tree checks.

Searches are loops over frontiers: a level is one join of the frontier with
the darts, one aggregation that picks the first discoverer, and an anti join
with what is known.  Each level is checkpointed, so a plan never grows.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.model import Graph, View
from weft.operators.components import components as _components
from weft.plans import debug
from weft.shared import materialise, tidy


def _view(g: Graph | View) -> View:
    return g if isinstance(g, View) else View(g)


class _Levels:
    """Checkpointed levels of a search, merged by a counter to the base ``WIDTH``.

    Each row is written again once per power of the base that the number of
    levels reaches, and as many tables are read at most, times the base.
    """

    WIDTH = 8

    def __init__(self, first: DataFrame):
        self.parts = [(0, first)]

    def add(self, level: DataFrame) -> None:
        self.parts.append((0, level))
        while len(self.parts) >= self.WIDTH and len({k for k, _ in self.parts[-self.WIDTH :]}) == 1:
            k, last = self.parts[-1][0], [t for _, t in self.parts[-self.WIDTH :]]
            self.parts[-self.WIDTH :] = [(k + 1, materialise(reduce(DataFrame.unionByName, last)))]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for _, t in self.parts])


def bfs(g: Graph | View, source: int, max_depth: int = 0) -> DataFrame:
    """(id, dist, parent) of every vertex seen; dist and parent null where unreached.

    The parent is the one that a queue would find: of the discoverers, the one
    discovered first, and its first dart.  max_depth 0: no bound.  A source
    outside the view is an error.
    """
    view = _view(g)
    darts, vertices = materialise(view.darts()), view.vertices().select("id")
    reached = vertices.where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("parent"), F.lit(1).cast("long").alias("rank"))
    if reached.isEmpty():
        raise ValueError("the source is not in the view")
    frontier, level = materialise(reached), 0
    seen = _Levels(frontier)
    while not max_depth or level < max_depth:
        step = frontier.select(F.col("id").alias("src"), "rank").join(darts, "src")
        found = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("rank", "pos", "src")).alias("via"))
        found = found.join(seen.all().select("id"), "id", "left_anti")
        level += 1
        # Ranks order the level by discoverer; ids of one level are dealt by range, not to one task.
        ranked = _dense_order(found, F.col("via.rank"), F.col("via.pos"))
        frontier = materialise(ranked.select("id", F.lit(level).cast("long").alias("dist"), F.col("via.src").alias("parent"), "rank"))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return vertices.join(seen.all().select("id", "dist", "parent"), "id", "left")


def _dense_order(df: DataFrame, *keys) -> DataFrame:
    """df with ``rank``: its place in the order of (keys, id), up to gaps.

    Range partitions keep the order, so partition and place in it are enough.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    order = [f"_k{i}" for i in range(len(keys))] + ["id"]
    ranged = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.withColumn("rank", F.monotonically_increasing_id()).drop(*order[:-1])


def bfs_histogram(distances: DataFrame) -> DataFrame:
    return distances.groupBy("dist").agg(F.count(F.lit(1)).alias("n"))


def components(g: Graph | View) -> DataFrame:
    """(id, component): labels 0, 1, ... in the order of the components' least ids.

    Directed graphs are taken as undirected.
    """
    view = _view(g)
    least = materialise(_components(view.vertices().select("id"), view.darts(), "id", "src", "dst"))
    heads = least.where("id = component").select("component", F.lit(1).cast("long").alias("one"))
    from weft.model import running_sum

    numbered = running_sum(heads, "component", "one", "label")
    return least.join(numbered.select(F.col("component").alias("k"), "label"), F.col("component") == F.col("k")).select("id", F.col("label").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(labels: DataFrame) -> DataFrame:
    """(id) of the largest component, the first of equals."""
    best = component_sizes(labels).agg(F.max(F.struct("size", (-F.col("component")).alias("k")))["k"].alias("k")).select((-F.col("k")).alias("component"))
    return labels.join(F.broadcast(best), "component", "left_semi").select("id")  # one row


def is_connected(g: Graph | View) -> DataFrame:
    return components(g).agg((F.count_distinct("component") <= 1).alias("connected"))


@dataclass
class SearchProfile:
    """Counters of nearest-vertex searches since the last reset: searches, vertices they visited, most by one."""

    queries: int = 0
    visited: int = 0
    most: int = 0

    def reset(self) -> None:
        self.queries = self.visited = self.most = 0

    def record(self, seen: DataFrame) -> None:
        """seen(source, n): vertices seen by each search."""
        queries, visited, most = seen.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
        self.queries += queries
        self.visited += visited or 0
        self.most = max(self.most, most or 0)
        debug.say("knn-profile", f"{queries} searches visited {visited or 0} vertices, {most or 0} at most")


#: Counted while the switch ``knn-profile`` is on.
PROFILE = SearchProfile()


def k_nearest(g: Graph | View, sources: DataFrame, k: int, among: DataFrame | None = None, max_depth: int = 0) -> DataFrame:
    """(source, rank, id, dist): up to k hits nearest to each source, the source excluded.

    Hits are in ``among`` (all vertices, if not given), which bounds hits, not
    the way to them; equal distances are in the order of a queue search.

    Blocks of sources are searched in tasks, each over packed lists of the
    vertices that its searches come to.  Rounds find which lists those are: a
    search stops at k hits, or asks for the lists it misses.  Vertices seen are
    never rows of a table; without a bound on k, hits are made as the result
    is read.
    """
    out = _nearest(g, sources, k, among, max_depth, "hits")
    return out if k >= EVERY else materialise(out)


def nearest_lists(g: Graph | View, sources: DataFrame, k: int, among: DataFrame | None = None) -> DataFrame:
    """k_nearest in packed form, a row for up to ``SOURCES_A_ROW`` sources that have hits: their ids, numbers of hits,
    hits and distances, one source after the other."""
    return materialise(_nearest(g, sources, k, among, 0, "packed"))


def listed(packed: DataFrame) -> DataFrame:
    """(src, dst, dist) of nearest_lists."""

    def rows(batches):
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                source, n, ids, dists = unpacked(*row)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(source, n)), pa.array(ids), pa.array(dists.astype(np.int64))], ["src", "dst", "dist"])

    return packed.mapInArrow(rows, "src long, dst long, dist long")


def unpacked(sources: bytes, counts: bytes, ids: bytes, dists: bytes) -> tuple[np.ndarray, ...]:
    """Sources, numbers of hits, hits and distances of a row of nearest_lists."""
    return np.frombuffer(sources, np.int64), np.frombuffer(counts, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(dists, np.int32)


def _nearest(g: Graph | View, sources: DataFrame, k: int, among: DataFrame | None, max_depth: int, mode: str) -> DataFrame:
    view = _view(g)
    spark = view.graph.vertices.sparkSession
    if k <= 0:
        return spark.createDataFrame([], _Search(k, max_depth, 0, mode).schema())
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    lists = materialise(_packed_lists(view.darts(), among))
    tidy(spark)  # the lists' shuffles are of no more use
    inside = view.vertices().select("id")
    starts = sources.select(F.col("id").alias("source")).distinct().join(inside, F.col("source") == F.col("id"), "left_semi").select("source")
    starts = materialise(starts)
    blocks = max(1, -(-starts.count() // BLOCK_SOURCES))
    starts = starts.select(F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block"), "source")
    n_lists, n_entries = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if blocks * n_lists <= WHOLE_LISTS and blocks * n_entries <= WHOLE_ENTRIES:
        every = lists.crossJoin(F.broadcast(spark.range(blocks).select(F.col("id").cast("int").alias("block")))).select("block", "id")
        if debug.on("knn-profile"):
            PROFILE.record(_searched(starts, every, lists, blocks, _Search(k, max_depth, 0, "count", True)))
        return _searched(starts, every, lists, blocks, _Search(k, max_depth, 0, mode, True))
    asked = materialise(starts.select("block", F.col("source").alias("id")))
    open_, window, level = starts, FIRST_WINDOW, 1
    while not (k >= EVERY and level == max_depth):
        out = materialise(_searched(open_, asked, lists, blocks, _Search(k, max_depth, window, "ask")))
        more = out.where("kind = 0").select("block", "id").distinct()
        if more.isEmpty():
            break
        asked = materialise(asked.unionByName(more))
        open_ = out.where("kind = 1").select("block", F.col("id").alias("source"))
        window, level = 4 * window, level + 1
    if debug.on("knn-profile"):
        PROFILE.record(_searched(starts, asked, lists, blocks, _Search(k, max_depth, 0, "count")))
    return _searched(starts, asked, lists, blocks, _Search(k, max_depth, 0, mode))


#: Sources that are searched together, from one set of lists; vertices whose lists a search without an end asks for at
#: first, four times as many each round; a k that no search reaches.
BLOCK_SOURCES, FIRST_WINDOW, EVERY = 8192, 32, 1 << 30
#: Lists and their entries, over all blocks, up to which each block gets all lists at once.
WHOLE_LISTS, WHOLE_ENTRIES = 1 << 14, 1 << 22
HITS = "source long, rank int, id long, dist long"
#: Sources of a packed row; entries that a search with an end takes at first, and of lists that are kept unpacked, in each
#: list and in all.
SOURCES_A_ROW, FEW_ENTRIES, KEPT_ENTRIES = 1024, 1024, 1 << 21


def _packed_lists(darts: DataFrame, among: DataFrame | None) -> DataFrame:
    """(id, n, list): each vertex's list in its order, as differences of the least width, and a bit per entry in ``among``."""
    if among is None:
        darts = darts.select("src", "pos", "dst", F.lit(True).alias("hit"))
    else:
        marks = among.select(F.col("id").alias("m_id")).distinct()
        darts = darts.join(marks, F.col("dst") == F.col("m_id"), "left").select("src", "pos", "dst", F.col("m_id").isNotNull().alias("hit"))
    rows = darts.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "dst", "hit"))).alias("l"))

    def pack(batches):
        for b in batches:
            ends, hits = b.column("dst"), b.column("hit")
            n = np.diff(ends.offsets.to_numpy())
            dst, hit, first = ends.flatten().to_numpy(), hits.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])
            packed = [_pack(dst[i:j], hit[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], ["id", "n", "list"])

    return rows.select("id", F.col("l.dst").alias("dst"), F.col("l.hit").alias("hit")).mapInArrow(pack, "id long, n int, list binary")


def _pack(dst: np.ndarray, hit: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        steps = np.diff(dst, prepend=dst[:1])
    kind = next((t for t in ("i1", "i2", "i4") if len(steps) and steps.min() >= np.iinfo(t).min and steps.max() <= np.iinfo(t).max), "i8")
    return b"".join([kind[1].encode(), np.int64(dst[0]).tobytes(), steps.astype(kind).tobytes(), np.packbits(hit).tobytes()])


def _unpack(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = data[0] - 48
    steps = np.frombuffer(data, f"i{width}", n, 9).astype(np.int64)
    hit = np.unpackbits(np.frombuffer(data, np.uint8, -1, 9 + n * width), count=n).view(bool)
    return np.cumsum(steps) + np.frombuffer(data, np.int64, 1, 1)[0], hit


NO_LIST = (0, None)


class _Lists(dict):
    """A block's packed lists by vertex; long ones stay unpacked."""

    def __init__(self):
        super().__init__()
        self.unpacked, self.kept = {}, 0

    def entries(self, vertex: int) -> tuple[np.ndarray, np.ndarray]:
        if vertex in self.unpacked:
            return self.unpacked[vertex]
        n, data = self[vertex]
        out = _unpack(n, data)
        if n >= FEW_ENTRIES and self.kept + n <= KEPT_ENTRIES:
            self.unpacked[vertex], self.kept = out, self.kept + n
        return out


@dataclass(frozen=True)
class _Search:
    """Queue searches from a block of sources over the lists that the block has asked for.

    mode: "hits", or "packed" for rows of nearest_lists; "ask" for lists that are missing (kind 0) and the sources
    that miss them (kind 1); "count" for the vertices seen.  whole: the block has all lists that there are.
    """

    k: int
    max_depth: int
    window: int
    mode: str
    whole: bool = False

    def schema(self) -> str:
        return {"hits": HITS, "packed": "sources binary, counts binary, ids binary, dists binary", "ask": "block int, kind int, id long", "count": "source long, n long"}[self.mode]

    def batches(self, rows):
        """Rows (block, kind, id, n, list) by block, lists (kind 0) before sources (kind 1)."""
        block, lists, wanted, full = None, _Lists(), set(), []
        for b in rows:
            for at, kind, vertex, n, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != block:
                    yield from self.asked(block, wanted)
                    block, lists, wanted = at, _Lists(), set()
                if kind == 0:
                    lists[vertex] = (n, data)
                    continue
                found, missing, n_seen = self.one(vertex, lists)
                if self.mode == "ask":
                    wanted.update(missing)
                    if missing:
                        yield self.batch([at], [1], [vertex])
                elif missing:
                    raise RuntimeError("a search misses a list")
                elif self.mode == "count":
                    yield self.batch([vertex], [n_seen])
                elif self.mode == "packed":
                    if len(found[0]):
                        full.append((vertex, *found))
                    if len(full) == SOURCES_A_ROW:
                        yield self.packed(full)
                        full = []
                elif len(found[0]):
                    n = len(found[0])
                    yield self.batch(np.full(n, vertex), np.arange(1, n + 1), *found)
        yield from self.asked(block, wanted)
        if full:
            yield self.packed(full)

    def packed(self, rows):
        source, ids, dists = zip(*rows, strict=True)
        columns = np.array(source, np.int64), np.array([len(x) for x in ids], np.int32), np.concatenate(ids).astype(np.int64), np.concatenate(dists).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["sources", "counts", "ids", "dists"])

    def asked(self, block, wanted):
        if wanted:
            ids = np.fromiter(wanted, np.int64, len(wanted))
            yield self.batch(np.full(len(ids), block), np.zeros(len(ids)), ids)

    def batch(self, *columns):
        fields = [f.split() for f in self.schema().split(", ")]
        kinds = {"int": (np.int32, pa.int32()), "long": (np.int64, pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(kinds[t][0]), kinds[t][1]) for c, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])

    def pieces(self, entries):
        """Entries of lists in their order; a search with an end seldom needs the rest of long ones."""
        if entries:
            dst, hit = entries[0] if len(entries) == 1 else (np.concatenate(c) for c in zip(*entries, strict=True))
            at, size = 0, len(dst) if self.k >= EVERY else max(FEW_ENTRIES, 2 * self.k)
            while at < len(dst):
                yield dst[at : at + size], hit[at : at + size]
                at, size = at + size, 4 * size

    def one(self, source: int, lists: _Lists) -> tuple[tuple[np.ndarray, np.ndarray], list[int], int]:
        """Hits and their distances in the order of the queue, vertices whose lists are missing, vertices seen."""
        seen = level = np.array([source], np.int64)
        ids, dists, n, depth = [], [], 0, 0
        while len(level) and not (self.max_depth and depth == self.max_depth):
            depth += 1
            new, at, size = [], 0, len(level) if self.k >= EVERY else FIRST_WINDOW
            while at < len(level):
                part = level[at : at + size].tolist()
                missing = [] if self.whole else [v for v in part if v not in lists]
                if missing:
                    ahead = level[at:].tolist() if self.k >= EVERY else level[at : at + max(size, self.window)].tolist()
                    return (ids, dists), [v for v in ahead if v not in lists], len(seen)
                entries = [lists.entries(v) for v in part if lists.get(v, NO_LIST)[1] is not None]
                at, size = at + size, size * 4
                for dst, hit in self.pieces(entries):
                    values, first = np.unique(dst, return_index=True)
                    fresh = seen[np.minimum(np.searchsorted(seen, values), len(seen) - 1)] != values
                    order = np.sort(first[fresh])
                    seen = np.sort(np.concatenate([seen, values[fresh]]), kind="stable")
                    new.append(dst[order])
                    hits = dst[order][hit[order]]
                    ids.append(hits)
                    dists.append(np.full(len(hits), depth))
                    n += len(hits)
                    if n >= self.k:
                        break
                if n >= self.k:
                    break
            if n >= self.k:
                break
            level = np.concatenate(new) if new else np.zeros(0, np.int64)
        none = [np.zeros(0, np.int64)]
        return (np.concatenate(ids or none)[: self.k], np.concatenate(dists or none)[: self.k]), [], len(seen)


def _searched(starts: DataFrame, asked: DataFrame, lists: DataFrame, blocks: int, search: _Search) -> DataFrame:
    given = asked.join(lists, "id", "left").select("block", F.lit(0).alias("kind"), "id", "n", "list")
    rows = given.unionByName(starts.select("block", F.lit(1).alias("kind"), F.col("source").alias("id"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("list")))
    return rows.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(search.batches, search.schema())


def prefer_reverse(n_seeds: int, n_targets: int, avg_degree: float) -> bool:
    """Whether searching from the seeds beats searching from the targets.

    Fixed values of the rule: 256 seeds at most, degree over 32, or eight
    targets a seed.
    """
    return n_seeds < n_targets and n_seeds <= 256 and (avg_degree > 32 or n_targets >= 8 * n_seeds)


def k_nearest_from_seeds(g: Graph, targets: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(source, id, dist): k nearest seeds of each target, by searches from the seeds.

    Exact for undirected graphs: no search stops early.  Ties are by seed id.
    """
    reached = k_nearest(g, seeds, 1 << 30).select(F.col("id").alias("target"), F.col("source").alias("seed"), "dist")
    wanted = reached.join(targets.select(F.col("id").alias("target")), "target", "left_semi")
    w = Window.partitionBy("target").orderBy("dist", "seed")
    return wanted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("target").alias("source"), "rank", F.col("seed").alias("id"), "dist")


def nearest_placed(g: Graph, targets: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(source, rank, id, dist): k nearest seeds of each target, searched from the side that the rule prefers."""
    n_seeds, n_targets = seeds.count(), targets.count()
    degree = g.darts.count() / max(1, g.vertices.count())
    if not g.directed and prefer_reverse(n_seeds, n_targets, degree):
        return k_nearest_from_seeds(g, targets, seeds, k)
    return k_nearest(g, targets, k, seeds)


def within_radius(g: Graph | View, sources: DataFrame, radius: int) -> DataFrame:
    """(source, id, dist) of vertices at most ``radius`` hops away, sources excluded."""
    return k_nearest(g, sources, 1 << 30, None, radius).select("source", "id", "dist")


def lifo_tree(g: Graph | View, source: int) -> DataFrame:
    """(id, parent) of a search with a stack that marks vertices when pushed.

    Inherently sequential: the packed lists of vertices reachable from the
    source go to one task, which keeps them in a file of its own and reads each
    when its vertex is popped.
    """
    view = _view(g)
    spark = view.graph.vertices.sparkSession
    if view.vertices().where(F.col("id") == source).isEmpty():
        raise ValueError("the source is not in the view")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    packed = materialise(_packed_lists(view.darts(), None))
    tidy(spark)
    reach = _reachable(packed, source)
    lists = reach.join(packed.withColumnRenamed("id", "l_id"), F.col("id") == F.col("l_id"), "left").select("id", "n", "list")

    def run(batches):
        with tempfile.TemporaryFile() as data:
            ids, counts, sizes = [], [], []
            for b in batches:
                ids.append(b.column("id").to_numpy())
                counts.append(b.column("n").fill_null(0).to_numpy())
                lists = [p or b"" for p in b.column("list").to_pylist()]
                sizes.append(np.array([len(p) for p in lists], np.int64))
                data.writelines(lists)
            data.flush()
            yield from _lifo(source, np.concatenate(ids), np.concatenate(counts), np.concatenate(sizes), data.fileno())

    return lists.repartition(1).mapInArrow(run, "id long, parent long")


def _reachable(packed: DataFrame, source: int) -> DataFrame:
    """(id) of the source and the vertices that lists lead to, level by level."""

    def ends(batches):
        for b in batches:
            found = [_unpack(n, data)[0] for n, data in zip(b.column("n").to_pylist(), b.column("list").to_pylist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["id"])

    frontier = materialise(packed.sparkSession.createDataFrame([(source,)], "id long"))
    seen = _Levels(frontier)
    while True:
        lists = packed.join(frontier, "id", "left_semi").select("n", "list").mapInArrow(ends, "id long")
        frontier = materialise(lists.distinct().join(seen.all(), "id", "left_anti"))
        if frontier.isEmpty():
            return seen.all()
        seen.add(frontier)


def _lifo(source: int, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, file: int):
    """Batches (id, parent); ``file`` holds the lists one after the other, of so many entries and bytes."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(ids)
    named = ids[order]
    seen, parent = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
    root = int(np.searchsorted(named, source))
    seen[root], stack = True, np.zeros(len(ids), np.int32 if len(ids) < 1 << 31 else np.int64)
    stack[0], top = root, 1  # a vertex is pushed once
    while top:
        top -= 1
        u = stack[top]
        at = order[u]
        if counts[at]:
            dst, _ = _unpack(int(counts[at]), os.pread(file, sizes[at], starts[at]))
            v = np.searchsorted(named, dst)
            v = v[~seen[v]]
            new = v[np.sort(np.unique(v, return_index=True)[1])]  # an edge may be repeated
            seen[new], parent[new] = True, named[u]
            stack[top : top + len(new)] = new
            top += len(new)
    alone = np.arange(len(ids)) == root
    for at in range(0, len(ids), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(named[part]), pa.array(parent[part], mask=alone[part])], ["id", "parent"])


def tree_check(g: Graph) -> int:
    """1 a tree; 0 wrong edge count or unreachable; -1 an in-degree above 1 or several roots; -2 undirected."""
    if not g.directed:
        return -2
    n, m = g.size().first()[0], g.darts.count()
    into = g.darts.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    if not into.where("d > 1").isEmpty():
        return -1
    roots = g.vertices.join(into, "id", "left_anti").limit(2).collect()
    if len(roots) > 1:
        return -1
    if not roots or m != n - 1:
        return 0
    return int(bfs(g, roots[0]["id"]).where("dist is not null").count() == n)


def tree_parents(g: Graph) -> DataFrame:
    """(id, parent) of a tree, parent null at the root."""
    up = g.darts.select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    return g.vertices.select("id").join(up, "id", "left")


def leaves(g: Graph) -> DataFrame:
    return g.vertices.select("id").join(g.darts.select(F.col("src").alias("id")), "id", "left_anti")


def count_leaves(g: Graph, root: int) -> DataFrame:
    """Leaves at or below root."""
    below = bfs(g, root).where("dist is not null").select("id")
    return leaves(g).join(below, "id", "left_semi").agg(F.count(F.lit(1)).alias("n_leaves"))
