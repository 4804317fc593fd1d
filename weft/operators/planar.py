"""Planarity, faces and drawings of planar graphs.

Set-oriented steps (half-edges, faces, areas, picking) are DataFrame
operations on any graph.  The sequential ones (planarity test with rotation,
witness, triangulation, Schnyder wood) run as one kernel per connected
component, so components proceed in parallel and a task holds one component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.geometry import crosses, inside, polygon_edges, signed_area
from weft.model import Graph, View, running_sum
from weft.operators.components import components
from weft.shared import materialise

# ---- kernels ----------------------------------------------------------------


class _Interval:
    __slots__ = ("low", "high")

    def __init__(self, low=None, high=None):
        self.low, self.high = low, high

    def empty(self) -> bool:
        return self.low is None and self.high is None


class _Pair:
    """Return edges that must lie on opposite sides."""

    __slots__ = ("left", "right")

    def __init__(self, left=None, right=None):
        self.left, self.right = left or _Interval(), right or _Interval()

    def swap(self) -> None:
        self.left, self.right = self.right, self.left


class LeftRight:
    """The left-right planarity test (Brandes 2009) on adjacency lists.

    ``rotation()`` gives each vertex's neighbours in cyclic order, or None.
    Loops and parallel edges are ignored.  No recursion: depth is bounded by
    memory alone.
    """

    def __init__(self, lists: dict[int, list[int]]):
        self.adj = {v: list(dict.fromkeys(u for u in us if u != v)) for v, us in lists.items()}
        self.height: dict[int, int] = {}
        self.parent: dict[int, tuple[int, int] | None] = {}
        self.low, self.low2, self.nest = {}, {}, {}
        self.out: dict[int, list[int]] = {v: [] for v in self.adj}
        self.ref, self.side, self.low_edge, self.bottom = {}, {}, {}, {}
        self.stack: list[_Pair] = []
        self.roots: list[int] = []

    def rotation(self) -> dict[int, list[int]] | None:
        n, m = len(self.adj), sum(map(len, self.adj.values())) // 2
        if n > 2 and m > 3 * n - 6:
            return None
        for v in self.adj:
            if v not in self.height:
                self.height[v], self.parent[v] = 0, None
                self.roots.append(v)
                self._orient(v)
        for v in self.adj:
            self.out[v].sort(key=lambda w, v=v: self.nest[v, w])
        for v in self.roots:
            if not self._test(v):
                return None
        return self._embed()

    def _orient(self, root: int) -> None:
        work = [(root, iter(self.adj[root]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if (v, w) in self.low or (w, v) in self.low:
                    continue
                e = (v, w)
                self.out[v].append(w)
                self.low[e] = self.low2[e] = self.height[v]
                if w not in self.height:
                    self.parent[w], self.height[w] = e, self.height[v] + 1
                    work.append((w, iter(self.adj[w])))
                    break
                self.low[e] = self.height[w]
                self._settle(e)
            else:
                work.pop()
                if self.parent[v] is not None:
                    self._settle(self.parent[v])

    def _settle(self, e: tuple[int, int]) -> None:
        """Nesting depth of a finished edge, and its low points passed on."""
        v = e[0]
        self.nest[e] = 2 * self.low[e] + (self.low2[e] < self.height[v])
        up = self.parent[v]
        if up is None:
            return
        if self.low[e] < self.low[up]:
            self.low2[up] = min(self.low[up], self.low2[e])
            self.low[up] = self.low[e]
        elif self.low[e] > self.low[up]:
            self.low2[up] = min(self.low2[up], self.low[e])
        else:
            self.low2[up] = min(self.low2[up], self.low2[e])

    def _test(self, root: int) -> bool:
        work = [[root, 0]]
        while work:
            v, i = work[-1]
            up, kids = self.parent[v], self.out[v]
            if i > 0 and not self._after(v, kids[i - 1], i == 1):
                return False
            if i < len(kids):
                work[-1][1] += 1
                w = kids[i]
                e = (v, w)
                self.bottom[e] = self.stack[-1] if self.stack else None
                if self.parent[w] == e:
                    work.append([w, 0])
                else:
                    self.low_edge[e] = e
                    self.stack.append(_Pair(right=_Interval(e, e)))
            else:
                work.pop()
                if up is not None:
                    self._drop(up)
        return True

    def _after(self, v: int, w: int, first: bool) -> bool:
        e, up = (v, w), self.parent[v]
        if self.low[e] < self.height[v]:
            if first:
                self.low_edge[up] = self.low_edge[e]
            else:
                return self._constrain(e, up)
        return True

    def _conflict(self, part: _Interval, e: tuple[int, int]) -> bool:
        return not part.empty() and self.low[part.high] > self.low[e]

    def _constrain(self, e: tuple[int, int], up: tuple[int, int]) -> bool:
        p = _Pair()
        while True:  # the return edges of e on one side
            q = self.stack.pop()
            if not q.left.empty():
                q.swap()
            if not q.left.empty():
                return False
            if self.low[q.right.low] > self.low[up]:
                if p.right.empty():
                    p.right.high = q.right.high
                else:
                    self.ref[p.right.low] = q.right.high
                p.right.low = q.right.low
            else:
                self.ref[q.right.low] = self.low_edge[up]
            if (self.stack[-1] if self.stack else None) is self.bottom[e]:
                break
        while self.stack and (self._conflict(self.stack[-1].left, e) or self._conflict(self.stack[-1].right, e)):
            q = self.stack.pop()  # conflicting ones of earlier edges on the other
            if self._conflict(q.right, e):
                q.swap()
            if self._conflict(q.right, e):
                return False
            if p.right.low is not None:
                self.ref[p.right.low] = q.right.high
            if q.right.low is not None:
                p.right.low = q.right.low
            if p.left.empty():
                p.left.high = q.left.high
            else:
                self.ref[p.left.low] = q.left.high
            p.left.low = q.left.low
        if not (p.left.empty() and p.right.empty()):
            self.stack.append(p)
        return True

    def _lowest(self, p: _Pair) -> int:
        if p.left.empty():
            return self.low[p.right.low]
        if p.right.empty():
            return self.low[p.left.low]
        return min(self.low[p.left.low], self.low[p.right.low])

    def _drop(self, e: tuple[int, int]) -> None:
        """Removes return edges that end at e's source."""
        u = e[0]
        while self.stack and self._lowest(self.stack[-1]) == self.height[u]:
            p = self.stack.pop()
            if p.left.low is not None:
                self.side[p.left.low] = -1
        if self.stack:
            p = self.stack[-1]
            for own, other in ((p.left, p.right), (p.right, p.left)):
                while own.high is not None and own.high[1] == u:
                    own.high = self.ref.get(own.high)
                if own.high is None and own.low is not None:
                    self.ref[own.low] = other.low
                    self.side[own.low] = -1
                    own.low = None
        if self.low[e] < self.height[u] and self.stack:
            left, right = self.stack[-1].left.high, self.stack[-1].right.high
            if left is not None and (right is None or self.low[left] > self.low[right]):
                self.ref[e] = left
            else:
                self.ref[e] = right

    def _sign(self, e: tuple[int, int]) -> int:
        chain = []
        while self.ref.get(e) is not None:
            chain.append(e)
            e = self.ref[e]
        s = self.side.get(e, 1)
        for x in reversed(chain):
            s = self.side[x] = self.side.get(x, 1) * s
            self.ref[x] = None
        return s

    def _embed(self) -> dict[int, list[int]]:
        for v in self.adj:
            for w in self.out[v]:
                self.nest[v, w] *= self._sign((v, w))
        nxt: dict[int, dict[int, int]] = {v: {} for v in self.adj}
        prv: dict[int, dict[int, int]] = {v: {} for v in self.adj}
        first: dict[int, int] = {}

        def put(v: int, w: int, after: int | None) -> None:
            if after is None:  # alone
                nxt[v][w] = prv[v][w] = w
                return
            b = nxt[v][after]
            nxt[v][after] = prv[v][b] = w
            prv[v][w], nxt[v][w] = after, b

        for v in self.adj:
            self.out[v].sort(key=lambda w, v=v: self.nest[v, w])
            last = None
            for w in self.out[v]:
                put(v, w, last)
                last = w
            if self.out[v]:
                first[v] = self.out[v][0]
        left, right = {}, {}
        for root in self.roots:
            work = [(root, iter(self.out[root]))]
            while work:
                v, rest = work[-1]
                for w in rest:
                    e = (v, w)
                    if self.parent[w] == e:
                        put(w, v, prv[w][first[w]] if w in first else None)
                        first[w] = v
                        left[v] = right[v] = w
                        work.append((w, iter(self.out[w])))
                        break
                    if self.side.get(e, 1) == 1:
                        put(w, v, right[w])
                    else:
                        put(w, v, prv[w][left[w]])
                        if first.get(w) == left[w]:
                            first[w] = v
                        left[w] = v
                else:
                    work.pop()
        out = {}
        for v in self.adj:
            ring = []
            if nxt[v]:
                start = w = min(nxt[v])
                while True:
                    ring.append(w)
                    w = prv[v][w]  # counter-clockwise
                    if w == start:
                        break
            out[v] = ring
        return out


def walk_faces(rotation: dict[int, list[int]]) -> list[list[int]]:
    """Orbits of the half-edges: after u -> v comes v -> the neighbour before u in v's order."""
    before = {v: {u: ring[i - 1] for i, u in enumerate(ring)} for v, ring in rotation.items()}
    seen, faces = set(), []
    for u in sorted(rotation):
        for v in rotation[u]:
            if (u, v) in seen:
                continue
            face, a, b = [], u, v
            while (a, b) not in seen:
                seen.add((a, b))
                face.append(a)
                a, b = b, before[b][a]
            faces.append(face)
    return faces


def witness(lists: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Edges of a subdivision of K5 or K3,3 in a non-planar graph.

    Edges whose removal leaves the graph non-planar go, in halving groups and
    then one by one; what remains is minimal.
    """
    edges = sorted({(min(u, v), max(u, v)) for u, vs in lists.items() for v in vs if u != v})

    def planar(some: list[tuple[int, int]]) -> bool:
        adj: dict[int, list[int]] = {}
        for u, v in some:
            adj.setdefault(u, []).append(v)
            adj.setdefault(v, []).append(u)
        return LeftRight(adj).rotation() is not None

    group = max(1, len(edges) // 2)
    while True:
        i = 0
        while i < len(edges):
            rest = edges[:i] + edges[i + group :]
            if rest and not planar(rest):
                edges = rest
            else:
                i += group
        if group == 1:
            return edges
        group = max(1, group // 2)


def triangulate_rotation(rotation: dict[int, list[int]]) -> dict[int, list[int]]:
    """The rotation with chords that leave triangles alone; no parallel edge arises."""
    rot = {v: list(r) for v, r in rotation.items()}
    linked = {v: set(r) for v, r in rot.items()}
    for face in walk_faces(rot):
        ring = list(face)
        i = stuck = 0
        while len(ring) > 3 and stuck <= len(ring):
            k = len(ring)
            a, b, c = ring[i % k], ring[(i + 1) % k], ring[(i + 2) % k]
            if a != c and c not in linked[a]:
                z, d = ring[(i - 1) % k], ring[(i + 3) % k]
                # The face lies between b and the one before it at a, and between d and b at c.
                rot[a].insert(rot[a].index(b) + 1, c) if rot[a][(rot[a].index(b) + 1) % len(rot[a])] == z else rot[a].insert(rot[a].index(b), c)
                rot[c].insert(rot[c].index(d) + 1, a) if rot[c][(rot[c].index(d) + 1) % len(rot[c])] == b else rot[c].insert(rot[c].index(d), a)
                linked[a].add(c)
                linked[c].add(a)
                del ring[(i + 1) % k]
                stuck = 0
                i %= len(ring)
            else:
                i, stuck = i + 1, stuck + 1
    return rot


def schnyder(rotation: dict[int, list[int]]) -> tuple[list[int], list[dict[int, int]]]:
    """(roots, parents of interior vertices in each of three trees) of a triangulation.

    Vertices are taken off the outer cycle in a canonical order: each time one
    that is not a root and has no chord; its neighbours on the cycle are its
    first two parents, and it is the third parent of those it uncovers.
    """
    n = len(rotation)
    start = min(rotation)
    if n < 3 or not rotation[start]:
        raise ValueError("a triangulation has three vertices at least")
    before = {v: {u: ring[i - 1] for i, u in enumerate(ring)} for v, ring in rotation.items()}
    a, b = start, rotation[start][0]
    c = before[b][a]  # the face a, b, c is outside
    after = {v: {u: ring[(i + 1) % len(ring)] for i, u in enumerate(ring)} for v, ring in rotation.items()}
    trees: list[dict[int, int]] = [{}, {}, {}]
    # Outer path from a to b through c; neighbours on the path both ways.
    right, left = {a: c, c: b}, {c: a, b: c}
    outside, removed = {a, b, c}, set()
    chords = {v: 0 for v in rotation}
    ready = [c]
    while ready:
        v = ready.pop()
        if v in removed or v not in outside or chords[v] or v in (a, b):
            continue
        p, q = left[v], right[v]
        if v != c:
            trees[0][v], trees[1][v] = p, q
        removed.add(v)
        outside.discard(v)
        # Neighbours of v strictly inside, from p to q: the way round that meets nothing removed.
        for turn in (before, after):
            fan, w = [], turn[v][p]
            while w != q:
                fan.append(w)
                w = turn[v][w]
            if not any(x in removed for x in fan) and (v != c or b not in fan):
                break
        path = [p, *fan, q]
        for x, y in zip(path, path[1:], strict=False):
            right[x], left[y] = y, x
        if not fan:  # p and q become neighbours on the cycle: their chord is gone
            for x in (p, q):
                chords[x] -= 1
        for x in fan:
            trees[2][x] = v
            outside.add(x)
        for x in fan:
            for y in rotation[x]:
                if y in outside and y != left.get(x) and y != right.get(x):
                    chords[x] += 1
                    if y not in fan:
                        chords[y] += 1
        ready += [x for x in path if x in outside and x not in (a, b) and not chords[x]]
    return [a, b, c], trees


def schnyder_positions(roots: list[int], trees: list[dict[int, int]], vertices: list[int]) -> dict[int, tuple[int, int]]:
    """Schnyder's drawing on a grid of n - 2: region sizes less path lengths."""
    n = len(vertices)
    inner = [v for v in vertices if v not in roots]
    if n == 3:
        return {roots[0]: (1, 0), roots[1]: (0, 1), roots[2]: (0, 0)}
    order, size = [], []
    for t, root in zip(trees, roots, strict=True):
        kids: dict[int, list[int]] = {}
        for v in inner:
            kids.setdefault(t[v], []).append(v)
        seq = [root]
        for v in seq:
            seq.extend(kids.get(v, []))
        count = dict.fromkeys(seq, 1)
        for v in reversed(seq[1:]):
            count[t[v]] += count[v]
        order.append(seq)
        size.append(count)
    depth = [{roots[i]: 1} for i in range(3)]
    for i in range(3):
        for v in order[i][1:]:
            depth[i][v] = depth[i][trees[i][v]] + 1
    # sums[i][j][v]: of tree i's subtree sizes along v's path in tree j
    sums = [[{} for _ in range(3)] for _ in range(3)]
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            s = sums[i][j]
            s[roots[j]] = 1 if roots[j] != roots[i] else size[i][roots[i]]
            for v in order[j][1:]:
                s[v] = s[trees[j][v]] + size[i][v]
    out = {}
    for v in inner:
        r = [sums[i][(i + 1) % 3][v] + sums[i][(i + 2) % 3][v] - size[i][v] for i in range(3)]
        p = [depth[i][v] for i in range(3)]
        out[v] = (r[0] - p[2], r[1] - p[0])
    out[roots[0]], out[roots[1]], out[roots[2]] = (n - 2, 1), (0, n - 2), (1, 0)
    return out


def _lists(frame: pd.DataFrame) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {int(v): [] for v in frame.src.unique()}
    for u, v in zip(frame.src.tolist(), frame.dst.tolist(), strict=True):
        if v >= 0:
            out[u].append(v)
            out.setdefault(v, [])
    return out


# ---- operators --------------------------------------------------------------


def _by_component(g: Graph | View) -> DataFrame:
    """(component, src, pos, dst); an isolated vertex has a row with dst -1."""
    view = g if isinstance(g, View) else View(g)
    label = materialise(components(view.vertices().select("id"), view.darts()))
    darts = view.darts()
    both = darts.unionByName(label.join(darts, F.col("id") == F.col("src"), "left_anti").select(F.col("id").alias("src"), F.lit(0).alias("pos"), F.lit(-1).cast("long").alias("dst")))
    return both.join(label.withColumnRenamed("id", "src"), "src")


def _per_component(g, run, schema: str) -> DataFrame:
    return _by_component(g).groupBy("component").applyInPandas(lambda f: run(f.sort_values(["src", "pos"])), schema)


def _sparse_or_not(g: Graph | View) -> tuple[DataFrame, DataFrame]:
    """(rows of components that may be planar, (component) of those with more than 3 V - 6 edges).

    The count of edges is a distributed aggregation, so a dense component of
    any size never goes to one task.
    """
    rows = materialise(_by_component(g))
    n = rows.groupBy("component").agg(F.count_distinct("src").alias("n"))
    edges = rows.where("dst >= 0 and src <> dst").select("component", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    m = edges.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    dense = materialise(n.join(m, "component").where("n >= 3 and m > 3 * n - 6").select("component"))
    return rows.join(dense, "component", "left_anti"), dense


def planar_rotation(g: Graph | View) -> DataFrame:
    """(src, pos, dst) with each list counter-clockwise; no row for a component that isn't planar."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rot = LeftRight(_lists(frame.sort_values(["src", "pos"]))).rotation() or {}
        rows = [(u, i, v) for u, ring in rot.items() for i, v in enumerate(ring)]
        return pd.DataFrame(rows, columns=["src", "pos", "dst"]).astype({"src": "int64", "pos": "int32", "dst": "int64"})

    return _sparse_or_not(g)[0].groupBy("component").applyInPandas(run, "src long, pos int, dst long")


def is_planar(g: Graph | View) -> DataFrame:
    """(component, planar)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"component": frame.component.iloc[:1], "planar": [LeftRight(_lists(frame.sort_values(["src", "pos"]))).rotation() is not None]})

    rows, dense = _sparse_or_not(g)
    return rows.groupBy("component").applyInPandas(run, "component long, planar boolean").unionByName(dense.withColumn("planar", F.lit(False)))


def kuratowski(g: Graph | View) -> DataFrame:
    """(component, src, dst): a witness for each component that isn't planar."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lists = _lists(frame)
        rows = [] if LeftRight(lists).rotation() is not None else witness(lists)
        return pd.DataFrame({"component": [int(frame.component.iloc[0])] * len(rows), "src": [a for a, _ in rows], "dst": [b for _, b in rows]}).astype("int64")

    return _per_component(g, run, "component long, src long, dst long")


def apply_rotation(g: Graph) -> Graph:
    """The graph with its lists in rotation order, where planar; else a ValueError."""
    rot = materialise(planar_rotation(g))
    if rot.count() != g.darts.where("src <> dst").dropDuplicates(["src", "dst"]).count():
        raise ValueError("not planar")
    return Graph(g.vertices, rot, g.directed)


def triangulate(rotated: Graph) -> Graph:
    """Adds chords until every face of each component has three vertices."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rot = triangulate_rotation(_lists(frame))
        rows = [(u, i, v) for u, ring in rot.items() for i, v in enumerate(ring)]
        return pd.DataFrame(rows, columns=["src", "pos", "dst"]).astype({"src": "int64", "pos": "int32", "dst": "int64"})

    return Graph(rotated.vertices, materialise(_per_component(rotated, run, "src long, pos int, dst long")), False)


def schnyder_wood(triangulated: Graph) -> DataFrame:
    """(tree, id, parent): parents of interior vertices; roots with a null parent."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lists = _lists(frame)
        rows = []
        if len(lists) >= 3:
            roots, trees = schnyder(lists)
            rows = [(i, v, p) for i, t in enumerate(trees) for v, p in t.items()] + [(i, r, None) for i, r in enumerate(roots)]
        out = pd.DataFrame(rows, columns=["tree", "id", "parent"])
        return out.astype({"tree": "int32", "id": "int64", "parent": "Int64"})

    return _per_component(triangulated, run, "tree int, id long, parent long")


def schnyder_embedding(triangulated: Graph) -> DataFrame:
    """(id, x, y): a straight-line drawing without crossings on a grid, per component."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lists = _lists(frame)
        if len(lists) >= 3:
            pos = schnyder_positions(*schnyder(lists), sorted(lists))
        else:
            pos = {v: (i, 0) for i, v in enumerate(sorted(lists))}
        return pd.DataFrame({"id": list(pos), "x": [float(x) for x, _ in pos.values()], "y": [float(y) for _, y in pos.values()]})

    return _per_component(triangulated, run, "id long, x double, y double")


def planar_embedding(g: Graph) -> DataFrame:
    """(id, x, y): rotation, triangulation, wood and drawing in turn."""
    return schnyder_embedding(triangulate(apply_rotation(g)))


# ---- half-edges and faces as DataFrames -------------------------------------


def around(rotated: Graph) -> DataFrame:
    """(src, dst, prev, next): each dart's circular neighbours in its list."""
    w = Window.partitionBy("src").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rotated.darts.select("src", "pos", "dst", F.coalesce(F.lag("dst").over(w), F.last("dst").over(whole)).alias("prev"), F.coalesce(F.lead("dst").over(w), F.first("dst").over(whole)).alias("next"))


def next_dart(rotated: Graph) -> DataFrame:
    """(src, dst, next_src, next_dst): the dart after src -> dst on its face.

    It leaves dst for the neighbour before src there: one self-join with twins.
    """
    twin = around(rotated).select(F.col("src").alias("t_src"), F.col("dst").alias("t_dst"), "prev")
    d = rotated.darts.select("src", "dst")
    return d.join(twin, (d.src == twin.t_dst) & (d.dst == twin.t_src)).select("src", "dst", F.col("dst").alias("next_src"), F.col("prev").alias("next_dst"))


def faces(rotated: Graph, least: int = 3) -> DataFrame:
    """(face_id, verts): orbits of next_dart by pointer doubling, of ``least`` vertices or more.

    Faces are numbered by their first dart in the order of (src, pos).  Each
    round doubles the reach of every pointer: log2 of the longest face's rounds.
    """
    order = rotated.bits().select("src", "dst", "bit")
    step = next_dart(rotated).join(order, ["src", "dst"])
    ahead = order.select(F.col("src").alias("next_src"), F.col("dst").alias("next_dst"), F.col("bit").alias("to"))
    state = materialise(step.join(ahead, ["next_src", "next_dst"]).select("bit", "src", "to", F.col("bit").alias("head")))
    base = state
    while True:
        far = state.select(F.col("bit").alias("to"), F.col("head").alias("h2"), F.col("to").alias("t2"))
        state2 = materialise(state.join(far, "to").select("bit", "src", F.col("t2").alias("to"), F.least("head", "h2").alias("head")))
        moved = state2.join(state.select("bit", F.col("head").alias("old")), "bit").where("head <> old").isEmpty()
        state = state2
        if moved:
            break
    # Rank along the face: distance from each dart to the head, by doubling again.
    rank = base.join(state.select("bit", F.col("head").alias("h")), "bit").select("bit", "src", F.col("h").alias("head"), F.when(F.col("to") == F.col("h"), F.lit(None)).otherwise(F.col("to")).alias("to"), F.lit(1).cast("long").alias("left"))
    rank = materialise(rank)
    while not rank.where("to is not null").isEmpty():
        far = rank.select(F.col("bit").alias("k"), F.col("to").alias("t2"), F.col("left").alias("l2"))
        rank = materialise(rank.join(far, F.col("to") == F.col("k"), "left").select("bit", "src", "head", F.col("t2").alias("to"), (F.col("left") + F.coalesce("l2", F.lit(0))).alias("left")))
    rings = rank.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("k"), "src"))), lambda x: x["src"]).alias("verts")).where(F.size("verts") >= least)
    numbered = running_sum(rings.withColumn("one", F.lit(1).cast("long")), "head", "one", "face_id")
    return numbered.select("face_id", "verts")


def largest_face(face_rows: DataFrame) -> DataFrame:
    """The longest face, the first of equals."""
    best = face_rows.agg(F.max(F.struct(F.size("verts").alias("n"), (-F.col("face_id")).alias("k"), "verts")).alias("m"))
    return best.select((-F.col("m.k")).alias("face_id"), "m.verts")


def face_view(graph: Graph, verts: DataFrame) -> View:
    """The vertices (place, id) of a face and the darts along it as a view with listed edges."""
    from weft.operators import views as vw

    n = verts.count()
    if n < 3:
        raise ValueError("a face has three vertices at least")
    ahead = verts.select(F.pmod(F.col("place") - 1, F.lit(n)).alias("place"), F.col("id").alias("dst"))
    pairs = verts.select("place", F.col("id").alias("src")).join(ahead, "place").select("src", "dst")
    return vw.show_edges(vw.show_vertices(vw.make_edge_subset(vw.empty(graph)), verts.select("id").distinct()), pairs)


class FaceSearch:
    """A cursor over the faces of a rotated graph, in their order."""

    def __init__(self, rotated: Graph):
        self.graph, self.at = rotated, -1
        self.faces = materialise(faces(rotated))
        self.count = self.faces.count()

    def next(self) -> DataFrame | None:
        """(place, id) of the next face, or None after the last."""
        self.at = min(self.at + 1, self.count)
        return self.current()

    def current(self) -> DataFrame | None:
        if not 0 <= self.at < self.count:
            return None
        return self.faces.where(F.col("face_id") == self.at).select(F.posexplode("verts").alias("place", "id"))

    def subgraph(self) -> View:
        """The current face as a view."""
        face = self.current()
        if face is None:
            raise RuntimeError("no current face")
        return face_view(self.graph, face)


def boundary_cycle(view: View) -> DataFrame:
    """(place, id) along the face of a view on which its first dart lies; an error without a cycle of three.

    The view is of a rotated graph; darts without their twin, such as those of
    a face, are walked as edges.
    """
    own = materialise(view.darts())
    first = own.orderBy("src", "pos").first()
    if first is None:
        raise ValueError("no edge to walk along")
    twins = view.graph.darts.join(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), ["src", "dst"], "left_semi").select("src", "pos", "dst")
    w = Window.partitionBy("src").orderBy("pos")
    both = own.unionByName(twins).distinct().select("src", (F.row_number().over(w) - 1).alias("pos"), "dst")
    whole = Graph(view.vertices(), materialise(both), view.graph.directed)
    ahead = lambda i: F.get("verts", F.pmod(i + 1, F.size("verts")))
    along = F.exists(F.sequence(F.lit(0), F.size("verts") - 1), lambda i: (F.get("verts", i) == F.lit(first["src"])) & (ahead(i) == F.lit(first["dst"])))
    cycle = materialise(faces(whole, 1).where(along).orderBy("face_id").limit(1).select(F.posexplode("verts").alias("place", "id")))
    if cycle.count() < 3:
        raise ValueError("a boundary has three vertices at least")
    return cycle


def face_corners(face_rows: DataFrame, positions: DataFrame) -> DataFrame:
    """(face_id, place, id, x, y, x2, y2): the edges of each face's polygon."""
    corners = face_rows.select("face_id", F.posexplode("verts").alias("place", "id")).join(positions.select("id", "x", "y"), "id")
    return polygon_edges(corners)


def face_areas(face_rows: DataFrame, positions: DataFrame) -> DataFrame:
    """(face_id, area): signed, counter-clockwise positive."""
    return face_corners(face_rows, positions).groupBy("face_id").agg(signed_area(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("area"))


def faces_at(face_rows: DataFrame, positions: DataFrame, points: DataFrame) -> DataFrame:
    """(point, face_id): the least face around each point (point, px, py) of the drawing.

    A point outside the bounding box gets the face of largest area, the outer
    one; a point in the box but in no face gets null.  Points meet edges by a
    join on whether the edge's height spans the point, in bands of equal height.
    """
    corners = materialise(face_corners(face_rows, positions))
    area = corners.groupBy("face_id").agg(F.abs(signed_area(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).alias("area"))
    box = positions.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    if not box["n"]:
        return points.select("point", F.lit(None).cast("long").alias("face_id"))
    height = max((box["y1"] - box["y0"]) / max(1.0, float(box["n"]) ** 0.5), 1e-12)
    band = lambda y: F.floor((y - box["y0"]) / height)
    spans = corners.where("y <> y2").withColumn("band", F.explode(F.sequence(band(F.least("y", "y2")), band(F.greatest("y", "y2")))))
    inbox = F.col("px").between(box["x0"], box["x1"]) & F.col("py").between(box["y0"], box["y1"])
    near = points.where(inbox).withColumn("band", band(F.col("py"))).join(spans, "band")
    hit = near.where(crosses(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).groupBy("point", "face_id").agg(inside(F.lit(True)).alias("in")).where("in")
    best = hit.join(area, "face_id").groupBy("point").agg(F.min(F.struct("area", "face_id"))["face_id"].alias("f"))
    outer = area.agg(F.max(F.struct("area", (-F.col("face_id")).alias("k")))["k"].alias("k")).select((-F.col("k")).alias("outer"))
    out = points.join(best, "point", "left").join(F.broadcast(outer), F.lit(True), "left")  # one row
    return out.select("point", F.when(inbox, F.col("f")).otherwise(F.col("outer")).alias("face_id"))
