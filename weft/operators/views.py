"""Subset views, set operations and edits of graphs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.model import Graph, View


# ---- vertex and edge subsets ----


def induced(graph: Graph, shown: DataFrame) -> View:
    """View of the given vertices and all darts between them."""
    return View(graph, shown.select("id").distinct())


def full(graph: Graph) -> View:
    """Everything shown, darts listed."""
    return View(graph, graph.vertices.select("id"), graph.darts.select("src", "pos"))


def empty(graph: Graph) -> View:
    return View(graph, graph.vertices.select("id").where(F.lit(False)), graph.darts.select("src", "pos").where(F.lit(False)))


def make_edge_subset(view: View) -> View:
    """The induced darts as a list; later changes of the subset leave it alone."""
    shown = view.vertices().select("id")
    return View(view.graph, shown, view.darts().select("src", "pos"))


def show_vertices(view: View, ids: DataFrame) -> View:
    """Adds vertices; listed darts stay as they are."""
    if view.shown is None:
        return view
    known = ids.select("id").join(view.graph.vertices, "id", "left_semi")
    return replace(view, shown=view.shown.union(known).distinct())


def hide_vertices(view: View, ids: DataFrame) -> View:
    """Removes vertices and, in a full view, both directions of their darts."""
    ids = ids.select("id")
    shown = view.vertices().select("id").join(ids, "id", "left_anti")
    listed = view.shown_darts
    if listed is not None:
        touching = view.graph.darts.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "pos")
        touching = touching.union(view.graph.darts.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "pos"))
        listed = listed.join(touching, ["src", "pos"], "left_anti")
    return View(view.graph, shown, listed)


def first_darts(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(src, pos) of the first dart of each pair (src, dst)."""
    return graph.darts.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("pos").alias("pos")).select("src", "pos")


def show_edges(view: View, pairs: DataFrame) -> View:
    """Shows one dart of each pair; nothing in an induced view."""
    if view.shown_darts is None:
        return view
    return replace(view, shown_darts=view.shown_darts.union(first_darts(view.graph, pairs)).distinct())


def hide_edges(view: View, pairs: DataFrame) -> View:
    if view.shown_darts is None:
        return view
    return replace(view, shown_darts=view.shown_darts.join(first_darts(view.graph, pairs), ["src", "pos"], "left_anti"))


def has_edge(view: View, pairs: DataFrame) -> DataFrame:
    """pairs with ``exists``: whether a dart src -> dst is seen between shown vertices."""
    seen = view.darts().select("src", "dst").distinct().withColumn("hit", F.lit(True))
    return pairs.select("src", "dst").join(seen, ["src", "dst"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("exists"))


def edge_exists(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs with code 1, 0, or -1 where an end is not a vertex."""
    ids = graph.vertices.select("id")
    known = has_edge(View(graph), pairs)
    known = known.join(ids.select(F.col("id").alias("src"), F.lit(1).alias("a")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    return known.select("src", "dst", F.when(F.col("a").isNull() | F.col("b").isNull(), -1).otherwise(F.col("exists").cast("int")).alias("code"))


def dart_from_bit(graph: Graph, bits: DataFrame) -> DataFrame:
    """(bit, src, pos, dst) of layout places."""
    return bits.select(F.col("bit").cast("long")).join(graph.bits(), "bit")


def subset_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def subset_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def subset_count(a: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Members with low <= id < high."""
    if low is not None:
        a = a.where(F.col("id") >= low)
    if high is not None:
        a = a.where(F.col("id") < high)
    return a.agg(F.count(F.lit(1)).alias("n"))


def subset_bitmap(a: DataFrame) -> DataFrame:
    """(bucket, bitmap, n): the subset as Spark bitmaps of 32,768 ids each."""
    return a.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap")).withColumn("n", F.bitmap_count("bitmap"))


# ---- edits ----


def add_vertices(graph: Graph, vertices: DataFrame, outgoing: DataFrame | None = None, incoming: DataFrame | None = None) -> Graph:
    """Adds vertices(id, data); outgoing(src, dst) and incoming(src, dst) become darts as given."""
    out = Graph(graph.vertices.unionByName(vertices.select("id", "data")), graph.darts, graph.directed)
    for pairs in (outgoing, incoming):
        if pairs is not None:
            out = _append(out, pairs.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("dst")).alias("o")))
    return out


def _append(graph: Graph, new: DataFrame) -> Graph:
    top = graph.darts.groupBy("src").agg(F.max("pos").alias("top"))
    w = Window.partitionBy("src").orderBy("o", "dst")
    placed = new.withColumn("k", F.row_number().over(w)).join(top, "src", "left").select("src", (F.coalesce("top", F.lit(-1)) + F.col("k")).cast("int").alias("pos"), "dst")
    return Graph(graph.vertices, graph.darts.unionByName(placed), graph.directed)


def add_edges(graph: Graph, edges: DataFrame) -> Graph:
    """Appends edges(o, src, dst) in order o; an edge with an unknown end is an error."""
    ids = graph.vertices.select(F.col("id").alias("k"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("k"))
    if not ends.join(ids, "k", "left_anti").isEmpty():
        raise ValueError("an edge has an end that is not a vertex")
    new = edges.select("src", "dst", (F.col("o") * 2).alias("o"))
    if not graph.directed:
        new = new.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("o") * 2 + 1).alias("o")))
    return _append(graph, new)


def remove_edges(graph: Graph, pairs: DataFrame) -> Graph:
    """Removes the first dart of each pair (both directions, if undirected); lists close up."""
    both = pairs.select("src", "dst")
    if not graph.directed:
        both = both.union(pairs.select("dst", "src"))
    left = graph.darts.join(first_darts(graph, both), ["src", "pos"], "left_anti")
    w = Window.partitionBy("src").orderBy("pos")
    return Graph(graph.vertices, left.select("src", (F.row_number().over(w) - 1).alias("pos"), "dst"), graph.directed)


def reverse(graph: Graph) -> Graph:
    """Transpose: lists by ascending old source; an undirected graph is itself."""
    if not graph.directed:
        return graph
    w = Window.partitionBy("src").orderBy("o", "p")
    turned = graph.darts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("src").alias("o"), F.col("pos").alias("p"))
    return Graph(graph.vertices, turned.select("src", (F.row_number().over(w) - 1).alias("pos"), "dst"), True)


def set_data(graph: Graph, rows: DataFrame) -> Graph:
    """Replaces the data of the vertices in rows(id, data)."""
    new = rows.select("id", F.col("data").alias("_new"), F.lit(True).alias("_hit"))
    v = graph.vertices.join(new, "id", "left").select("id", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("data")).alias("data"))
    return Graph(v, graph.darts, graph.directed)


def neighbours(graph: Graph, ids: DataFrame) -> DataFrame:
    return graph.darts.join(ids.select(F.col("id").alias("src")), "src", "left_semi")


def rebuild(view: View, graph: Graph) -> View:
    """The view over a changed graph: listed darts that still join the same ends at their place stay,
    vertices that are new stay hidden."""
    shown = view.vertices().select("id")
    listed = view.shown_darts
    if listed is not None:
        old = view.graph.darts.join(listed, ["src", "pos"], "left_semi")
        listed = graph.darts.join(old, ["src", "pos", "dst"], "left_semi").select("src", "pos")
    return View(graph, shown, listed)


# ---- draw mask ----

POLICIES = ("all", "none", "both_visible")


def visible_edges(view: View, shown: DataFrame | None = None, policy: str = "both_visible") -> DataFrame:
    """(src, dst, visible) of the view's edges under a draw policy.

    all: every edge of the view; none: no edge; both_visible: where both ends
    are in ``shown`` (all vertices, if not given).
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    edges = view.darts().select("src", "dst")
    if not view.graph.directed:
        edges = edges.where("src <= dst")
    if policy == "none" or (policy == "all") or shown is None:
        return edges.withColumn("visible", F.lit(policy != "none"))
    a = shown.select(F.col("id").alias("src"), F.lit(True).alias("a")).distinct()
    b = shown.select(F.col("id").alias("dst"), F.lit(True).alias("b")).distinct()
    return edges.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", (F.coalesce("a", F.lit(False)) & F.coalesce("b", F.lit(False))).alias("visible"))
