"""A drawn graph: positions of a view's vertices, a draw mask, a highlight, and growth.

An embedding holds tables and replaces them; it never changes one in place, so
a table that was taken from it before an edit is the state before the edit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.model import Graph, View
from weft.operators import views as vw
from weft.plans.session import Session
from weft.shared import materialise


class Embedding(Session):
    """Positions (id, pos) of a view's vertices, the origin to begin with.

    The draw mask has the visible vertices and a policy for edges.  Its
    revision rises with the policy, a reset, growth that shows something and
    ``notify_changed``; showing and hiding vertices alone doesn't raise it.
    """

    def __init__(self, g: Graph | View, positions: DataFrame | None = None, dim: int = 2):
        super().__init__()
        if dim < 1:
            raise ValueError("an embedding has a dimension at least")
        self.view, self.dim, self.planar = (g if isinstance(g, View) else View(g)), dim, False
        self.positions = self._placed(positions)
        self.highlight: View | None = None
        self.policy, self.mask_revision = "all", 0
        self.shown = self.view.vertices().select("id")

    # ---- positions ----

    def _placed(self, known: DataFrame | None) -> DataFrame:
        origin = F.array(*[F.lit(0.0)] * self.dim)
        ids = self.view.graph.vertices.select("id")
        if known is None:
            return ids.withColumn("pos", origin)
        own = known.select(F.col("id").alias("k"), F.col("pos").cast("array<double>").alias("at"))
        return materialise(ids.join(own, F.col("id") == F.col("k"), "left").select("id", F.coalesce("at", origin).alias("pos")))

    def count(self) -> int:
        return self.positions.count()

    def at(self, ids: DataFrame) -> DataFrame:
        """(id, pos) of the given ids."""
        return self.positions.join(ids.select("id"), "id", "left_semi")

    def set_positions(self, updates: DataFrame) -> None:
        """updates(id, pos) take the place of what their vertices have; unknown ids are ignored."""
        self._moved(updates, lambda old, new: new)

    def add_positions(self, moves: DataFrame) -> None:
        """moves(id, pos) are added to their vertices' positions."""
        self._moved(moves, lambda old, new: F.zip_with(old, new, lambda a, b: a + b))

    def _moved(self, rows: DataFrame, merge) -> None:
        new = rows.select(F.col("id").alias("k"), F.col("pos").cast("array<double>").alias("new"))
        if not new.where(F.size("new") != self.dim).isEmpty():
            raise ValueError(f"positions have {self.dim} dimensions")
        joined = self.positions.join(new, F.col("id") == F.col("k"), "left")
        self.positions = materialise(joined.select("id", F.when(F.col("new").isNull(), F.col("pos")).otherwise(merge(F.col("pos"), F.col("new"))).alias("pos")))

    # ---- draw mask ----

    def set_policy(self, policy: str) -> None:
        if policy not in vw.POLICIES:
            raise ValueError(f"policy is one of {', '.join(vw.POLICIES)}")
        self.policy = policy
        self.notify_changed()

    def show_vertices(self, ids: DataFrame) -> None:
        self.shown = materialise(self.shown.unionByName(ids.select("id")).distinct())

    def hide_vertices(self, ids: DataFrame) -> None:
        self.shown = materialise(self.shown.join(ids.select("id"), "id", "left_anti"))

    def clear_vertices(self) -> None:
        self.shown = self.shown.limit(0)

    def notify_changed(self) -> None:
        self.mask_revision += 1

    def reset_mask(self) -> None:
        """Every vertex of the view is visible, and every edge."""
        self.policy, self.shown = "all", self.view.vertices().select("id")
        self.notify_changed()

    def visible_vertices(self, ids: DataFrame) -> DataFrame:
        """(id, visible): in the view and shown."""
        seen = self.view.vertices().select("id").join(self.shown, "id", "left_semi").select(F.col("id").alias("k")).distinct()
        return ids.select("id").join(seen, F.col("id") == F.col("k"), "left").select("id", F.col("k").isNotNull().alias("visible"))

    def visible_pairs(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, visible) of any pairs: all, if the view has the edge; none, never; both_visible, if both ends
        are visible, whether or not there is such an edge."""
        if self.policy == "none":
            return pairs.select("src", "dst", F.lit(False).alias("visible"))
        if self.policy == "all":
            there = self.view.darts().select(F.col("src").alias("s"), F.col("dst").alias("d")).distinct()
            return pairs.join(there, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left").select("src", "dst", F.col("s").isNotNull().alias("visible"))
        ends = self.visible_vertices(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()).where("visible").select("id")
        a, b = ends.select(F.col("id").alias("s")), ends.select(F.col("id").alias("d"))
        joined = pairs.join(a, F.col("src") == F.col("s"), "left").join(b, F.col("dst") == F.col("d"), "left")
        return joined.select("src", "dst", (F.col("s").isNotNull() & F.col("d").isNotNull()).alias("visible"))

    def drawn_edges(self) -> DataFrame:
        """(src, dst) of the view's edges that are visible."""
        return vw.visible_edges(self.view, self.shown, self.policy).where("visible").select("src", "dst")

    # ---- highlight ----

    def set_highlight(self, view: View) -> None:
        self.highlight = view

    def clear_highlight(self) -> None:
        self.highlight = None

    def has_highlight(self) -> bool:
        return self.highlight is not None

    # ---- growth ----

    def add_vertices(self, vertices: DataFrame) -> None:
        """vertices(id, data): new ones, visible at the origin; the view keeps what it saw."""
        fresh = vertices.select("id", "data")
        if not fresh.join(self.view.graph.vertices.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("a vertex is there already")
        graph = vw.add_vertices(self.view.graph, materialise(fresh))
        self.view = vw.show_vertices(vw.rebuild(self.view, graph), fresh.select("id"))
        self.positions = self._placed(self.positions)
        self.show_vertices(fresh.select("id"))
        self.notify_changed()

    def add_edges(self, edges: DataFrame) -> None:
        """edges(o, src, dst) are appended; a view with listed edges shows the darts from src to dst, an induced one
        sees both anyway."""
        graph = vw.add_edges(self.view.graph, edges)
        graph = Graph(graph.vertices, materialise(graph.darts), graph.directed)
        old, self.view = self.view, View(graph, self.view.shown, self.view.shown_darts)
        if old.is_full():
            self.view = vw.show_edges(self.view, edges)
            self.notify_changed()

    # ---- planarity ----

    def apply_rotation(self) -> None:
        """Lists in the order of a planar embedding; an error if there is none."""
        from weft.operators.planar import apply_rotation

        if self.view.shown is not None or self.view.is_full():
            raise ValueError("a rotation is of a whole graph")
        self.view = View(apply_rotation(self.view.graph))
        self.planar = True
