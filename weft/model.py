"""Graphs and views as DataFrames.

A graph is two tables.  ``vertices(id, data)`` has a row per vertex.
``darts(src, pos, dst)`` has a row per adjacency entry: an undirected edge is
two darts, and an undirected loop two darts of one list.  ``pos`` is the place in the vertex's list from 0, and
order matters to every traversal.  Edges carry no weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.shared import materialise

VERTICES = "id long, data string"
DARTS = "src long, pos int, dst long"


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    darts: DataFrame
    directed: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False, order: list[str] | None = None) -> Graph:
        """Graph of edges(src, dst, ...), added in ``order`` (src, dst if not given).

        One shuffle by source gives each list its positions; the order by ends is
        told from them after it, so its rows are an entry's ends and side.
        """
        kinds = dict(edges.dtypes)
        if order is None and not directed and all(kinds[c] in ("int", "bigint") for c in ("src", "dst")):
            both = Graph._both_ways(edges)
            first, second = F.when(F.col("side") == 0, F.col("src")).otherwise(F.col("dst")), F.when(F.col("side") == 0, F.col("dst")).otherwise(F.col("src"))
            w = Window.partitionBy("src").orderBy(first, second, "side", "dst")
            return Graph._of_lists(both.repartition("src"), w, both.select(F.col("src").alias("id")).distinct() if vertices is None else vertices, directed)
        order = order or ["src", "dst"]
        keys = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
        there = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), *keys, F.lit(0).alias("side"))
        both = there if directed else there.unionByName(edges.select(F.col("dst").cast("long").alias("src"), F.col("src").cast("long").alias("dst"), *keys, F.lit(1).alias("side")))
        w = Window.partitionBy("src").orderBy(*[f"o{i}" for i in range(len(order))], "side", "dst")
        if vertices is None:
            vertices = both.select(F.col("src").alias("id")).union(both.select("dst")).distinct()
        return Graph._of_lists(both, w, vertices, directed)

    @staticmethod
    def _both_ways(edges: DataFrame) -> DataFrame:
        """(src, dst, side): each edge from either end."""
        there = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(0).cast("byte").alias("side"))
        return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("byte").alias("side")))

    @staticmethod
    def _of_lists(entries: DataFrame, w, vertices: DataFrame, directed: bool) -> Graph:
        darts = entries.select("src", (F.row_number().over(w) - 1).alias("pos"), "dst")
        if "data" not in vertices.columns:
            vertices = vertices.withColumn("data", F.lit(None).cast("string"))
        return Graph(vertices.select(F.col("id").cast("long"), "data"), darts, directed)

    @staticmethod
    def of(spark: SparkSession, n: int, pairs: list[tuple[int, int]], directed: bool = False) -> Graph:
        """Graph of n vertices 0..n-1 with the listed edges, in list order."""
        edges = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(pairs)], "o long, src long, dst long")
        return Graph.from_edges(edges, spark.range(n), directed, ["o"])

    # ---- counts and layout ----

    def size(self) -> DataFrame:
        return self.vertices.agg(F.count(F.lit(1)).alias("n"))

    def edge_count(self) -> DataFrame:
        per = 1 if self.directed else 2
        return self.darts.agg((F.count(F.lit(1)) / per).cast("long").alias("n_edges"))

    def degrees(self) -> DataFrame:
        """(id, degree) of every vertex: darts in its list."""
        d = self.darts.groupBy(F.col("src").alias("k")).agg(F.count(F.lit(1)).alias("d"))
        return self.vertices.join(d, F.col("id") == F.col("k"), "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))

    def layout(self) -> DataFrame:
        """(id, degree, offset): exclusive running sum of degrees by id.

        Ids are cut into ranges; each range sums on its own and the ranges'
        totals are summed in one small task, so no task sees all vertices.
        """
        return running_sum(self.degrees(), "id", "degree", "offset")

    def edges(self) -> DataFrame:
        """(src, dst): a row per edge."""
        if self.directed:
            return self.darts.select("src", "dst")
        proper = self.darts.where("src < dst").select("src", "dst")
        w = Window.partitionBy("src").orderBy("pos")
        loops = self.darts.where("src = dst").select("src", "dst", F.row_number().over(w).alias("k")).where("k % 2 = 0")
        return proper.unionByName(loops.select("src", "dst"))

    def bits(self) -> DataFrame:
        """Darts with ``bit``: their place in the layout."""
        return self.darts.join(self.layout().select(F.col("id").alias("k"), "offset"), F.col("src") == F.col("k")).select("src", "pos", "dst", (F.col("offset") + F.col("pos")).alias("bit"))

    def view(self) -> View:
        return View(self)


def running_sum(df: DataFrame, key: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """df with the sum of ``value`` over all rows with a smaller key (distinct keys).

    The rows are written once with the range that each fell into: a range exchange samples its bounds
    anew each time it is planned, and totals by other bounds than the rows' own would be wrong.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranged.join(F.broadcast(before), F.col("_part") == F.col("_p"))  # a row per partition
    return joined.withColumn(out, (inner + F.col("_before")).cast("long")).drop("_part", "_p", "_before")


@dataclass(frozen=True)
class View:
    """A graph with a vertex subset and, if full, an edge subset.

    shown: (id) or None for all vertices.  shown_darts: (src, pos) or None, in
    which case every dart between shown vertices is seen (induced view).
    """

    graph: Graph
    shown: DataFrame | None = None
    shown_darts: DataFrame | None = None

    def vertices(self) -> DataFrame:
        v = self.graph.vertices
        return v if self.shown is None else v.join(self.shown, "id", "left_semi")

    def darts(self) -> DataFrame:
        d = self.graph.darts
        if self.shown_darts is not None:
            d = d.join(self.shown_darts, ["src", "pos"], "left_semi")
        if self.shown is not None:
            d = d.join(self.shown.withColumnRenamed("id", "src"), "src", "left_semi")
            d = d.join(self.shown.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return d.select("src", "pos", "dst")

    def as_graph(self) -> Graph:
        """The seen part as a graph; positions are renumbered, order kept."""
        w = Window.partitionBy("src").orderBy("pos")
        return Graph(self.vertices(), self.darts().select("src", (F.row_number().over(w) - 1).alias("pos"), "dst"), self.graph.directed)

    def is_full(self) -> bool:
        return self.shown_darts is not None

    def edge_count(self) -> DataFrame:
        """Darts seen (a triangle has six)."""
        return self.darts().agg(F.count(F.lit(1)).alias("n_darts"))

    def degrees(self) -> DataFrame:
        return Graph(self.vertices(), self.darts(), self.graph.directed).degrees()
