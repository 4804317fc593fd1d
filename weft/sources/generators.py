"""Synthetic graphs as column arithmetic over spark.range.

Each function returns a Graph; ``*_edges`` give (o, src, dst) with o the order
in which edges are added.  Everything but the random graph is closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import Graph


def _graph(spark: SparkSession, n: int, edges: DataFrame) -> Graph:
    return Graph.from_edges(edges, spark.range(n), False, ["o"])


def _moves(cells: DataFrame, base: Column, moves: list[tuple[Column, Column]]) -> DataFrame:
    """A row per move whose condition holds: moves are (condition, dst)."""
    options = F.array(*[F.struct(F.lit(k).alias("k"), ok.alias("ok"), dst.cast("long").alias("dst")) for k, (ok, dst) in enumerate(moves)])
    out = cells.select(base.cast("long").alias("src"), F.explode(options).alias("m")).where("m.ok")
    return out.select((F.col("src") * len(moves) + F.col("m.k")).alias("o"), "src", "m.dst")


def _grid(spark: SparkSession, rows: int, cols: int) -> tuple[DataFrame, Column, Column]:
    return spark.range(rows * cols), F.floor(F.col("id") / cols), F.pmod(F.col("id"), F.lit(cols))


def rect_edges(spark: SparkSession, length: int, width: int) -> DataFrame:
    cells, i, j = _grid(spark, length, width)
    return _moves(cells, F.col("id"), [(j + 1 < width, F.col("id") + 1), (i + 1 < length, F.col("id") + width)])


def rect_mesh(spark: SparkSession, length: int, width: int) -> Graph:
    return _graph(spark, length * width, rect_edges(spark, length, width))


def knotted_edges(spark: SparkSession, length: int, width: int) -> DataFrame:
    """Grid with its corners tied; the edge (0, n-1) is there twice."""
    n, w = length * width, width
    ties = [(0, n - 1), (0, w - 1), (n - 1, w - 1), (0, n - 1), (w - 1, n - w), (n - 1, n - w), (0, n - w)]
    extra = spark.createDataFrame([(2 * n + k, a, b) for k, (a, b) in enumerate(ties)], "o long, src long, dst long")
    return rect_edges(spark, length, width).unionByName(extra)


def knotted_mesh(spark: SparkSession, length: int, width: int) -> Graph:
    return _graph(spark, length * width, knotted_edges(spark, length, width))


def mobius_edges(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Grid whose last row joins the first with the columns flipped."""
    cells, i, j = _grid(spark, rows, cols)
    down = F.when(i + 1 < rows, F.col("id") + cols).otherwise(F.lit(cols - 1) - j)
    return _moves(cells, F.col("id"), [(j + 1 < cols, F.col("id") + 1), (F.lit(True), down)])


def mobius_strip(spark: SparkSession, rows: int, cols: int) -> Graph:
    return _graph(spark, rows * cols, mobius_edges(spark, rows, cols))


def klein_edges(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Both directions wrap, rows with a flip."""
    cells, i, j = _grid(spark, rows, cols)
    right = F.when(j + 1 < cols, F.col("id") + 1).otherwise(F.col("id") - j)
    down = F.when(i + 1 < rows, F.col("id") + cols).otherwise(F.lit(cols - 1) - j)
    return _moves(cells, F.col("id"), [(F.lit(True), right), (F.lit(True), down)])


def klein_bottle(spark: SparkSession, rows: int, cols: int) -> Graph:
    return _graph(spark, rows * cols, klein_edges(spark, rows, cols))


def tri_edges(spark: SparkSession, depth: int) -> DataFrame:
    """Rows 0..depth of a triangle; (i, j) is i(i+1)/2 + j."""
    cells = spark.range(depth + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("j"))
    i, j = F.col("i"), F.col("j")
    at = lambda a, b: (a * (a + 1) / 2).cast("long") + b
    return _moves(cells, at(i, j), [(j + 1 <= i, at(i, j + 1)), (i + 1 <= depth, at(i + 1, j)), (i + 1 <= depth, at(i + 1, j + 1))])


def tri_mesh(spark: SparkSession, depth: int) -> Graph:
    return _graph(spark, (depth + 1) * (depth + 2) // 2, tri_edges(spark, depth))


def tetra_size(depth: int) -> int:
    return (depth + 1) * (depth + 2) * (depth + 3) // 6


def bary_rank(depth: int, a: Column, b: Column, c: Column) -> Column:
    """Place of (a, b, c, depth-a-b-c) in the order of a, then b, then c."""
    whole = lambda n: n * (n + 1) * (n + 2) / 6  # noqa: E731  tuples of three with sum below n
    s, t = F.lit(depth) - a, F.lit(depth) - a - b
    before_a = F.lit(float(tetra_size(depth))) - whole(s + 1)
    before_b = (s + 1) * (s + 2) / 2 - (t + 1) * (t + 2) / 2
    return (F.round(before_a + before_b) + c).cast("long")


def bary_unrank(spark: SparkSession, depth: int) -> DataFrame:
    """(id, a, b, c, d) of all barycentric tuples with sum depth."""
    a = spark.range(depth + 1).select(F.col("id").alias("a"))
    ab = a.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth) - F.col("a"))).alias("b"))
    abc = ab.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth) - F.col("a") - F.col("b"))).alias("c"))
    return abc.select(bary_rank(depth, F.col("a"), F.col("b"), F.col("c")).alias("id"), "a", "b", "c", (F.lit(depth) - F.col("a") - F.col("b") - F.col("c")).alias("d"))


def tetra_edges(spark: SparkSession, depth: int) -> DataFrame:
    """Each vertex with its moves of one unit from a later to an earlier coordinate."""
    cells = bary_unrank(spark, depth)
    names = "abcd"
    moves = []
    for up in range(3):
        for down in range(up + 1, 4):
            to = [F.col(x) + (1 if k == up else -1 if k == down else 0) for k, x in enumerate(names)]
            moves.append((F.col(names[down]) > 0, bary_rank(depth, *to[:3])))
    return _moves(cells, F.col("id"), moves)


def tetra_mesh(spark: SparkSession, depth: int) -> Graph:
    return _graph(spark, tetra_size(depth), tetra_edges(spark, depth))


def carpet_cells(spark: SparkSession, depth: int) -> DataFrame:
    """(i, j) of the kept cells: no ternary digit place has (1, 1)."""
    dim = 3**depth
    cells, i, j = _grid(spark, dim, dim)
    hole = F.lit(False)
    for k in range(depth):
        hole |= (F.pmod(F.floor(i / 3**k), F.lit(3)) == 1) & (F.pmod(F.floor(j / 3**k), F.lit(3)) == 1)
    return cells.where(~hole).select(i.alias("i"), j.alias("j"), F.col("id").alias("cell"))


def carpet_vertices(spark: SparkSession, depth: int) -> DataFrame:
    """(id, i, j): kept cells numbered in row-major order."""
    from weft.model import running_sum

    cells = carpet_cells(spark, depth).withColumn("one", F.lit(1).cast("long"))
    return running_sum(cells, "cell", "one", "id").select("id", "i", "j")


def carpet_edges(spark: SparkSession, depth: int) -> DataFrame:
    v = carpet_vertices(spark, depth)
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("di"), F.lit(b).alias("dj")) for k, (a, b) in enumerate([(0, 1), (1, 0), (1, 1), (1, -1)])])
    wanted = v.select(F.col("id").alias("src"), "i", "j", F.explode(steps).alias("s")).select("src", "s.k", (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"))
    return wanted.join(v.select(F.col("id").alias("dst"), "i", "j"), ["i", "j"]).select((F.col("src") * 4 + F.col("k")).alias("o"), "src", "dst")


def carpet(spark: SparkSession, depth: int) -> Graph:
    return Graph.from_edges(carpet_edges(spark, depth), carpet_vertices(spark, depth).select("id"), False, ["o"])


def _subdivide(spark: SparkSession, depth: int, corners: int) -> DataFrame:
    """Leaves (leaf, v array) of the recursive division of a simplex with 3 or 4 corners.

    Each level names the midpoints of all corner pairs in the order of
    recursion; a subtree of known size has a known range of names.
    """
    pairs = [(a, b) for a in range(corners) for b in range(a + 1, corners)]
    mids = len(pairs)
    inner = lambda d: mids * (corners**d - 1) // (corners - 1)  # noqa: E731  names below a node of depth d
    cells = spark.range(1).select(F.lit(0).cast("long").alias("leaf"), F.lit(corners).cast("long").alias("next"), F.array(*[F.lit(k).cast("long") for k in range(corners)]).alias("v"))
    for level in range(depth, 0, -1):
        children = []
        for c in range(corners):
            v = []
            for k in range(corners):
                if k == c:
                    v.append(F.get("v", F.lit(c)))
                else:
                    v.append(F.col("next") + pairs.index((min(c, k), max(c, k))))
            children.append(F.struct((F.col("leaf") * corners + c).alias("leaf"), (F.col("next") + mids + c * inner(level - 1)).alias("next"), F.array(*v).alias("v")))
        cells = cells.select(F.explode(F.array(*children)).alias("c")).select("c.leaf", "c.next", "c.v")
    return cells.select("leaf", "v")


def _leaf_edges(leaves: DataFrame, ends: list[tuple[int, int]]) -> DataFrame:
    e = F.array(*[F.struct((F.col("leaf") * len(ends) + k).alias("o"), F.get("v", F.lit(a)).alias("src"), F.get("v", F.lit(b)).alias("dst")) for k, (a, b) in enumerate(ends)])
    return leaves.select(F.explode(e).alias("e")).select("e.o", "e.src", "e.dst")


def sierpinski_edges(spark: SparkSession, depth: int) -> DataFrame:
    return _leaf_edges(_subdivide(spark, depth, 3), [(0, 1), (1, 2), (2, 0)])


def sierpinski(spark: SparkSession, depth: int) -> Graph:
    return _graph(spark, (3 ** (depth + 1) + 3) // 2, sierpinski_edges(spark, depth))


def sierpinski_tetrahedron_edges(spark: SparkSession, depth: int) -> DataFrame:
    return _leaf_edges(_subdivide(spark, depth, 4), [(a, b) for a in range(4) for b in range(a + 1, 4)])


def sierpinski_tetrahedron(spark: SparkSession, depth: int) -> Graph:
    n = 4
    for _ in range(depth):
        n = 4 * n - 6
    return _graph(spark, n, sierpinski_tetrahedron_edges(spark, depth))


def random_connected_edges(spark: SparkSession, n: int, density: float, seed: int) -> DataFrame:
    """A random parent for each vertex but the first, and round(density * rest) further edges.

    Extra pairs are drawn with replacement in excess and kept by hash order, so
    the count is exact wherever enough distinct pairs were drawn.
    """
    density = min(1.0, max(0.0, density))
    u = lambda *salt: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), *map(F.lit, salt)), F.lit(1 << 40)) / float(1 << 40)
    tree = spark.range(1, max(n, 1)).select(F.col("id").alias("o"), F.floor(u(1) * F.col("id")).alias("src"), F.col("id").alias("dst"))
    extra = round(density * max(0, n * (n - 1) // 2 - (n - 1))) if n > 1 else 0
    if not extra:
        return tree
    drawn = spark.range(20 * extra + 100).select(F.floor(u(2) * n).alias("a"), F.floor(u(3) * n).alias("b")).where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    fresh = drawn.join(tree.select("src", "dst"), ["src", "dst"], "left_anti")
    kept = fresh.orderBy(F.xxhash64("src", "dst", F.lit(seed))).limit(extra)
    return tree.unionByName(kept.select((F.lit(n) + F.xxhash64("src", "dst").bitwiseAND(F.lit((1 << 40) - 1))).alias("o"), "src", "dst"))


def random_connected(spark: SparkSession, n: int, density: float, seed: int = 1) -> Graph:
    return _graph(spark, n, random_connected_edges(spark, n, density, seed))
