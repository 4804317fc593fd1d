"""Registered graph queries and their DuckDB SQL.

SP: suppliers and parts of lineitem (parts shifted by 1,000,000).
HIER: region, nation and customer as a tree (0; 1+r; 100+n; 1000+c).
PTS: the first two embedding elements as points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import Graph, View
from weft.operators import traverse as tr
from weft.operators import views as vw
from weft.shared import fresh_path, materialise
from weft.sources import files
from weft.sources import generators as gen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- graphs on the tables ----

SP_SQL = """
sp AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 1000000 AS p FROM lineitem),
both_ends AS (SELECT s AS src, p AS dst, s AS o1, p AS o2, 0 AS side FROM sp UNION ALL SELECT p, s, s, p, 1 FROM sp),
darts AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY o1, o2, side, dst) - 1 AS INTEGER) AS pos, dst FROM both_ends),
ids AS (SELECT DISTINCT src AS id FROM darts)
"""


def supplier_parts(spark: SparkSession, sf_dir: str) -> Graph:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).distinct()
    return Graph.from_edges(pairs)


HIER_SQL = """
edges AS (
  SELECT CAST(0 AS BIGINT) AS src, CAST(1 + r_regionkey AS BIGINT) AS dst FROM region
  UNION ALL SELECT 1 + n_regionkey, 100 + n_nationkey FROM nation
  UNION ALL SELECT 100 + c_nationkey, 1000 + c_custkey FROM customer),
ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
"""


def hierarchy(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda n: table(spark, sf_dir, n)
    edges = t("region").select(F.lit(0).cast("long").alias("src"), (1 + F.col("r_regionkey")).cast("long").alias("dst"))
    edges = edges.unionByName(t("nation").select((1 + F.col("n_regionkey")).cast("long").alias("src"), (100 + F.col("n_nationkey")).cast("long").alias("dst")))
    edges = edges.unionByName(t("customer").select((100 + F.col("c_nationkey")).cast("long").alias("src"), (1000 + F.col("c_custkey")).cast("long").alias("dst")))
    return Graph.from_edges(edges, directed=True)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, label) of the embeddings' first two elements."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), "label")


# ---- layout, degree, views ----


@query("layout_offsets", f"WITH {SP_SQL}, d AS (SELECT src AS id, count(*) AS degree FROM darts GROUP BY 1) SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d")
def _layout(spark, sf_dir):
    return supplier_parts(spark, sf_dir).layout()


@query("degree", f"WITH {SP_SQL} SELECT src AS id, count(*) AS degree FROM darts GROUP BY 1")
def _degree(spark, sf_dir):
    return supplier_parts(spark, sf_dir).degrees()


@query("graph_counts", f"WITH {SP_SQL} SELECT (SELECT count(*) FROM ids) AS n, (SELECT CAST(count(*) / 2 AS BIGINT) FROM darts) AS n_edges")
def _counts(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    return g.size().crossJoin(g.edge_count())  # one row each


@query("adjacency", f"WITH {SP_SQL} SELECT src, pos, dst FROM darts")
def _adjacency(spark, sf_dir):
    return supplier_parts(spark, sf_dir).darts


@query("edge_list", "SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem")
def _edge_list(spark, sf_dir):
    return supplier_parts(spark, sf_dir).edges()


EVEN_SQL = "even AS (SELECT id FROM ids WHERE id % 2 = 0)"


def _even(g: Graph) -> DataFrame:
    return g.vertices.where("id % 2 = 0").select("id")


@query("induced_edges", f"WITH {SP_SQL}, {EVEN_SQL} SELECT src, pos, dst FROM darts WHERE src IN (SELECT id FROM even) AND dst IN (SELECT id FROM even)")
def _induced(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    return vw.induced(g, _even(g)).darts()


@query("induced_degree", f"WITH {SP_SQL}, {EVEN_SQL}, d AS (SELECT src, count(*) AS n FROM darts WHERE src % 2 = 0 AND dst % 2 = 0 GROUP BY 1) SELECT id, coalesce(n, 0) AS degree FROM even LEFT JOIN d ON id = src")
def _induced_degree(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    return vw.induced(g, _even(g)).degrees()


@query("hide_vertex", f"WITH {SP_SQL} SELECT src, pos, dst FROM darts WHERE src % 7 <> 0 AND dst % 7 <> 0")
def _hide(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    return vw.hide_vertices(vw.full(g), g.vertices.where("id % 7 = 0")).darts()


@query("show_after_hide", f"WITH {SP_SQL} SELECT count(*) AS n_darts FROM darts WHERE src % 7 <> 0 AND dst % 7 <> 0")
def _show(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    hidden = vw.hide_vertices(vw.full(g), g.vertices.where("id % 7 = 0"))
    return vw.show_vertices(hidden, g.vertices.where("id % 7 = 0")).edge_count()  # showing brings no dart back


@query("hide_edge", f"WITH {SP_SQL} SELECT src, pos, dst FROM darts WHERE NOT (src < 1000000 AND (src + dst) % 5 = 0)")
def _hide_edge(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    return vw.hide_edges(vw.full(g), g.darts.where("src < 1000000 and (src + dst) % 5 = 0")).darts()


@query("show_edge", f"WITH {SP_SQL} SELECT src, pos, dst FROM darts WHERE src < 1000000 AND (src + dst) % 5 = 0")
def _show_edge(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    everyone = View(g, g.vertices.select("id"), vw.empty(g).shown_darts)
    return vw.show_edges(everyone, g.darts.where("src < 1000000 and (src + dst) % 5 = 0")).darts()


@query("edge_exists", f"WITH {SP_SQL}, q AS (SELECT s_suppkey AS src, 1000000 + (s_suppkey * 13) % 2500 AS dst FROM supplier) SELECT q.src, q.dst, CAST(CASE WHEN a.id IS NULL OR b.id IS NULL THEN -1 WHEN sp.s IS NULL THEN 0 ELSE 1 END AS INTEGER) AS code FROM q LEFT JOIN ids a ON a.id = q.src LEFT JOIN ids b ON b.id = q.dst LEFT JOIN sp ON sp.s = q.src AND sp.p = q.dst")
def _edge_exists(spark, sf_dir):
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (1000000 + F.col("s_suppkey") * 13 % 2500).alias("dst"))
    return vw.edge_exists(supplier_parts(spark, sf_dir), pairs)


@query("subset_union", f"WITH {SP_SQL} SELECT id FROM ids WHERE id % 2 = 0 UNION SELECT id FROM ids WHERE id % 3 = 0")
def _union(spark, sf_dir):
    v = supplier_parts(spark, sf_dir).vertices.select("id")
    return vw.subset_union(v.where("id % 2 = 0"), v.where("id % 3 = 0"))


@query("subset_intersect", f"WITH {SP_SQL} SELECT id FROM ids WHERE id % 2 = 0 INTERSECT SELECT id FROM ids WHERE id % 3 = 0")
def _intersect(spark, sf_dir):
    v = supplier_parts(spark, sf_dir).vertices.select("id")
    return vw.subset_intersect(v.where("id % 2 = 0"), v.where("id % 3 = 0"))


@query("subset_difference", f"WITH {SP_SQL} SELECT id FROM ids WHERE id % 2 = 0 EXCEPT SELECT id FROM ids WHERE id % 3 = 0")
def _difference(spark, sf_dir):
    v = supplier_parts(spark, sf_dir).vertices.select("id")
    return vw.subset_difference(v.where("id % 2 = 0"), v.where("id % 3 = 0"))


@query("subset_popcount", f"WITH {SP_SQL} SELECT CAST(floor(id / 32768) AS BIGINT) + 1 AS bucket, count(*) AS n FROM ids WHERE id % 3 = 1 GROUP BY 1")
def _popcount(spark, sf_dir):
    v = supplier_parts(spark, sf_dir).vertices.where("id % 3 = 1")
    return vw.subset_bitmap(v.select((F.col("id") + 1).alias("id"))).select("bucket", "n")  # Spark numbers bitmap positions from 1


@query("subset_range_count", f"WITH {SP_SQL} SELECT count(*) AS n FROM ids WHERE id % 3 = 1 AND id >= 10 AND id < 1000900")
def _range_count(spark, sf_dir):
    return vw.subset_count(supplier_parts(spark, sf_dir).vertices.where("id % 3 = 1").select("id"), 10, 1000900)


@query("dart_from_bit", f"WITH {SP_SQL}, b AS (SELECT row_number() OVER (ORDER BY src, pos) - 1 AS bit, src, pos, dst FROM darts) SELECT bit, src, pos, dst FROM b")
def _bit(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    g = Graph(g.vertices, materialise(g.darts))
    return vw.dart_from_bit(g, spark.range(g.darts.count()).select(F.col("id").alias("bit")))


@query("reverse_graph", f"WITH {HIER_SQL} SELECT dst AS src, CAST(row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS INTEGER) AS pos, src AS dst FROM edges")
def _reverse(spark, sf_dir):
    return vw.reverse(hierarchy(spark, sf_dir)).darts


@query("remove_edge", f"WITH {SP_SQL} SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY pos) - 1 AS INTEGER) AS pos, dst FROM darts WHERE (src + dst) % 11 <> 0")
def _remove(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    return vw.remove_edges(g, g.edges().where("(src + dst) % 11 = 0")).darts


@query("add_edges", f"WITH {SP_SQL}, more AS (SELECT s_suppkey AS src, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS dst FROM supplier WHERE s_suppkey IN (SELECT id FROM ids)), ok AS (SELECT * FROM more WHERE dst IN (SELECT id FROM ids)), new AS (SELECT src, dst, src * 2 AS o FROM ok UNION ALL SELECT dst, src, src * 2 + 1 FROM ok), top AS (SELECT src, count(*) AS n FROM darts GROUP BY 1) SELECT src, pos, dst FROM darts UNION ALL SELECT new.src, CAST(n + row_number() OVER (PARTITION BY new.src ORDER BY o, dst) - 1 AS INTEGER), dst FROM new JOIN top ON top.src = new.src")
def _add(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    more = s.select(F.col("s_suppkey").alias("o"), F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") + 1) % n).alias("dst"))
    ids = g.vertices.select("id")
    more = more.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return vw.add_edges(g, more).darts


@query("visible_edges", f"WITH {SP_SQL} SELECT s AS src, p AS dst, s % 3 <> 0 AND p % 3 <> 0 AS visible FROM sp")
def _visible(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    return vw.visible_edges(View(g), g.vertices.where("id % 3 <> 0"))


@query("rebuild_view", f"WITH {SP_SQL}, kept AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY pos) - 1 AS INTEGER) AS pos, dst FROM darts WHERE (src + dst) % 11 <> 0) SELECT k.src, k.pos, k.dst FROM kept k JOIN darts d ON d.src = k.src AND d.pos = k.pos AND d.dst = k.dst WHERE k.src % 2 = 0 AND k.dst % 2 = 0")
def _rebuild(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    g = Graph(g.vertices, materialise(g.darts))
    view = vw.make_edge_subset(vw.induced(g, _even(g)))
    return vw.rebuild(view, vw.remove_edges(g, g.edges().where("(src + dst) % 11 = 0"))).darts()


# ---- generators ----

GRID_SQL = "c AS (SELECT id, id // {w} AS i, id % {w} AS j FROM (SELECT unnest(range({n})) AS id))"
RECT_SQL = f"WITH {GRID_SQL.format(w=50, n=2000)} SELECT id AS src, id + 1 AS dst FROM c WHERE j + 1 < 50 UNION ALL SELECT id, id + 50 FROM c WHERE i + 1 < 40"


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst")


@query("gen_rect", RECT_SQL)
def _gen_rect(spark, sf_dir):
    return _ends(gen.rect_edges(spark, 40, 50))


@query("gen_knotted", RECT_SQL + " UNION ALL SELECT * FROM (VALUES (0, 1999), (0, 49), (1999, 49), (0, 1999), (49, 1950), (1999, 1950), (0, 1950))")
def _gen_knotted(spark, sf_dir):
    return _ends(gen.knotted_edges(spark, 40, 50))


@query("gen_mobius", f"WITH {GRID_SQL.format(w=50, n=2000)} SELECT id AS src, id + 1 AS dst FROM c WHERE j + 1 < 50 UNION ALL SELECT id, CASE WHEN i + 1 < 40 THEN id + 50 ELSE 49 - j END FROM c")
def _gen_mobius(spark, sf_dir):
    return _ends(gen.mobius_edges(spark, 40, 50))


@query("gen_klein", f"WITH {GRID_SQL.format(w=50, n=2000)} SELECT id AS src, CASE WHEN j + 1 < 50 THEN id + 1 ELSE id - j END AS dst FROM c UNION ALL SELECT id, CASE WHEN i + 1 < 40 THEN id + 50 ELSE 49 - j END FROM c")
def _gen_klein(spark, sf_dir):
    return _ends(gen.klein_edges(spark, 40, 50))


@query("gen_tri", "WITH c AS (SELECT i, unnest(range(i + 1)) AS j FROM (SELECT unnest(range(61)) AS i)), d AS (SELECT *, i * (i + 1) // 2 + j AS id, (i + 1) * (i + 2) // 2 + j AS below FROM c) SELECT id AS src, id + 1 AS dst FROM d WHERE j < i UNION ALL SELECT id, below FROM d WHERE i < 60 UNION ALL SELECT id, below + 1 FROM d WHERE i < 60")
def _gen_tri(spark, sf_dir):
    return _ends(gen.tri_edges(spark, 60))


@query("gen_tetra", "WITH r AS (SELECT unnest(range(16)) AS k), v AS (SELECT row_number() OVER (ORDER BY x.k, y.k, z.k) - 1 AS id, x.k AS a, y.k AS b, z.k AS c, 15 - x.k - y.k - z.k AS d FROM r x, r y, r z WHERE x.k + y.k + z.k <= 15) SELECT p.id AS src, q.id AS dst FROM v p JOIN v q ON (q.a = p.a + 1 AND q.b = p.b - 1 AND q.c = p.c) OR (q.a = p.a + 1 AND q.b = p.b AND q.c = p.c - 1) OR (q.a = p.a + 1 AND q.b = p.b AND q.c = p.c AND q.d = p.d - 1) OR (q.a = p.a AND q.b = p.b + 1 AND q.c = p.c - 1) OR (q.a = p.a AND q.b = p.b + 1 AND q.c = p.c AND q.d = p.d - 1) OR (q.a = p.a AND q.b = p.b AND q.c = p.c + 1 AND q.d = p.d - 1)")
def _gen_tetra(spark, sf_dir):
    return _ends(gen.tetra_edges(spark, 15))


@query("bary_unrank", "WITH r AS (SELECT unnest(range(16)) AS k) SELECT row_number() OVER (ORDER BY x.k, y.k, z.k) - 1 AS id, x.k AS a, y.k AS b, z.k AS c, 15 - x.k - y.k - z.k AS d FROM r x, r y, r z WHERE x.k + y.k + z.k <= 15")
def _bary(spark, sf_dir):
    return gen.bary_unrank(spark, 15)


@query("gen_carpet", f"WITH {GRID_SQL.format(w=27, n=729)}, k AS (SELECT row_number() OVER (ORDER BY id) - 1 AS v, i, j FROM c WHERE NOT (i % 3 = 1 AND j % 3 = 1) AND NOT ((i // 3) % 3 = 1 AND (j // 3) % 3 = 1) AND NOT (i // 9 = 1 AND j // 9 = 1)) SELECT a.v AS src, b.v AS dst FROM k a JOIN k b ON (b.i = a.i AND b.j = a.j + 1) OR (b.i = a.i + 1 AND abs(b.j - a.j) <= 1)")
def _gen_carpet(spark, sf_dir):
    return _ends(gen.carpet_edges(spark, 3))


SIERPINSKI_SQL = """
WITH RECURSIVE r AS (
  SELECT 0 AS level, CAST(3 AS BIGINT) AS nxt, CAST(0 AS BIGINT) AS t, CAST(1 AS BIGINT) AS l, CAST(2 AS BIGINT) AS r
  UNION ALL
  SELECT level + 1, nxt + 3 + k * (3 * (3 ** (5 - level) - 1) // 2)::BIGINT,
    CASE k WHEN 0 THEN t WHEN 1 THEN nxt ELSE nxt + 1 END, CASE k WHEN 0 THEN nxt WHEN 1 THEN l ELSE nxt + 2 END, CASE k WHEN 0 THEN nxt + 1 WHEN 1 THEN nxt + 2 ELSE r END
  FROM r, (VALUES (0), (1), (2)) AS kids(k) WHERE level < 6)
SELECT t AS src, l AS dst FROM r WHERE level = 6 UNION ALL SELECT l, r FROM r WHERE level = 6 UNION ALL SELECT r, t FROM r WHERE level = 6
"""


@query("gen_sierpinski", SIERPINSKI_SQL)
def _gen_sierpinski(spark, sf_dir):
    return _ends(gen.sierpinski_edges(spark, 6))


@query("gen_sierpinski_tetrahedron")
def _gen_tetrahedron(spark, sf_dir):
    return _ends(gen.sierpinski_tetrahedron_edges(spark, 5))


@query("gen_random_connected")
def _gen_random(spark, sf_dir):
    return _ends(gen.random_connected_edges(spark, 500, 0.01, 7))


# ---- files ----

COMPACT_SQL = """
WITH rows AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS o, l_orderkey AS a, 1000000000 + l_partkey AS b FROM lineitem),
firsts AS (SELECT name, min(place) AS place FROM (SELECT 2 * o AS place, a AS name FROM rows UNION ALL SELECT 2 * o + 1, b FROM rows) GROUP BY name),
ids AS (SELECT name, row_number() OVER (ORDER BY place) - 1 AS id FROM firsts)
SELECT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst, count(*) AS n FROM rows JOIN ids x ON x.name = a JOIN ids y ON y.name = b GROUP BY 1, 2
"""


@query("edges_compacted", COMPACT_SQL)
def _compacted(spark, sf_dir):
    """An edge list of orders and parts, written to the shared folder and read back with new ids."""
    path = fresh_path(spark, "edges")
    ordered = table(spark, sf_dir, "lineitem").repartitionByRange(8, "l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey")
    ordered.select(F.concat_ws(" ", "l_orderkey", 1000000000 + F.col("l_partkey")).alias("value")).write.text(path)
    return files.read_edges(spark, path).edges().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


# ---- traversal ----

BFS_SQL = f"""
WITH RECURSIVE {SP_SQL}, walk AS (
  SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS dist
  UNION
  SELECT d.dst, w.dist + 1 FROM walk w JOIN darts d ON d.src = w.id WHERE w.dist < 12),
best AS (SELECT id, min(dist) AS dist FROM walk GROUP BY id)
"""


@query("bfs_distance", BFS_SQL + "SELECT ids.id, dist FROM ids LEFT JOIN best ON best.id = ids.id")
def _bfs(spark, sf_dir):
    return tr.bfs(supplier_parts(spark, sf_dir), 0).select("id", "dist")


@query("bfs_histogram", BFS_SQL + "SELECT dist, count(*) AS n FROM ids LEFT JOIN best ON best.id = ids.id GROUP BY 1")
def _histogram(spark, sf_dir):
    return tr.bfs_histogram(tr.bfs(supplier_parts(spark, sf_dir), 0))


@query("bfs_depth_2", BFS_SQL + "SELECT ids.id, CASE WHEN dist <= 2 THEN dist END AS dist FROM ids LEFT JOIN best ON best.id = ids.id")
def _bfs2(spark, sf_dir):
    return tr.bfs(supplier_parts(spark, sf_dir), 0, 2).select("id", "dist")


@query("bfs_tree", f"WITH {SP_SQL}, l1 AS (SELECT dst AS id, pos AS rk FROM darts WHERE src = 0), l2 AS (SELECT dst AS id, min(struct_pack(rk := l1.rk, pos := d.pos, src := d.src)) AS via FROM l1 JOIN darts d ON d.src = l1.id WHERE dst <> 0 GROUP BY 1), l2r AS (SELECT id, via, row_number() OVER (ORDER BY via.rk, via.pos, id) AS rk FROM l2), l3 AS (SELECT dst AS id, min(struct_pack(rk := l2r.rk, pos := d.pos, src := d.src)) AS via FROM l2r JOIN darts d ON d.src = l2r.id WHERE dst NOT IN (SELECT id FROM l1) GROUP BY 1) SELECT ids.id, CASE WHEN l1.id IS NOT NULL THEN 0 WHEN l2.id IS NOT NULL THEN l2.via.src ELSE l3.via.src END AS parent FROM ids LEFT JOIN l1 ON l1.id = ids.id LEFT JOIN l2 ON l2.id = ids.id LEFT JOIN l3 ON l3.id = ids.id")
def _bfs_tree(spark, sf_dir):
    return tr.bfs(supplier_parts(spark, sf_dir), 0, 3).select("id", "parent")


# Customers linked when neighbours in their nation by key, where both balances are positive.
CHAIN_SQL = """
c AS (SELECT c_custkey AS id, c_nationkey AS n, c_acctbal > 0 AS good, lead(c_custkey) OVER w AS nxt, lead(c_acctbal > 0) OVER w AS nxt_good FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
runs AS (SELECT c_custkey AS id, c_nationkey AS n, sum(CASE WHEN c_acctbal > 0 AND before THEN 0 ELSE 1 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS run FROM (SELECT *, lag(c_acctbal > 0) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS before FROM customer)),
least_ids AS (SELECT id, min(id) OVER (PARTITION BY n, run) AS head FROM runs),
labels AS (SELECT id, dense_rank() OVER (ORDER BY head) - 1 AS component FROM least_ids)
"""


def customer_chains(spark: SparkSession, sf_dir: str) -> Graph:
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "customer")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    links = c.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(w).alias("dst"), (F.col("c_acctbal") > 0).alias("a"), F.lead(F.col("c_acctbal") > 0).over(w).alias("b")).where("a and b")
    return Graph.from_edges(links, c.select(F.col("c_custkey").alias("id")))


@query("components", f"WITH {CHAIN_SQL} SELECT id, component FROM labels")
def _comp(spark, sf_dir):
    return tr.components(customer_chains(spark, sf_dir))


@query("component_sizes", f"WITH {CHAIN_SQL} SELECT component, count(*) AS size FROM labels GROUP BY 1")
def _sizes(spark, sf_dir):
    return tr.component_sizes(tr.components(customer_chains(spark, sf_dir)))


@query("largest_component", f"WITH {CHAIN_SQL} SELECT id FROM labels WHERE component = (SELECT component FROM labels GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def _largest(spark, sf_dir):
    return tr.largest_component(tr.components(customer_chains(spark, sf_dir)))


@query("is_connected", f"WITH {CHAIN_SQL} SELECT count(DISTINCT component) <= 1 AS connected FROM labels")
def _connected(spark, sf_dir):
    return tr.is_connected(customer_chains(spark, sf_dir))


def _sources(g: Graph) -> DataFrame:
    """The query set of the searches."""
    return g.vertices.where("id % 20 = 0").select("id")


def _knn_sql(k: int, wanted: str, levels: int) -> str:
    """The searches level by level, all sources together: a level's vertices are those that the last level's lists
    name first, in the order of discoverer and place.  More levels than the graph has give the same rows."""
    out = f"WITH {SP_SQL}, l0 AS (SELECT id AS source, id AS v, CAST(1 AS BIGINT) AS rk, CAST(0 AS BIGINT) AS dist FROM ids WHERE id % 20 = 0)"
    seen = "SELECT source, v FROM l0"
    for n in range(1, levels + 1):
        found = f"SELECT source, d.dst AS v, min(struct_pack(rk := l.rk, pos := d.pos)) AS via FROM l{n - 1} l JOIN darts d ON d.src = l.v GROUP BY 1, 2"
        out += f", l{n} AS (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY via.rk, via.pos, v) AS rk, CAST({n} AS BIGINT) AS dist FROM ({found}) WHERE (source, v) NOT IN ({seen}))"
        seen += f" UNION ALL SELECT source, v FROM l{n}"
    every = " UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(1, levels + 1))
    return out + f", hits AS (SELECT source, v, dist, row_number() OVER (PARTITION BY source ORDER BY dist, rk) AS place FROM ({every}) WHERE {wanted}) SELECT source, CAST(place AS INTEGER) AS rank, v AS id, dist FROM hits WHERE place <= {k}"


@query("knn_filtered", _knn_sql(8, "v % 3 = 0 AND v < 1000000", 4))
def _knn(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    v = g.vertices
    return tr.k_nearest(g, _sources(g), 8, v.where("id % 3 = 0 and id < 1000000").select("id"))


@query("within_radius", f"WITH {SP_SQL}, src AS (SELECT id FROM ids WHERE id % 20 = 0), one AS (SELECT src.id AS source, d.dst AS id FROM src JOIN darts d ON d.src = src.id), two AS (SELECT DISTINCT source, d.dst AS id FROM one JOIN darts d ON d.src = one.id WHERE d.dst <> source) SELECT source, id, CAST(1 AS BIGINT) AS dist FROM one UNION ALL SELECT source, id, 2 FROM two")
def _radius(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    return tr.within_radius(g, _sources(g), 2)


TREE_SQL = f"""
WITH RECURSIVE {HIER_SQL},
roots AS (SELECT id FROM ids WHERE id NOT IN (SELECT dst FROM edges)),
reach AS (SELECT id FROM roots UNION SELECT dst FROM reach JOIN edges ON src = reach.id),
sums AS (SELECT (SELECT count(*) FROM roots) AS roots, (SELECT max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY dst)) AS most, (SELECT count(*) FROM edges) AS m, (SELECT count(*) FROM ids) AS n, (SELECT count(*) FROM reach) AS r)
SELECT CAST(CASE WHEN most > 1 OR roots > 1 THEN -1 WHEN roots = 0 OR m <> n - 1 OR r <> n THEN 0 ELSE 1 END AS INTEGER) AS code FROM sums
"""


@query("is_tree", TREE_SQL)
def _is_tree(spark, sf_dir):
    return spark.createDataFrame([(tr.tree_check(hierarchy(spark, sf_dir)),)], "code int")


@query("count_leaves", f"WITH {HIER_SQL} SELECT count(*) AS n_leaves FROM ids WHERE id NOT IN (SELECT src FROM edges)")
def _leaves(spark, sf_dir):
    return tr.count_leaves(hierarchy(spark, sf_dir), 0)


@query("tree_parents", f"WITH {HIER_SQL} SELECT id, src AS parent FROM ids LEFT JOIN edges ON dst = id")
def _parents(spark, sf_dir):
    return tr.tree_parents(hierarchy(spark, sf_dir))


@query("lifo_tree")
def _lifo(spark, sf_dir):
    return tr.lifo_tree(supplier_parts(spark, sf_dir), 0)
