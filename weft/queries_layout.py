"""Registered queries of geometry, faces, forces and layouts, with SQL where it can express them.

Numbers are compared as whole ten-thousandths, so that the order of a sum
does not show.  MESH is a 6 x 8 grid drawn with x = column, y = row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import arrays, forces
from weft.functions import text as tx
from weft.functions.geometry import regular_polygon
from weft.model import Graph
from weft.operators import grip, layout, planar, quadtree, tidytree
from weft.operators import traverse as tr
from weft.queries import HIER_SQL, SP_SQL, customer_chains, hierarchy, points, query, supplier_parts, table
from weft.shared import materialise
from weft.sources import generators as gen

ROWS, COLS = 6, 8
AT_SQL = "spots AS (SELECT id, CAST((id * 7919) % 1000 AS DOUBLE) / 10.0 AS x, CAST((id * 104729) % 1000 AS DOUBLE) / 10.0 AS y FROM ids)"


def whole(c):
    return F.round(c * 10000).cast("long")


def scattered(ids: DataFrame) -> DataFrame:
    """(id, x, y): places computed from ids."""
    return ids.select("id", ((F.col("id") * 7919) % 1000).cast("double").__truediv__(10.0).alias("x"), ((F.col("id") * 104729) % 1000).cast("double").__truediv__(10.0).alias("y"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier-to-part darts with both places."""
    g = supplier_parts(spark, sf_dir)
    p = scattered(g.vertices)
    d = g.darts.where("src < 1000000").select("src", "dst")
    d = d.join(p.select(F.col("id").alias("src"), F.col("x").alias("vx"), F.col("y").alias("vy")), "src")
    return d.join(p.select(F.col("id").alias("dst"), F.col("x").alias("ux"), F.col("y").alias("uy")), "dst")



def _ends() -> tuple[list, list]:
    return [F.col("vx"), F.col("vy")], [F.col("ux"), F.col("uy")]


PAIR_SQL = f"WITH {SP_SQL}, {AT_SQL}, q AS (SELECT s AS src, p AS dst, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS r FROM sp JOIN spots a ON a.id = s JOIN spots b ON b.id = p) "


def _force(name: str, make, factor: str) -> None:
    sql = PAIR_SQL + f"SELECT src, dst, CAST(round(coalesce({factor}, 0) * dx * 10000) AS BIGINT) AS fx, CAST(round(coalesce({factor}, 0) * dy * 10000) AS BIGINT) AS fy FROM q"

    @query(name, sql)
    def run(spark, sf_dir, make=make):
        f = make(*_ends())
        return _pairs(spark, sf_dir).select("src", "dst", whole(f[0]).alias("fx"), whole(f[1]).alias("fy"))


_force("kk_force", lambda v, u: forces.spring(v, u, F.lit(2), 10.0), "r / 20.0 - 1.0")
_force("fine_attraction", lambda v, u: forces.fine_attraction(v, u, 10.0), "r * r / 100.0")
_force("fine_repulsion", lambda v, u: forces.fine_repulsion(v, u, 9.7), "CASE WHEN r > 1e-9 THEN -4.7045 / (r * r) END")
_force("fr_attraction", lambda v, u: forces.fr_attraction(v, u, 10.0), "r / 10.0")
_force("linlog_attraction", lambda v, u: forces.linlog_attraction(v, u), "CASE WHEN r > 1e-9 THEN ln(1 + r) / r END")


@query("fr_repulsion_pairs", PAIR_SQL + "SELECT src, dst, CAST(round(-CASE WHEN r <= 3 THEN 10000.0 ELSE 100.0 / (r - 3) END * dx / r * 10000) AS BIGINT) AS fx, CAST(round(-CASE WHEN r <= 3 THEN 10000.0 ELSE 100.0 / (r - 3) END * dy / r * 10000) AS BIGINT) AS fy FROM q WHERE r > 1e-9")
def _fr_pairs(spark, sf_dir):
    f = forces.fr_repulsion(*_ends(), 10.0, 3.0, 100.0)
    return _pairs(spark, sf_dir).where("vx <> ux or vy <> uy").select("src", "dst", whole(f[0]).alias("fx"), whole(f[1]).alias("fy"))


PTS_SQL = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings), lab AS (SELECT *, CAST(1 + label % 3 AS DOUBLE) AS mass FROM pts), near AS (SELECT a.id, a.x, a.y, a.mass, b.x - a.x AS dx, b.y - a.y AS dy, b.mass AS m2, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS r FROM lab a JOIN lab b ON a.id <> b.id)"


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select("id", "x", "y", (1 + F.col("label") % 3).cast("double").alias("mass"), F.lit(0.01).alias("radius"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(F.col("fx") * 100).cast("long").alias("fx"), F.round(F.col("fy") * 100).cast("long").alias("fy"))


def _sum_sql(k: str) -> str:
    return f"WITH {PTS_SQL} SELECT id, CAST(round(sum(-{k} * dx / r) * 100) AS BIGINT) AS fx, CAST(round(sum(-{k} * dy / r) * 100) AS BIGINT) AS fy FROM near GROUP BY id"


FR_K = "CASE WHEN r <= 0.02 THEN floor(m2) * 0.01 * 100.0 ELSE 0.01 * floor(m2) / (r - 0.02) END"
LL_K = "CASE WHEN r <= 0.02 THEN mass * m2 * 100.0 ELSE mass * m2 / (r - 0.02) END"


@query("fr_forces_exact", _sum_sql(FR_K))
def _fr_exact(spark, sf_dir):
    return _rounded(layout.exact_repulsion(_bodies(spark, sf_dir), "fr", 0.1, 100.0))


@query("linlog_forces", _sum_sql(LL_K))
def _linlog_exact(spark, sf_dir):
    return _rounded(layout.exact_repulsion(_bodies(spark, sf_dir), "linlog", 0.1, 100.0))


@query("barnes_hut_theta_0", _sum_sql(FR_K))
def _bh0(spark, sf_dir):
    return _rounded(quadtree.repulsion(_bodies(spark, sf_dir), forces.MODELS["fr"], 0.1, 0.0))


@query("barnes_hut_step")
def _bh(spark, sf_dir):
    return _rounded(quadtree.repulsion(_bodies(spark, sf_dir), forces.MODELS["fr"], 0.1, 0.8))


@query("overlap_saturation", f"WITH {PTS_SQL} SELECT id, count(*) AS n_touching FROM near WHERE r <= 0.02 GROUP BY id")
def _touching(spark, sf_dir):
    return layout.touching(_bodies(spark, sf_dir))


@query("gravity", f"WITH {SP_SQL}, {AT_SQL}, d AS (SELECT src, count(*) AS n FROM darts GROUP BY 1) SELECT id, CAST(round(CASE WHEN sqrt(x * x + y * y) < 1e-9 THEN 0 ELSE -0.5 * (n + 1) * x / sqrt(x * x + y * y) END * 10000) AS BIGINT) AS fx, CAST(round(CASE WHEN sqrt(x * x + y * y) < 1e-9 THEN 0 ELSE -0.5 * (n + 1) * y / sqrt(x * x + y * y) END * 10000) AS BIGINT) AS fy FROM spots JOIN d ON d.src = id")
def _gravity(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    rows = scattered(g.vertices).join(g.degrees(), "id")
    f = forces.gravity([F.col("x"), F.col("y")], 0.5 * (F.col("degree") + 1))
    return rows.select("id", whole(f[0]).alias("fx"), whole(f[1]).alias("fy"))


@query("vertex_radius", f"WITH {SP_SQL} SELECT src AS id, CAST(round(0.5 * (1 + 0.3 * sqrt(CAST(count(*) AS DOUBLE))) * 10000) AS BIGINT) AS radius FROM darts GROUP BY 1")
def _radius(spark, sf_dir):
    return supplier_parts(spark, sf_dir).degrees().select("id", whole(forces.radius(F.col("degree"), 0.5, 0.3)).alias("radius"))


MOVES_SQL = f"{SP_SQL}, {AT_SQL}, m AS (SELECT id, x, y, y / 10.0 + 1 AS dx, x / 20.0 - 2 AS dy FROM spots), t AS (SELECT id, x, y, dx - avg(dx) OVER () AS dx, dy - avg(dy) OVER () AS dy FROM m)"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scattered(supplier_parts(spark, sf_dir).vertices)
    return materialise(p.select("id", "x", "y", (F.col("y") / 10.0 + 1).alias("dx"), (F.col("x") / 20.0 - 2).alias("dy")))


@query("net_translation", f"WITH {MOVES_SQL} SELECT id, CAST(round(dx * 10000) AS BIGINT) AS dx, CAST(round(dy * 10000) AS BIGINT) AS dy FROM t")
def _translation(spark, sf_dir):
    return grip.remove_translation(_moves(spark, sf_dir)).select("id", whole(F.col("dx")).alias("dx"), whole(F.col("dy")).alias("dy"))


@query("net_rotation_2d", f"WITH {MOVES_SQL}, r AS (SELECT id, dx, dy, x - avg(x) OVER () AS rx, y - avg(y) OVER () AS ry FROM t), w AS (SELECT sum(rx * dy - ry * dx) / sum(rx * rx + ry * ry) AS w FROM r) SELECT id, CAST(round((dx + w * ry) * 10000) AS BIGINT) AS dx, CAST(round((dy - w * rx) * 10000) AS BIGINT) AS dy FROM r, w")
def _rotation(spark, sf_dir):
    out = grip.remove_rotation(grip.remove_translation(_moves(spark, sf_dir)))
    return out.select("id", whole(F.col("dx")).alias("dx"), whole(F.col("dy")).alias("dy"))


@query("edge_attraction", f"WITH {SP_SQL}, {AT_SQL}, f AS (SELECT src AS id, (b.x - a.x) * sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / 10.0 AS fx, (b.y - a.y) * sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / 10.0 AS fy FROM darts JOIN spots a ON a.id = src JOIN spots b ON b.id = dst) SELECT id, CAST(round(sum(fx) * 100) AS BIGINT) AS ax, CAST(round(sum(fy) * 100) AS BIGINT) AS ay FROM f GROUP BY id")
def _attraction(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    out = layout.edge_attraction(g.darts, scattered(g.vertices), "fr", 10.0)
    return out.select("id", F.round(F.col("ax") * 100).cast("long").alias("ax"), F.round(F.col("ay") * 100).cast("long").alias("ay"))


QUAD_SQL = """
WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
b AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, greatest(max(x) - min(x), max(y) - min(y)) / 2 AS half FROM p),
w AS (
  SELECT id, x, y, '' AS path, cx, cy, half, count(*) OVER () AS n FROM p, b
  UNION ALL
  SELECT id, x, y, path || CAST((x >= cx)::INT + 2 * (y >= cy)::INT AS VARCHAR), cx + CASE WHEN x >= cx THEN half / 2 ELSE -half / 2 END, cy + CASE WHEN y >= cy THEN half / 2 ELSE -half / 2 END, half / 2,
    count(*) OVER (PARTITION BY path, x >= cx, y >= cy)
  FROM w WHERE n > 4 AND half > 1e-9)
SELECT path, count(*) AS n, count(*) <= 4 AS is_leaf, CAST(round(avg(x) * 10000) AS BIGINT) AS com_x, CAST(round(avg(y) * 10000) AS BIGINT) AS com_y FROM w GROUP BY path
"""


@query("quadtree_levels", QUAD_SQL)
def _quadtree(spark, sf_dir):
    cells, _ = quadtree.build(points(spark, sf_dir).select("id", "x", "y", F.lit(1.0).alias("mass")))
    return cells.select("path", "n", "is_leaf", whole(F.col("com_x")).alias("com_x"), whole(F.col("com_y")).alias("com_y"))


# ---- faces of a grid whose rotation is closed form ----


def mesh(spark: SparkSession) -> Graph:
    """The grid with lists counter-clockwise: right, up, left, down."""
    ids = spark.range(ROWS * COLS)
    i, j = F.floor(F.col("id") / COLS), F.col("id") % COLS
    steps = [(j + 1 < COLS, F.col("id") + 1), (i + 1 < ROWS, F.col("id") + COLS), (j > 0, F.col("id") - 1), (i > 0, F.col("id") - COLS)]
    around = F.filter(F.array(*[F.when(ok, to) for ok, to in steps]), lambda x: x.isNotNull())
    darts = ids.select(F.col("id").alias("src"), F.posexplode(around).alias("pos", "dst"))
    return Graph(ids.select("id", F.lit(None).cast("string").alias("data")), darts.select("src", "pos", "dst"))


def grid_places(spark: SparkSession) -> DataFrame:
    return spark.range(ROWS * COLS).select("id", (F.col("id") % COLS).cast("double").alias("x"), F.floor(F.col("id") / COLS).cast("double").alias("y"))


MESH_SQL = f"v AS (SELECT id, id // {COLS} AS i, id % {COLS} AS j FROM (SELECT unnest(range({ROWS * COLS})) AS id)), d AS (SELECT id AS src, id + 1 AS dst, 0 AS k FROM v WHERE j + 1 < {COLS} UNION ALL SELECT id, id + {COLS}, 1 FROM v WHERE i + 1 < {ROWS} UNION ALL SELECT id, id - 1, 2 FROM v WHERE j > 0 UNION ALL SELECT id, id - {COLS}, 3 FROM v WHERE i > 0)"
OUTER_SQL = f"outer_ring AS (SELECT row_number() OVER (ORDER BY part, o) - 1 AS place, id FROM (SELECT 1 AS part, i AS o, id FROM v WHERE j = 0 UNION ALL SELECT 2, j, id FROM v WHERE i = {ROWS - 1} AND j > 0 UNION ALL SELECT 3, -i, id FROM v WHERE j = {COLS - 1} AND i < {ROWS - 1} UNION ALL SELECT 4, -j, id FROM v WHERE i = 0 AND j > 0 AND j < {COLS - 1}))"
FACES_SQL = f"{MESH_SQL}, {OUTER_SQL}, cells AS (SELECT i * {COLS - 1} + j AS c, id FROM v WHERE j + 1 < {COLS} AND i + 1 < {ROWS}), corners AS (SELECT CASE WHEN c = 0 THEN 0 ELSE c + 1 END AS face_id, k AS place, id + [0, 1, {COLS + 1}, {COLS}][k + 1] AS id FROM cells, (SELECT unnest(range(4)) AS k) UNION ALL SELECT 1, place, id FROM outer_ring)"


@query("next_dart", f"WITH {MESH_SQL}, r AS (SELECT src, dst, k, lag(dst) OVER w AS before, last_value(dst) OVER (PARTITION BY src ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM d WINDOW w AS (PARTITION BY src ORDER BY k)) SELECT a.src, a.dst, a.dst AS next_src, coalesce(b.before, b.final) AS next_dst FROM d a JOIN r b ON b.src = a.dst AND b.dst = a.src")
def _next(spark, sf_dir):
    return planar.next_dart(mesh(spark))


def _faces(spark: SparkSession) -> DataFrame:
    return materialise(planar.faces(mesh(spark)))


@query("faces", f"WITH {FACES_SQL} SELECT CAST(face_id AS BIGINT) AS face_id, CAST(place AS INTEGER) AS place, CAST(id AS BIGINT) AS id FROM corners")
def _face_rows(spark, sf_dir):
    return _faces(spark).select("face_id", F.posexplode("verts").alias("place", "id"))


@query("largest_face", f"WITH {FACES_SQL} SELECT CAST(place AS INTEGER) AS place, CAST(id AS BIGINT) AS id FROM outer_ring")
def _largest(spark, sf_dir):
    return planar.largest_face(_faces(spark)).select(F.posexplode("verts").alias("place", "id"))


@query("face_area", f"WITH {FACES_SQL} SELECT DISTINCT CAST(face_id AS BIGINT) AS face_id, CASE WHEN face_id = 1 THEN -{float((ROWS - 1) * (COLS - 1))} ELSE 1.0 END::DOUBLE AS area FROM corners")
def _areas(spark, sf_dir):
    return planar.face_areas(_faces(spark), grid_places(spark))


@query("face_at_point", f"WITH {MESH_SQL}, cells AS (SELECT i * {COLS - 1} + j AS c, i, j FROM v WHERE j + 1 < {COLS} AND i + 1 < {ROWS}) SELECT CAST(c AS BIGINT) AS point, CAST(CASE WHEN c = 0 THEN 0 ELSE c + 1 END AS BIGINT) AS face_id FROM cells UNION ALL SELECT 1000, 1")
def _pick(spark, sf_dir):
    cells = spark.range((ROWS - 1) * (COLS - 1)).select(F.col("id").alias("point"), (F.col("id") % (COLS - 1) + 0.5).alias("px"), (F.floor(F.col("id") / (COLS - 1)) + 0.5).alias("py"))
    away = spark.range(1).select(F.lit(1000).cast("long").alias("point"), F.lit(-50.0).alias("px"), F.lit(2.0).alias("py"))
    return planar.faces_at(_faces(spark), grid_places(spark), cells.unionByName(away))


# ---- barycentric rounds on the grid, its rim pinned ----

RIM = f"(i = 0 OR j = 0 OR i = {ROWS - 1} OR j = {COLS - 1})"
SEED_SQL = f"{MESH_SQL}, c AS (SELECT avg(j) AS mx, avg(i) AS my FROM v WHERE {RIM}), p0 AS (SELECT id, CASE WHEN {RIM} THEN j ELSE mx END::DOUBLE AS x, CASE WHEN {RIM} THEN i ELSE my END::DOUBLE AS y, {RIM} AS fixed FROM v, c)"
ROUND_SQL = "b{n} AS (SELECT src, avg(x) AS mx, avg(y) AS my FROM d JOIN p{m} ON p{m}.id = dst GROUP BY src), p{n} AS (SELECT id, CASE WHEN fixed THEN x ELSE x + {a} * (mx - x) END AS x, CASE WHEN fixed THEN y ELSE y + {a} * (my - y) END AS y, fixed FROM p{m} JOIN b{n} ON src = id)"


def _pinned(spark: SparkSession) -> layout.TutteLayout:
    g = mesh(spark)
    rim = grid_places(spark).where(f"x = 0 or y = 0 or x = {COLS - 1} or y = {ROWS - 1}")
    return layout.TutteLayout(g).set_boundary(rim)


def _places(p: DataFrame) -> DataFrame:
    return p.select("id", whole(F.col("x")).alias("x"), whole(F.col("y")).alias("y"))


@query("seed_interior", f"WITH {SEED_SQL} SELECT id, CAST(round(x * 10000) AS BIGINT) AS x, CAST(round(y * 10000) AS BIGINT) AS y FROM p0")
def _seed(spark, sf_dir):
    return _places(_pinned(spark).positions)


@query("tutte_step", f"WITH {SEED_SQL}, {ROUND_SQL.format(n=1, m=0, a=0.5)}, {ROUND_SQL.format(n=2, m=1, a=0.5)}, {ROUND_SQL.format(n=3, m=2, a=0.5)} SELECT id, CAST(round(x * 10000) AS BIGINT) AS x, CAST(round(y * 10000) AS BIGINT) AS y FROM p3")
def _tutte3(spark, sf_dir):
    t = _pinned(spark)
    for _ in range(3):
        t.step(0.1)
    return _places(t.positions)


@query("tutte_fixed_point", f"WITH {MESH_SQL} SELECT id, CAST(round(j * 1000) AS BIGINT) AS x, CAST(round(i * 1000) AS BIGINT) AS y FROM v")
def _tutte_end(spark, sf_dir):
    t = _pinned(spark)
    t.eps = 1e-7
    t.run(5000)
    return t.positions.select("id", F.round(F.col("x") * 1000).cast("long").alias("x"), F.round(F.col("y") * 1000).cast("long").alias("y"))


@query("spring_tutte_fixed_point", f"WITH {MESH_SQL} SELECT id, CAST(round(j * 100) AS BIGINT) AS x, CAST(round(i * 100) AS BIGINT) AS y FROM v")
def _spring_end(spark, sf_dir):
    t = _pinned(spark)
    t.spring, t.eps = (30.0, 6.0), 1e-8
    t.run(20000, 0.016)
    return t.positions.select("id", F.round(F.col("x") * 100).cast("long").alias("x"), F.round(F.col("y") * 100).cast("long").alias("y"))


@query("polygon_boundary", "SELECT id, CAST(round(200 * cos(2 * pi() * id / 12) * 10000) AS BIGINT) AS x, CAST(round(200 * sin(2 * pi() * id / 12) * 10000) AS BIGINT) AS y FROM (SELECT unnest(range(12)) AS id)")
def _polygon(spark, sf_dir):
    return _places(regular_polygon(spark.range(12).withColumn("place", F.col("id")), 12, 200.0))


# ---- multilevel ----


# Neighbours in a nation by key, where both balances are positive and the first key is no multiple of four: paths of
# several lengths, whose vertices join in turn.
MIS_SQL = """
WITH c AS (SELECT c_custkey AS id, c_nationkey AS n, lag(c_custkey % 4 <> 0 AND c_acctbal > 0) OVER w AND c_acctbal > 0 AS tied FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
runs AS (SELECT id, n, sum(CASE WHEN tied THEN 0 ELSE 1 END) OVER (PARTITION BY n ORDER BY id) AS run FROM c)
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY n, run ORDER BY id) AS place FROM runs) WHERE place % 2 = 1
"""


@query("mis_layer1", MIS_SQL)
def _mis(spark, sf_dir):
    g = customer_chains(spark, sf_dir)
    return grip.maximal_independent(g.vertices.select("id"), g.darts.where("least(src, dst) % 4 <> 0"))


def _tree_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The undirected tree of regions, nations and customers."""
    return Graph.from_edges(hierarchy(spark, sf_dir).darts.select("src", "dst"))


@query("mis_layers")
def _layers(spark, sf_dir):
    return grip.mis_layers(_tree_graph(spark, sf_dir))


@query("grip_place", f"WITH {SP_SQL}, {AT_SQL}, near AS (SELECT src AS id, dst FROM darts WHERE src >= 1000000 AND pos < 4) SELECT near.id, CAST(round(avg(x) * 10000) AS BIGINT) AS x, CAST(round(avg(y) * 10000) AS BIGINT) AS y FROM near JOIN spots ON spots.id = near.dst GROUP BY 1")
def _place(spark, sf_dir):
    g = supplier_parts(spark, sf_dir)
    g = Graph(g.vertices, materialise(g.darts))
    placed = scattered(g.vertices.where("id < 1000000")).select("id", F.array("x", "y").alias("pos"))
    near = tr.k_nearest(g, g.vertices.where("id >= 1000000").select("id"), 4, placed.select("id"), 1)
    out = grip.place(near, placed)
    return out.select("id", whole(F.get("pos", F.lit(0))).alias("x"), whole(F.get("pos", F.lit(1))).alias("y"))


@query("grip_layout")
def _grip(spark, sf_dir):
    out = grip.grip_layout(_tree_graph(spark, sf_dir))
    return out.select("id", "layer", F.get("pos", F.lit(0)).alias("x"), F.get("pos", F.lit(1)).alias("y"))


@query("force_layout_step")
def _force_step(spark, sf_dir):
    f = layout.ForceLayout(_tree_graph(spark, sf_dir)).begin(3)
    f.step()
    return f.positions


# ---- planarity, drawings, trees ----


# The mesh drawn with x = column, y = row: planar if no two of its edges without a common end meet.
PLANAR_SQL = f"""
WITH v AS (SELECT id, id // {COLS} AS y, id % {COLS} AS x FROM (SELECT unnest(range({ROWS * COLS})) AS id)),
e AS (SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS cy FROM v a JOIN v b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)),
s AS (SELECT p.*, q.*, (bx - ax) * (q_ay - ay) - (cy - ay) * (q_ax - ax) AS s1, (bx - ax) * (q_cy - ay) - (cy - ay) * (q_bx - ax) AS s2, (q_bx - q_ax) * (ay - q_ay) - (q_cy - q_ay) * (ax - q_ax) AS s3, (q_bx - q_ax) * (cy - q_ay) - (q_cy - q_ay) * (bx - q_ax) AS s4
  FROM e p JOIN (SELECT a AS q_a, b AS q_b, ax AS q_ax, ay AS q_ay, bx AS q_bx, cy AS q_cy FROM e) q ON p.a < q_a AND p.b <> q_a AND p.a <> q_b AND p.b <> q_b)
SELECT (SELECT min(id) FROM v) AS component, NOT EXISTS (SELECT 1 FROM s WHERE s1 * s2 <= 0 AND s3 * s4 <= 0 AND (s1 <> 0 OR s2 <> 0 OR s3 <> 0 OR s4 <> 0)) AS planar
"""


@query("is_planar", PLANAR_SQL)
def _planar(spark, sf_dir):
    return planar.is_planar(gen.rect_mesh(spark, ROWS, COLS))


# A planar graph without triangles has at most 2 V - 4 edges; this one has more.
KLEIN_SQL = """
WITH c AS (SELECT id, id // 5 AS i, id % 5 AS j FROM (SELECT unnest(range(20)) AS id)),
e AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT id AS a, CASE WHEN j + 1 < 5 THEN id + 1 ELSE id - j END AS b FROM c UNION ALL SELECT id, CASE WHEN i + 1 < 4 THEN id + 5 ELSE 4 - j END FROM c) WHERE a <> b),
k AS (SELECT DISTINCT a, b FROM e),
t AS (SELECT count(*) AS n FROM k x JOIN k y ON x.b = y.a JOIN k z ON z.a = x.a AND z.b = y.b)
SELECT (SELECT min(id) FROM c) AS component, NOT ((SELECT count(*) FROM k) > 2 * (SELECT count(*) FROM c) - 4 AND t.n = 0) AS planar FROM t
"""


@query("is_planar_klein", KLEIN_SQL)
def _not_planar(spark, sf_dir):
    return planar.is_planar(gen.klein_bottle(spark, 4, 5))


# Euler's formula: a rotation of a connected graph is one of the plane if it has E - V + 2 faces.
EULER_SQL = "WITH c AS (SELECT i, unnest(range(i + 1)) AS j FROM (SELECT unnest(range(13)) AS i)), n AS (SELECT count(*) AS v, (SELECT sum((j < i)::INT + 2 * (i < 12)::INT) FROM c) AS e FROM c) SELECT CAST(v AS BIGINT) AS n_vertices, CAST(e AS BIGINT) AS n_edges, CAST(e - v + 2 AS BIGINT) AS n_faces, CAST(2 * e AS BIGINT) AS n_darts FROM n"


@query("rotation_euler", EULER_SQL)
def _euler(spark, sf_dir):
    g = planar.apply_rotation(gen.tri_mesh(spark, 12))
    f = planar.faces(g).agg(F.count(F.lit(1)).alias("n_faces"), F.sum(F.size("verts")).cast("long").alias("n_darts"))
    return g.size().withColumnRenamed("n", "n_vertices").crossJoin(g.edge_count()).crossJoin(f)  # one row each


@query("kuratowski")
def _witness(spark, sf_dir):
    return planar.kuratowski(gen.klein_bottle(spark, 4, 5))


@query("planar_rotation")
def _rotated(spark, sf_dir):
    return planar.planar_rotation(gen.tri_mesh(spark, 12))


@query("triangulation_counts", f"WITH v AS (SELECT unnest(range({ROWS * COLS})) AS id) SELECT CAST(3 * count(*) - 6 AS BIGINT) AS n_edges, CAST(3 * count(*) - 6 - count(*) + 2 AS BIGINT) AS n_faces, CAST(2 * (3 * count(*) - 6) // (2 * count(*) - 4) AS INTEGER) AS longest FROM v")
def _triangulated(spark, sf_dir):
    t = planar.triangulate(planar.apply_rotation(gen.rect_mesh(spark, ROWS, COLS)))
    f = planar.faces(t).agg(F.count(F.lit(1)).alias("n_faces"), F.max(F.size("verts")).alias("longest"))
    return t.edge_count().crossJoin(f)  # one row each


@query("schnyder_wood")
def _wood(spark, sf_dir):
    return planar.schnyder_wood(planar.triangulate(planar.apply_rotation(gen.rect_mesh(spark, ROWS, COLS))))


@query("planar_embedding")
def _drawn(spark, sf_dir):
    return planar.planar_embedding(gen.rect_mesh(spark, ROWS, COLS))


@query("tidy_tree_depth", f"WITH {HIER_SQL} SELECT id, CAST(CASE WHEN id = 0 THEN 0 WHEN id < 100 THEN 1 WHEN id < 1000 THEN 2 ELSE 3 END AS INTEGER) AS depth, CASE WHEN id = 0 THEN 0.0 WHEN id < 100 THEN 1000.0 WHEN id < 1000 THEN 2000.0 ELSE 3000.0 END::DOUBLE AS y FROM ids")
def _tree(spark, sf_dir):
    return tidytree.tidy_tree(hierarchy(spark, sf_dir)).select("id", "depth", "y")


@query("tidy_tree")
def _tree_x(spark, sf_dir):
    return tidytree.tidy_tree(hierarchy(spark, sf_dir))


# ---- text, lists, series ----


@query("text_recognisers", r"SELECT p_partkey, regexp_matches(CAST(p_retailprice AS VARCHAR), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') AS price_is_number, regexp_matches(p_name, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') AS name_is_number FROM part")
def _recognise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.looks_like_number(F.col("p_retailprice").cast("string")).alias("price_is_number"), tx.looks_like_number(F.col("p_name")).alias("name_is_number"))


@query("json_escape", "SELECT doc_id, to_json(text || chr(9) || '\"' || chr(92)) AS j FROM documents")
def _escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.json_string(F.concat("text", F.lit('\t"\\'))).alias("j"))


@query("list_ops", "SELECT vec_id, CAST(list_position(l, 3) - 1 AS BIGINT) AS found, l[1:2] || [9] || l[3:] AS inserted, l[1:1] || l[3:] AS deleted, l[1:4] AS popped, l[5] AS final FROM (SELECT vec_id, [label, label + 1, 3, 4, vec_id % 7]::BIGINT[] AS l FROM embeddings)")
def _lists(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.col("label"), F.col("label") + 1, F.lit(3), F.lit(4), F.col("vec_id") % 7).cast("array<long>").alias("l"))
    nine = F.lit(9).cast("long")
    return rows.select("vec_id", arrays.find_one(F.col("l"), F.lit(3).cast("long")).alias("found"), arrays.insert_at(F.col("l"), 2, nine).alias("inserted"), arrays.delete_at(F.col("l"), 1).alias("deleted"), arrays.pop(F.col("l")).alias("popped"), arrays.tail(F.col("l")).alias("final"))


@query("stat_series")
def _series(spark, sf_dir):
    t = _pinned(spark)
    for _ in range(3):
        t.step(0.1)
    return t.series_table(spark)
