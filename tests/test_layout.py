"""Planarity, forces, quadtrees and layouts."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import forces
from weft.model import Graph, View
from weft.operators import grip, layout, planar, quadtree, tidytree
from weft.operators import traverse as tr
from weft.operators.embedding import Embedding
from weft.plans.session import Payload, Session
from weft.shared import materialise
from weft.sources import generators as gen


def adjacency(edges, n=0):
    out = {i: [] for i in range(n)}
    for u, v in edges:
        out.setdefault(u, []).append(v)
        out.setdefault(v, []).append(u)
    return out


def grid_lists(rows, cols):
    edges = [(i * cols + j, i * cols + j + 1) for i in range(rows) for j in range(cols - 1)]
    return adjacency(edges + [(i * cols + j, (i + 1) * cols + j) for i in range(rows - 1) for j in range(cols)], rows * cols)


def euler_holds(lists, rotation):
    seen, parts = set(), 0
    for s in lists:
        if s not in seen:
            parts += 1
            stack = [s]
            seen.add(s)
            while stack:
                for y in lists[stack.pop()]:
                    if y not in seen:
                        seen.add(y)
                        stack.append(y)
    faces = len(planar.walk_faces(rotation)) + sum(not r for r in rotation.values())
    return len(lists) - sum(map(len, lists.values())) // 2 + faces == 2 * parts


def test_rotation_and_witness():
    k4 = planar.LeftRight(adjacency([(0, 2), (0, 1), (0, 3), (1, 2), (2, 3)])).rotation()
    ring = k4[0]
    assert [3, 2, 1] in [ring[k:] + ring[:k] for k in range(3)]
    k5 = adjacency(list(itertools.combinations(range(5), 2)))
    k33 = adjacency([(a, b) for a in range(3) for b in range(3, 6)])
    assert planar.LeftRight(k5).rotation() is None and planar.LeftRight(k33).rotation() is None
    assert len(planar.witness(k5)) == 10
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(5, 11)
        lists = adjacency([e for e in itertools.combinations(range(n), 2) if rng.random() < 0.4], n)
        rot = planar.LeftRight(lists).rotation()
        if rot is not None:
            assert {v: sorted(r) for v, r in rot.items()} == {v: sorted(r) for v, r in lists.items()} and euler_holds(lists, rot)
        else:
            deg = sorted(len(x) for x in adjacency(planar.witness(lists)).values() if len(x) > 2)
            assert deg in ([4] * 5, [3] * 6)


def crossing(p, q, r, s):
    o = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (o(p, q, r) > 0) != (o(p, q, s) > 0) and (o(r, s, p) > 0) != (o(r, s, q) > 0)


@pytest.mark.parametrize("lists", [grid_lists(4, 5), adjacency([(k, (k + 1) % 6) for k in range(6)] + [(5, 3)]), adjacency([(0, k) for k in range(1, 8)]), adjacency(list(itertools.combinations(range(4), 2)))])
def test_triangulation_and_drawing(lists):
    rot = planar.triangulate_rotation(planar.LeftRight(lists).rotation())
    assert all(len(f) == 3 for f in planar.walk_faces(rot)) and euler_holds(rot, rot)
    roots, trees = planar.schnyder(rot)
    inner = set(rot) - set(roots)
    assert all(set(t) == inner for t in trees)
    pos = planar.schnyder_positions(roots, trees, sorted(rot))
    assert len(set(pos.values())) == len(rot)
    edges = [(u, v) for u in rot for v in rot[u] if u < v]
    assert not any(len({*a, *b}) == 4 and crossing(pos[a[0]], pos[a[1]], pos[b[0]], pos[b[1]]) for a, b in itertools.combinations(edges, 2))


def test_planar_frames(spark):
    square = Graph.of(spark, 5, [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4)])
    rotated = planar.apply_rotation(square)
    faces = planar.faces(rotated)
    assert sorted(len(r.verts) for r in faces.collect()) == [4, 6]
    assert len(planar.largest_face(faces).first().verts) == 6
    with pytest.raises(ValueError):
        planar.apply_rotation(Graph.of(spark, 5, list(itertools.combinations(range(5), 2))))


# ---- forces ----


def vector(spark, make, v, u):
    cols = lambda p: [F.lit(float(x)) for x in p]
    f = make(cols(v), cols(u))
    return tuple(spark.range(1).select(*[x.alias(f"f{k}") for k, x in enumerate(f)]).first())


def test_pair_forces(spark):
    close = lambda a, b: all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a, b, strict=True))
    assert close(vector(spark, lambda v, u: forces.spring(v, u, F.lit(1), 5.0), (0, 0), (3, 4)), (0, 0))
    assert close(vector(spark, lambda v, u: forces.spring(v, u, F.lit(1), 10.0), (0, 0), (3, 4)), (-1.5, -2))
    assert close(vector(spark, lambda v, u: forces.fine_attraction(v, u, 1.0), (0, 0), (2, 0)), (8, 0))
    assert close(vector(spark, lambda v, u: forces.fine_repulsion(v, u, 1.0), (2, 0), (0, 0)), (0.025, 0))
    assert close(vector(spark, lambda v, u: forces.fr_attraction(v, u, 5.0), (0, 0), (3, 4)), (3, 4))
    assert close(vector(spark, lambda v, u: forces.fr_repulsion(v, u, 1.0), (0, 0), (2, 0)), (-0.5, 0))
    assert close(vector(spark, lambda v, u: forces.fr_repulsion(v, u, 1.0, 1.0), (0, 0), (2, 0)), (-1, 0))
    assert close(vector(spark, lambda v, u: forces.fr_repulsion(v, u, 1.0, 2.0, 10.0), (0, 0), (1, 0)), (-10, 0))
    same = vector(spark, lambda v, u: forces.fr_repulsion(v, u, 2.0, 0.0, 10.0, 1.0, F.lit(3), F.lit(7)), (1, 1), (1, 1))
    other = vector(spark, lambda v, u: forces.fr_repulsion(v, u, 2.0, 0.0, 10.0, 1.0, F.lit(7), F.lit(3)), (1, 1), (1, 1))
    assert math.isclose(math.hypot(*same), 40) and close(same, tuple(-x for x in other))


def test_quadtree(spark):
    pts = lambda xs: spark.createDataFrame([(k, float(x), float(y), 1.0) for k, (x, y) in enumerate(xs)], "id long, x double, y double, mass double")
    cells, members = quadtree.build(pts([(0, 0), (10, 0), (0, 10), (10, 10), (4, 4)]), 4)
    root = cells.where("path = ''").first()
    assert (root.com_x, root.com_y, root.mass, root.half) == (4.8, 4.8, 5.0, 5.0) and members.count() == 5
    same, held = quadtree.build(pts([(2, 2)] * 3), 1, min_half=0.3)
    assert same.where("is_leaf").first().n == 3 and held.count() == 3
    few, _ = quadtree.build(pts([(0, 0), (1, 1), (2, 2)]), 3)
    assert few.count() == 1 and few.first().is_leaf


def test_barnes_hut_points_as_exact(spark):
    hexagon = [(math.cos(k * math.pi / 3) * 10, math.sin(k * math.pi / 3) * 10) for k in range(6)]
    bodies = spark.createDataFrame([(k, x, y, 1.0, 0.0) for k, (x, y) in enumerate(hexagon)], "id long, x double, y double, mass double, radius double")
    exact = {r.id: np.array([r.fx, r.fy]) for r in layout.exact_repulsion(bodies, "fr", 10.0, 100.0).collect()}
    tree = {r.id: np.array([r.fx, r.fy]) for r in quadtree.repulsion(bodies, forces.MODELS["fr"], 10.0, 0.05, cap=1).collect()}
    for k in exact:
        assert np.allclose(exact[k] / np.linalg.norm(exact[k]), tree[k] / np.linalg.norm(tree[k]), atol=0.1)


@pytest.mark.parametrize(("edge", "at", "gravity", "closer"), [(True, 50, 0.0, True), (False, 1, 0.0, False), (True, 0.5, 0.0, False), (False, 100, 100.0, True)])
def test_two_bodies(spark, edge, at, gravity, closer):
    g = Graph.of(spark, 2, [(0, 1)] if edge else [])
    start = spark.createDataFrame([(0, -float(at), 0.0), (1, float(at), 0.0)], "id long, x double, y double")
    f = layout.ForceLayout(g, layout.ForceConfig(gravity=gravity)).begin(positions=start)
    with pytest.raises(RuntimeError):
        layout.ForceLayout(g).run(1, 0.1)
    assert f.step() > 0
    x = {r.id: r.x for r in f.positions.collect()}
    assert (abs(x[1] - x[0]) < 2 * at) == closer
    assert f.series("forceEmbedder.maxDisp") and f.invoke("forceEmbedder.toggleOverlapPrevention") == 0


def test_speed_controller():
    s = layout.Speed()
    assert s.update(1.0, 0.0, 10, 1.0) == s
    slower = s.update(10.0, 1.0, 10, 1.0)
    assert slower.speed < 1 and slower.efficiency < 1
    faster = s.update(0.0, 1.0, 10, 1.0)
    assert faster.speed == 1.0 and faster.efficiency == 1.0


# ---- barycentric layouts ----


def pinned_grid(spark, n, **more):
    g = gen.rect_mesh(spark, n, n)
    rim = spark.range(n * n).select("id", (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y")).where(f"x = 0 or y = 0 or x = {n - 1} or y = {n - 1}")
    return layout.TutteLayout(g, **more).set_boundary(rim)


def test_tutte_forms_agree(spark):
    place = lambda t: {r.id: (r.x, r.y) for r in t.positions.collect()}
    jacobi, gauss, spring = pinned_grid(spark, 5), pinned_grid(spark, 5), pinned_grid(spark, 5, spring=(30.0, 40.0), eps=1e-7)
    assert jacobi.run(5000) < 5000 and gauss.run(5000, gauss_seidel=True) < 5000 and spring.run(20000, 0.016) < 20000
    for k, (x, y) in place(jacobi).items():
        assert abs(x - k % 5) < 1e-3 and abs(y - k // 5) < 1e-3
        assert np.allclose(place(gauss)[k], (x, y), atol=1e-3) and np.allclose(place(spring)[k], (x, y), atol=1e-2)


def test_rounds_as_jobs_are_the_kernel_s(spark):
    a, b = pinned_grid(spark, 4, spring=(30.0, 6.0)), pinned_grid(spark, 4, spring=(30.0, 6.0), kernel_vertices=0)
    a.run(3, 0.05)
    b.run(3, 0.05)
    place = lambda t: {r.id: (r.x, r.y) for r in t.positions.collect()}
    assert all(np.allclose(v, place(b)[k]) for k, v in place(a).items())
    with pytest.raises(ValueError):
        layout.TutteLayout(gen.rect_mesh(spark, 2, 2)).set_boundary(spark.createDataFrame([(0, 0.0, 0.0)], "id long, x double, y double"))


def test_centroid_of_k4(spark):
    g = Graph.of(spark, 4, list(itertools.combinations(range(4), 2)))
    t = layout.TutteLayout(g).fix_polygon(spark.range(3).withColumn("place", F.col("id")), 3)
    t.run(100)
    p = {r.id: (r.x, r.y) for r in t.positions.collect()}
    assert np.allclose(p[3], np.mean([p[k] for k in range(3)], axis=0), atol=1e-4)


def test_point_forces_by_expansions_are_the_exact_sums(spark):
    """Scattered, clustered, coincident and almost coincident bodies; most pairs are never formed."""
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.uniform(-500, 500, (2400, 2)), rng.normal(200, 4, (300, 2)), np.full((40, 2), 7.25), [[90.0, 90.0], [90.0 + 1e-10, 90.0], [90.0, 90.0 + 3e-9]]])
    rows = [(i, float(x), float(y), float(1 + i % 3), 0.0) for i, (x, y) in enumerate(xy)]
    bodies = materialise(spark.createDataFrame(rows, "id long, x double, y double, mass double, radius double"))
    for model in ("fr", "linlog"):
        got, want = ({r.id: (r.fx, r.fy) for r in df.collect()} for df in (quadtree.point_repulsion(bodies, forces.MODELS[model], 10.0, 100.0, 64), layout.exact_repulsion(bodies, model, 10.0, 100.0)))
        assert got.keys() == want.keys() and len(got) == len(rows)
        worst = max(np.hypot(got[i][0] - want[i][0], got[i][1] - want[i][1]) / np.hypot(*want[i]) for i in want)
        assert worst < 1e-11, worst
    chunks, cells = quadtree._chunked(bodies, 64)
    let = quadtree._far_and_near(chunks, cells)
    n = chunks.select(F.col("path").alias("u_path"), F.size("rows").alias("n"))
    v = chunks.select(F.col("path").alias("v_path"), F.col("piece").alias("v_piece"), F.size("rows").alias("m"))
    paired = let.where("near").join(v, ["v_path", "v_piece"]).join(n, F.col("path") == F.col("u_path")).agg(F.sum(F.col("m") * F.col("n"))).first()[0]
    assert paired < 0.4 * len(rows) ** 2


def test_many_points_are_not_paired(spark, monkeypatch):
    asked, none = [], spark.createDataFrame([], "id long, fx double, fy double")
    monkeypatch.setattr(layout, "EXPANDED", 3)
    monkeypatch.setattr(quadtree, "point_repulsion", lambda *a: asked.append(a) or none)
    for n, radius in ((3, 0.0), (4, 0.0), (4, 0.5)):
        layout.exact_repulsion(spark.createDataFrame([(i, float(i), 0.0, 1.0, radius) for i in range(n)], "id long, x double, y double, mass double, radius double"), "fr", 1.0, 100.0)
    assert len(asked) == 1


# ---- multilevel ----


def distances(lists, s):
    out, queue = {s: 0}, [s]
    for v in queue:
        for u in lists[v]:
            if u not in out:
                out[u] = out[v] + 1
                queue.append(u)
    return out


def test_filtration_spacing():
    lists = grid_lists(25, 45)
    c = grip.Component(list(lists), lists, grip.GripConfig())
    assert sorted(c.order) == list(range(1125)) and len(c.border) > 4 and c.border[-1] == 3 and c.border == sorted(c.border, reverse=True)
    far = {v: distances(lists, v) for v in c.order[: c.border[2]]}
    for i in range(2, len(c.border) - 1):
        layer, finer = c.order[: c.border[i]], c.order[: c.border[i - 1]]
        assert all(far[a][b] > 2 ** (i - 1) for a, b in itertools.combinations(layer, 2))
        assert all(v in layer or any(far[a][v] <= 2 ** (i - 1) for a in layer) for v in finer)


@pytest.mark.parametrize("dim", [2, 3, 4])
def test_layout_spreads(dim):
    lists = grid_lists(10, 10)
    c = grip.Component(list(lists), lists, grip.GripConfig(dim=dim))
    c.embed()
    assert np.isfinite(c.xy).all() and (np.ptp(c.xy, axis=0)[:2] > 1).all()
    edge = np.mean([np.linalg.norm(c.xy[u] - c.xy[v]) for u in lists for v in lists[u]])
    assert np.linalg.norm(c.xy[0] - c.xy[99]) > 3 * edge


def test_policies():
    sizes = [1000, 500, 100, 10, 3]
    k = lambda policy, layer, placing=False: grip.GripConfig(policy=policy).k(layer, sizes, placing)
    assert k("constant", 3) == 128 and k("layer_decay", 3) == 16 and k("layer_grow", 4) == 128 and k("layer_grow", 0) == 8
    assert k("placement_decay", 3) == 128 and k("placement_decay", 3, True) == 16 and k("budget", 0) == 128 and k("budget", 3) == 256 and k("budget", 3, True) == 16


def test_grip_frames_agree_with_kernel(spark):
    lists = grid_lists(6, 6)
    c = grip.Component(list(lists), lists, grip.GripConfig())
    layers = {r.id: r.layer for r in grip.mis_layers(gen.rect_mesh(spark, 6, 6)).collect()}
    for k, size in enumerate(c.border[:-1]):
        assert {v for v, top in layers.items() if top >= k} == set(c.order[:size])
    out = grip.grip_layout(Graph.of(spark, 6, [(0, 1), (1, 2), (0, 2), (3, 4)])).collect()
    assert {r.id for r in out} == {0, 1, 2}  # components below a simplex are left out


def test_layers_as_jobs_are_those_of_the_kernel(spark):
    """A path and a star with a tail: their tops are padded."""
    for edges in ([(i, i + 1) for i in range(11)], [(0, i) for i in range(1, 7)] + [(6, 7), (7, 8)]):
        n = max(max(e) for e in edges) + 1
        lists = {v: [b if a == v else a for a, b in edges if v in (a, b)] for v in range(n)}
        c = grip.Component(list(range(n)), lists, grip.GripConfig())
        g = Graph.of(spark, n, edges)
        layers = grip.pad_layers(grip.mis_layers(g), g.darts.select("src", "dst"), 2)
        found = {r.id: r.layer for r in layers.collect()}
        for k, size in enumerate(c.border):
            assert {v for v, top in found.items() if top >= k} == set(c.order[:size]), (k, n)


def test_large_components_run_as_jobs(spark):
    g = gen.rect_mesh(spark, 3, 4)
    config = grip.GripConfig(dim=3, rounds=2)
    one = {r.id: (r.pos, r.layer) for r in grip.grip_layout(g, config).collect()}
    jobs = {r.id: (r.pos, r.layer) for r in grip.grip_layout(g, config, kernel_vertices=5).collect()}
    assert {v: x[1] for v, x in one.items()} == {v: x[1] for v, x in jobs.items()}
    assert all(len(x[0]) == 3 and np.isfinite(x[0]).all() for x in jobs.values())


def test_rounds_in_a_task_are_those_of_jobs(spark):
    g = Graph.of(spark, 30, [(0, i) for i in range(1, 20)] + [(i, i + 10) for i in range(10, 20)] + [(5, 5)])
    config = grip.GripConfig(rounds=3)
    packed = tr.nearest_lists(g, ids(spark, *range(30)), 6)
    at = materialise(layout.random_positions(g.vertices, 100.0))
    state = at.select("id", "pos", F.lit(0.0).alias("heat"), F.lit(0.0).alias("cos"), F.array(F.lit(0.0), F.lit(0.0)).alias("disp"), F.lit(True).alias("fresh"))
    got, stats = grip.rounds_in_task(at, packed, g.darts.where("src <> dst").select("src", "dst"), config)
    for k in range(3):
        state, each = grip.grip_round(g, state, tr.listed(packed), 0, config)
        assert all(abs(each[name] - stats[k][name]) < 1e-6 * (1 + each[name]) for name in each)
    got, want = ({r.id: (*r.pos, r.heat, r.cos, *r.disp) for r in df.collect()} for df in (got, state))
    assert len(stats) == 3 and got.keys() == want.keys() and all(np.allclose(got[v], want[v], rtol=1e-6) for v in want)


HUBS = [(50, i) for i in range(40)] + [(60, i) for i in range(61, 101)] + [(50, 51), (51, 52), (52, 60), (51, 53), (53, 54), (60, 75), (51, 51), (54, 54), (55, 40), (40, 55)] + [(54, i) for i in (41, 42, 55)] + [(52, i) for i in range(43, 50)] + [(60, i) for i in (56, 57, 58, 59)]


def test_ends_of_hubs_settle_after_the_rest(spark):
    lists = {v: [b if a == v else a for a, b in HUBS if v in (a, b)] for v in range(101)}
    g = Graph.of(spark, 101, HUBS)
    ends = {r.id: (r.parent, r.n) for r in grip.ends_of(g.darts).collect()}
    want = {v: (u[0], len(u)) for v in lists if len(set(u := [x for x in lists[v] if x != v])) == 1}
    assert ends == want and ends[75] == (60, 2) and 53 not in ends
    assert grip.ends_of(Graph.of(spark, 2, [(0, 1)]).darts).isEmpty()  # neither has others
    c = grip.Component(list(lists), lists, grip.GripConfig())
    layers, upper = grip.filtration(g, 2, grip.ends_of(g.darts))
    found = {r.id: r.layer for r in grip.pad_layers(layers, g.darts.select("src", "dst"), 2, upper.select("src", "dst")).collect()}
    for k, size in enumerate(c.border):
        assert {v for v, top in found.items() if top >= k} == set(c.order[:size])


@pytest.mark.parametrize("k", [6, 60])
def test_ends_share_the_list_of_their_neighbour(spark, monkeypatch, k):
    """The finest layer searches from no end of a hub, and moves all as by searches from each."""
    g = Graph.of(spark, 101, HUBS)
    config = grip.GripConfig(rounds=3, refinement_k=k)
    packed = tr.nearest_lists(g, g.vertices.select("id"), k)
    at = materialise(layout.random_positions(g.vertices, 100.0))
    want, each = grip.rounds_in_task(at.select("id", "pos"), packed, g.darts.where("src <> dst").select("src", "dst"), config)
    whole, sources = grip.nearest_lists, []
    monkeypatch.setattr(grip, "nearest_lists", lambda g, s, *a: sources.append({r.id for r in s.collect()}) or whole(g, s, *a))
    monkeypatch.setattr(grip, "BLOCK_ENDS", 16)
    session = grip.GripLayout(g, config)
    session.ends, session.sizes = grip.ends_of(g.darts), [101]
    session._enter(at.select("id", "pos"))
    session._refine_whole()
    assert len(sources) == 1 and not sources[0] & {0, 39, 61, 100} and {43, 50, 60} <= sources[0]
    assert len(each) == 3 and all(abs(session.last[name] - each[-1][name]) < 1e-9 * (1 + each[-1][name]) for name in each[-1])
    got, want = ({r.id: (*r.pos, r.heat, r.cos, *r.disp) for r in df.collect()} for df in (session.state, want))
    assert got.keys() == want.keys() and all(np.allclose(got[v], want[v], rtol=1e-9, atol=1e-9) for v in want)


def test_coarse_rounds_in_blocks_are_those_of_a_task(spark):
    g = gen.rect_mesh(spark, 5, 6)
    config, active = grip.GripConfig(rounds=3, dim=3), ids(spark, *range(0, 30, 2))
    packed = tr.nearest_lists(g, active, 5, active)
    at = materialise(layout.random_positions(active, 100.0, dim=3).select("id", "pos"))
    (got, a), (want, b) = grip.rounds_in_blocks(at, packed, None, None, 5, config), grip.rounds_in_task(at, packed, None, config)
    got, want = ({r.id: (*r.pos, r.heat, r.cos, *r.disp) for r in df.collect()} for df in (got, want))
    assert len(a) == len(b) == 3 and got.keys() == want.keys() and all(np.allclose(got[v], want[v]) for v in want)


def test_wide_placement_needs_no_search(spark, monkeypatch):
    """A star of more leaves than a search a leaf can pass; fresh vertices start at the mean of all that are placed."""
    n = 3000
    lists = {0: list(range(1, n))} | {v: [0] for v in range(1, n)}
    c = grip.Component(list(lists), lists, grip.GripConfig(rounds=1))
    calls, whole = [], c._nearest
    c._nearest = lambda v, visible, k: calls.append(visible.sum() < n) or whole(v, visible, k)
    c.embed()
    assert sum(calls) < 10 and np.isfinite(c.xy).all()


def test_ends_are_on_no_path(spark):
    g = Graph.of(spark, 7, [(0, 1), (1, 2), (2, 3), (1, 4), (2, 5), (5, 5), (5, 6)])
    cut = grip.without_ends(g, ids(spark, 0))
    assert {r.id for r in cut.vertices.collect()} == {0, 1, 2, 5}
    among = ids(spark, 0, 5)
    near = lambda h: {tuple(r) for r in tr.listed(tr.nearest_lists(h, among, 3, among)).collect()}
    assert near(cut) == near(g) == {(0, 5, 3), (5, 0, 3)}


def test_searches_over_all_lists_are_those_that_ask(spark, monkeypatch):
    """Vertices without a list among the sources and on the way."""
    g = Graph.of(spark, 103, HUBS)
    g = Graph(g.vertices, materialise(g.darts.where("src <> 40 and src <> 53")), True)
    some, among = ids(spark, 0, 40, 50, 54, 60, 101), ids(spark, *range(0, 103, 3))
    found = lambda: [sorted(map(tuple, df.collect())) for df in (tr.k_nearest(g, some, 7), tr.k_nearest(g, some, 20, among), tr.within_radius(g, some, 2), tr.listed(tr.nearest_lists(g, some, 7)))]
    whole = found()
    monkeypatch.setattr(tr, "WHOLE_LISTS", 0)
    assert whole == found() and all(whole)


def test_packed_searches_are_the_same(spark):
    """Lists longer than a search takes at once, and more sources than a packed row holds."""
    n = 2600
    g = Graph.of(spark, n, [(0, i) for i in range(1, n)] + [(i, i + 1) for i in range(1, 50)])
    every = ids(spark, *range(n))
    hits = {(r.source, r.id, r.dist) for r in tr.k_nearest(g, every, 5).collect()}
    assert {tuple(r) for r in tr.listed(tr.nearest_lists(g, every, 5)).collect()} == hits and len(hits) == 5 * n
    some = ids(spark, 2000, 2599)
    far = {(r.source, r.id, r.dist) for r in tr.k_nearest(g, ids(spark, 7), 2, some).collect()}
    assert far == {(7, 2000, 2), (7, 2599, 2)}


def test_rigid_motion_of_rows(spark):
    rng = np.random.default_rng(2)
    for dim in (2, 3, 4):
        xy, d = rng.normal(size=(20, dim)), rng.normal(size=(20, dim))
        names = [f"x{k}" for k in range(dim)] + [f"d{k}" for k in range(dim)]
        moves = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(xy, d))], ["id", *names])
        got = np.array([r[1 + dim :] for r in sorted(grip.without_rigid_motion(moves, dim).collect())])
        assert np.allclose(got, grip.rigid_free(xy, d))


def test_rigid_motion_is_removed():
    rng = np.random.default_rng(1)
    for dim in (2, 3, 4):
        xy = rng.normal(size=(20, dim))
        spin = rng.normal(size=(dim, dim))
        d = grip.rigid_free(xy, (xy - xy.mean(0)) @ (spin - spin.T) + 3.0)
        assert np.abs(d).max() < (1e-9 if dim < 4 else 3.0)


def test_dense_components_are_told_by_their_edges(spark):
    k6 = list(itertools.combinations(range(6), 2))
    g = Graph.of(spark, 12, k6 + k6 + [(6, 7), (7, 8), (8, 6), (8, 6), (9, 9), (10, 11)])
    assert sorted(map(tuple, planar.is_planar(g).collect())) == [(0, False), (6, True), (9, True), (10, True)]
    assert {r.src for r in planar.planar_rotation(g).collect()} == {6, 7, 8, 10, 11}


# ---- embeddings ----


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def pairs(spark, *values):
    return spark.createDataFrame(list(values), "src long, dst long")


def test_draw_mask_and_revision(spark):
    e = Embedding(Graph.of(spark, 4, [(0, 1), (1, 2), (2, 0)]))
    seen = lambda: sorted(map(tuple, e.visible_pairs(pairs(spark, (0, 1), (0, 3))).collect()))
    assert e.mask_revision == 0 and seen() == [(0, 1, True), (0, 3, False)]
    e.hide_vertices(ids(spark, 1))
    assert e.mask_revision == 0 and seen() == [(0, 1, True), (0, 3, False)]  # every edge of the view, whatever its ends
    e.set_policy("both_visible")
    assert e.mask_revision == 1 and seen() == [(0, 1, False), (0, 3, True)]  # the edge need not exist
    assert sorted(map(tuple, e.visible_vertices(ids(spark, 0, 1, 9)).collect())) == [(0, True), (1, False), (9, False)]
    assert sorted(map(tuple, e.drawn_edges().collect())) == [(0, 2)]
    e.set_policy("none")
    assert seen() == [(0, 1, False), (0, 3, False)] and e.drawn_edges().isEmpty()
    e.clear_vertices()
    e.reset_mask()
    assert e.mask_revision == 3 and e.policy == "all" and e.visible_vertices(ids(spark, 1)).first().visible
    e.notify_changed()
    assert e.mask_revision == 4


def test_positions_and_highlight(spark):
    g = Graph.of(spark, 3, [(0, 1), (1, 2)])
    e = Embedding(g, dim=3)
    at = lambda rows: {r.id: r.pos for r in rows.collect()}
    moves = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (7, [9.0, 9.0, 9.0])], "id long, pos array<double>")
    e.set_positions(moves)
    e.add_positions(moves)
    assert e.count() == 3 and at(e.at(ids(spark, 0, 1))) == {0: [0.0] * 3, 1: [2.0, 4.0, 6.0]}
    with pytest.raises(ValueError):
        e.set_positions(spark.createDataFrame([(1, [1.0])], "id long, pos array<double>"))
    assert not e.has_highlight()
    e.set_highlight(View(g, ids(spark, 0, 1)))
    assert e.has_highlight() and e.highlight.vertices().count() == 2
    e.clear_highlight()
    assert e.highlight is None


def test_embeddings_grow(spark):
    from weft.operators import views as vw

    g = Graph.of(spark, 3, [(0, 1), (1, 2)])
    start = spark.createDataFrame([(0, [5.0, 5.0])], "id long, pos array<double>")
    for view in (View(g, ids(spark, 0, 1)), vw.make_edge_subset(View(g, ids(spark, 0, 1)))):
        e = Embedding(view, start)
        e.add_vertices(spark.createDataFrame([(3, "new")], "id long, data string"))
        assert e.mask_revision == 1 and {r.id for r in e.view.vertices().collect()} == {0, 1, 3}
        assert {r.id: r.pos for r in e.positions.collect()} == {0: [5.0, 5.0], 1: [0.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
        assert e.visible_vertices(ids(spark, 3)).first().visible
        e.add_edges(spark.createDataFrame([(0, 3, 0)], "o long, src long, dst long"))
        assert {(r.src, r.dst) for r in e.view.darts().collect()} == {(0, 1), (1, 0), (3, 0)} | (set() if view.is_full() else {(0, 3)})
        assert e.mask_revision == 1 + view.is_full()
        with pytest.raises(ValueError):
            e.add_vertices(spark.createDataFrame([(3, "again")], "id long, data string"))


def test_faces_as_views_and_fixed_outer_face(spark):
    e = Embedding(gen.rect_mesh(spark, 3, 4))
    e.apply_rotation()
    search = planar.FaceSearch(e.view.graph)
    found = []
    while (face := search.next()) is not None:
        view = search.subgraph()
        n = face.count()
        assert view.is_full() and view.vertices().count() == n and view.darts().count() == n
        found.append((n, view))
    assert sorted(n for n, _ in found) == [4] * 6 + [10] and search.next() is None
    for spring in (None, (40.0, 5.0)):
        t = layout.TutteLayout(e.view.graph, spring=spring)
        name = "springTutte" if spring else "tutte"
        assert f"{name}.fixOuterFace" in t.actions() and t.invoke(f"{name}.fixOuterFace") == 0 and t.positions is None  # nothing to fix yet
        with pytest.raises(RuntimeError):
            t.fix_outer_face()
        t.planar, t.highlight = True, next(view for n, view in found if n == 10)
        t.invoke(f"{name}.fixOuterFace")
        rows = {r.id: r for r in t.positions.collect()}
        assert {v for v, r in rows.items() if not r.fixed} == {5, 6} and (rows[5].x, rows[5].y) == (0.0, 0.0)
        assert all(abs(math.hypot(r.x, r.y) - 200.0) < 1e-6 for r in rows.values() if r.fixed)
        t.run(500)
        kept = {r.id: r for r in t.positions.collect()}
        t.highlight = next(view for n, view in found if n == 4)
        t.fix_outer_face()
        again = {r.id: r for r in t.positions.collect()}
        assert sum(r.fixed for r in again.values()) == 4 and all((r.x, r.y) == (kept[v].x, kept[v].y) for v, r in again.items() if not r.fixed)


def test_debug_switches(spark, monkeypatch, capsys):
    monkeypatch.setenv("WEFT_DEBUG", "knn-profile,grip-filtration")
    tr.PROFILE.reset()
    g = Graph.of(spark, 4, [(0, 1), (1, 2), (2, 3)])
    tr.k_nearest(g, ids(spark, 0, 3), 1).collect()
    assert (tr.PROFILE.queries, tr.PROFILE.visited, tr.PROFILE.most) == (2, 4, 2)
    assert "2 searches visited 4 vertices" in capsys.readouterr().err
    monkeypatch.delenv("WEFT_DEBUG")
    tr.k_nearest(g, ids(spark, 0), 1).collect()
    assert tr.PROFILE.queries == 2


def test_searches_from_the_smaller_side(spark, monkeypatch):
    g = Graph.of(spark, 20, [(0, i) for i in range(1, 20)])
    asked, whole = [], tr.k_nearest_from_seeds
    monkeypatch.setattr(tr, "k_nearest_from_seeds", lambda *a: asked.append(a) or whole(*a))
    got = tr.nearest_placed(g, ids(spark, *range(3, 20)), ids(spark, 0, 1), 1)
    assert len(asked) == 1 and {(r.id, r.dist) for r in got.collect()} == {(0, 1)}
    assert tr.nearest_placed(g, ids(spark, 3, 4), ids(spark, 0, 1), 1).count() == 2 and len(asked) == 1


# ---- trees, sessions ----


def test_tidy_tree(spark):
    g = Graph.of(spark, 7, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)], directed=True)
    p = {r.id: r for r in tidytree.tidy_tree(g).collect()}
    assert [p[k].y for k in range(7)] == [0, 1000, 1000, 2000, 2000, 2000, 2000]
    xs = [p[k].x for k in (3, 4, 5, 6)]
    assert all(b - a >= 500 for a, b in zip(xs, xs[1:], strict=False)) and p[0].x == (p[1].x + p[2].x) / 2
    chain = {r.id: (r.x, r.y) for r in tidytree.tidy_tree(Graph.of(spark, 4, [(0, 1), (1, 2), (2, 3)], directed=True)).collect()}
    assert chain == {k: (0.0, 1000.0 * k) for k in range(4)}
    for bad in (Graph.of(spark, 3, [(0, 1), (1, 2), (2, 0)], directed=True), Graph.of(spark, 3, [(0, 1), (1, 2), (0, 2)])):
        with pytest.raises(ValueError):
            tidytree.tidy_tree(bad)


def test_random_trees_do_not_overlap():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(2, 40)
        parents = {0: None, **{v: rng.randrange(v) for v in range(1, n)}}
        kids = {}
        for v in range(1, n):
            kids.setdefault(parents[v], []).append(v)
        off = tidytree.offsets(parents, kids)
        x, depth = {0: 0.0}, {0: 0}
        for v in range(1, n):
            x[v], depth[v] = x[parents[v]] + off[v], depth[parents[v]] + 1
        for d in set(depth.values()):
            row = sorted(x[v] for v in x if depth[v] == d)
            assert all(b - a >= 1 - 1e-4 for a, b in zip(row, row[1:], strict=False))


def test_session(spark):
    s, calls = Session(), []
    s.action("a", calls.append)
    s.action("b", lambda p: None)
    s.action("c", lambda p: None)
    assert s.invoke("a") == 0 and calls == [Payload()] and s.invoke("zz") == -1
    s.action("a", lambda p: calls.append("new"))
    assert s.invoke("a", Payload(delta_time=1.0)) == 0 and calls[-1] == "new"
    assert s.remove_action("a") == 0 and s.actions() == ["c", "b"] and s.remove_action("a") == -1
    s.append("x", 1)
    s.append("x", 2)
    assert s.series("x") == [1.0, 2.0] and s.revision("x") == 2 and s.add_series("x") == -1
    assert s.clear("x") == 0 and s.series("x") == [] and s.revision("x") == 3 and s.clear("none") == -1
    s.append("x", 5)
    assert [tuple(r) for r in s.series_table(spark).collect()] == [("x", 0, 5.0)]


def test_growth_stream(spark, tmp_path):
    from weft.streaming import growth

    rows = spark.createDataFrame([("2024-01-01 00:00:00", 1, 2), ("2024-01-01 00:10:00", 2, 3)], "t string, src long, dst long").selectExpr("cast(t as timestamp) ts", "src", "dst")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    growth.grow(stream, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination(60)
    assert sorted((r.src, r.dst) for r in growth.grown(spark, f"{tmp_path}/out").collect()) == [(1, 2), (2, 3)]
    degrees = growth.degree_stream(rows)
    assert {(r.id, r.degree) for r in degrees.collect()} == {(1, 1), (2, 2), (3, 1)}
