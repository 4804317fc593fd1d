"""Registered queries take in every row of their tables; brute force on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import queries, queries_layout
from weft.functions import forces
from weft.operators import layout, quadtree


def brute(pts, fr):
    """(fx, fy) of points (id, x, y, label), masses 1 + label % 3, radii 0.01."""
    out = {}
    for i, x, y, a in pts:
        fx = fy = 0.0
        for j, u, v, b in pts:
            if i != j:
                m, n, r = 1.0 + a % 3, 1.0 + b % 3, math.hypot(u - x, v - y)
                full = 0.01 * n if fr else m * n
                k = full * 100.0 if r - 0.02 <= 0 else full / (r - 0.02)
                fx, fy = fx - k * (u - x) / r, fy - k * (v - y) / r
        out[i] = (fx, fy)
    return out


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    """A folder whose embeddings reach ids far above 200."""
    folder, rng = tmp_path_factory.mktemp("whole"), random.Random(5)
    pts = [(k * 37, rng.randrange(1024) / 1024, rng.randrange(1024) / 1024, k % 7) for k in range(90)]
    pts.append((99_999, pts[0][1] + 0.0078125, pts[0][2], 2))
    frame = spark.createDataFrame([(i, [x, y, 0.0], a) for i, x, y, a in pts], "vec_id long, embedding array<float>, label int")
    frame.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), pts


@pytest.mark.parametrize(("name", "fr"), [("fr_forces_exact", True), ("linlog_forces", False), ("barnes_hut_theta_0", True)])
def test_forces_of_all_points(spark, spread, name, fr):
    folder, pts = spread
    got = {r.id: (r.fx, r.fy) for r in queries.QUERIES[name](spark, folder).collect()}
    want = brute(pts, fr)
    assert got.keys() == want.keys()
    assert all(abs(g - w * 100) <= 0.5001 for k in want for g, w in zip(got[k], want[k]))


def test_barnes_hut_step_and_touching_take_all_points(spark, spread):
    folder, pts = spread
    assert {r.id for r in queries.QUERIES["barnes_hut_step"](spark, folder).collect()} == {p[0] for p in pts}
    want = {i: n for i, x, y, _ in pts if (n := sum(i != j and math.hypot(u - x, v - y) - 0.02 <= 0 for j, u, v, _ in pts))}
    assert {r.id: r.n_touching for r in queries.QUERIES["overlap_saturation"](spark, folder).collect()} == want and 99_999 in want


@pytest.mark.parametrize("model", ["fr", "linlog"])
def test_blocks_sum_as_pairs_do(spark, monkeypatch, model):
    monkeypatch.setattr(layout, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(k - 20, rng.randrange(6) / 4, rng.randrange(6) / 4, 1 + rng.random() * 3, rng.random() / 4) for k in range(60)]  # many coincide
    bodies = spark.createDataFrame(rows, "id long, x double, y double, mass double, radius double")
    got = {r.id: (r.fx, r.fy) for r in layout.exact_repulsion(bodies, model, 0.3, 10.0).collect()}
    o = bodies.toDF("u_id", "ux", "uy", "u_mass", "u_radius")
    c = F.col
    f = forces.MODELS[model].repulsion([c("x"), c("y")], [c("ux"), c("uy")], 0.3, c("mass"), c("u_mass"), c("radius") + c("u_radius"), 10.0, c("id"), c("u_id"))
    pairs = bodies.crossJoin(o).where("id <> u_id").groupBy("id").agg(F.sum(f[0]).alias("fx"), F.sum(f[1]).alias("fy"))
    want = {r.id: (r.fx, r.fy) for r in pairs.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)
    assert layout.exact_repulsion(bodies.limit(1), model, 0.3, 10.0).count() == 0


def test_searches_start_at_every_twentieth_vertex(spark, tmp_path):
    rng = random.Random(8)
    sold = sorted({(rng.randrange(60), rng.randrange(120)) for _ in range(260)})
    spark.createDataFrame(sold, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    lists = {}
    for s, p in sold:  # sorted, as the darts of a vertex are
        lists.setdefault(s, []).append(p + 1_000_000)
        lists.setdefault(p + 1_000_000, []).append(s)
    nearest, within, bits = set(), set(), []
    for source in [v for v in lists if v % 20 == 0]:
        dist, queue = {source: 0}, [source]
        for v in queue:
            for u in lists[v]:
                if u not in dist:
                    dist[u] = dist[v] + 1
                    queue.append(u)
        hits = [v for v in queue[1:] if v % 3 == 0 and v < 1_000_000][:8]
        nearest |= {(source, k + 1, v, dist[v]) for k, v in enumerate(hits)}
        within |= {(source, v, dist[v]) for v in queue[1:] if dist[v] <= 2}
    for v in sorted(lists):
        bits += [(v, k, u) for k, u in enumerate(lists[v])]
    run = lambda name: sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("knn_filtered") == sorted(nearest) and any(s >= 1_000_000 for s, *_ in nearest)
    assert run("within_radius") == sorted(within) and any(s >= 1_000_000 for s, *_ in within)
    assert run("dart_from_bit") == [(bit, *dart) for bit, dart in enumerate(bits)]


def walked(pts, theta, cap, edge, overlap):
    """(fx, fy) by a plain walk of a plain quadtree over points (id, x, y, mass, radius); model fr."""

    def cell(own, cx, cy, half):
        mass = sum(p[3] for p in own)
        com = tuple(sum(p[3] * p[c] for p in own) / mass for c in (1, 2))
        if len(own) <= cap or half <= quadtree.MIN_HALF:
            return mass, com, half, own, []
        kids, h = {}, half / 2
        for p in own:
            kids.setdefault((p[1] >= cx, p[2] >= cy), []).append(p)
        return mass, com, half, None, [cell(k, cx + (h if e else -h), cy + (h if n else -h), h) for (e, n), k in kids.items()]

    xs, ys = [p[1] for p in pts], [p[2] for p in pts]
    root = cell(pts, (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2, max(max(xs) - min(xs), max(ys) - min(ys)) / 2)

    def force(p, x, y, mass, radii):
        d = math.hypot(x - p[1], y - p[2])
        full = edge * edge * math.floor(mass)
        k = (full * overlap if d - radii <= 0 else full / (d - radii)) / d
        return np.array([-k * (x - p[1]), -k * (y - p[2])])

    def walk(p, c):
        mass, com, half, own, kids = c
        if own is not None:
            return sum((force(p, u[1], u[2], u[3], p[4] + u[4]) for u in own if u[0] != p[0]), np.zeros(2))
        if 2 * half < theta * math.hypot(com[0] - p[1], com[1] - p[2]):
            return force(p, *com, mass, p[4])
        return sum((walk(p, k) for k in kids), np.zeros(2))

    return {p[0]: walk(p, root) for p in pts}


@pytest.mark.parametrize("theta", [0.0, 0.8, 1.7])
def test_tree_walk_by_blocks_is_the_walk_of_each_body(spark, monkeypatch, theta):
    """The tree's tables stay in proportion to the bodies, and forces are those of a plain walk."""
    monkeypatch.setattr(quadtree, "CHUNK", 32)
    rng, held, put = random.Random(11), [], quadtree.materialise
    pts = [(k * 3, rng.gauss(0, 1) ** 3, rng.gauss(0, 1), float(1 + k % 3), 0.01) for k in range(400)]

    def counted(df):
        held.append((out := put(df)).count())
        return out

    monkeypatch.setattr(quadtree, "materialise", counted)
    bodies = spark.createDataFrame(pts, "id long, x double, y double, mass double, radius double")
    got = {r.id: np.array([r.fx, r.fy]) for r in quadtree.repulsion(bodies, forces.MODELS["fr"], 0.1, theta, 100.0).collect()}
    want = walked(pts, theta, 4, 0.1, 100.0)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)
    assert max(held) <= 8 * len(pts)  # blocks by chunks, not bodies by cells


def test_coincident_bodies_of_many_blocks_part(spark, monkeypatch):
    monkeypatch.setattr(quadtree, "CHUNK", 8)
    bodies = spark.createDataFrame([(k, 0.5, 0.5, 1.0, 0.0) for k in range(40)] + [(99, 0.5 + 8e-9, 0.5, 1.0, 0.0)], "id long, x double, y double, mass double, radius double")
    tree = {r.id: (r.fx, r.fy) for r in quadtree.repulsion(bodies, forces.MODELS["fr"], 0.3, 0.0, 10.0).collect()}
    exact = {r.id: (r.fx, r.fy) for r in layout.exact_repulsion(bodies, "fr", 0.3, 10.0).collect()}
    assert tree.keys() == exact.keys() and all(np.allclose(tree[k], exact[k], rtol=1e-9, atol=1e-9) for k in exact)
