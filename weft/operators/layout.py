"""Force, barycentric and spring layouts: one Spark job per round.

Positions are (id, x, y).  A round reads the last round's positions and writes
new ones (Jacobi), so it is a join with the darts, an aggregation per vertex
and a few driver scalars; each round is checkpointed.  Graphs of at most
``kernel_vertices`` run whole rounds in one task instead, where the cost of a
job would dominate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.forces import MODELS, difference, gravity, norm, radius
from weft.functions.geometry import regular_polygon
from weft.functions.pairs import ROWS_AT_ONCE, Bodies, summed
from weft.model import Graph, View
from weft.operators import quadtree
from weft.plans.session import Session
from weft.shared import materialise

KERNEL_VERTICES = 20_000
# Fixed values of the defaults and of the speed controller.
EDGE, OVERLAP, THETA, JITTER = 10.0, 100.0, 1.0, 1.0
TINY = 1e-7


def _view(g: Graph | View) -> View:
    return g if isinstance(g, View) else View(g)


def random_positions(vertices: DataFrame, box: float, dim: int = 2, seed: int = 1) -> DataFrame:
    """(id, pos): uniform in [-box, box) in each dimension, from id and seed."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 50)) / float(1 << 50)
    return vertices.select("id", F.array(*[box * (2.0 * u(k) - 1.0) for k in range(dim)]).alias("pos"))


def flat(positions: DataFrame) -> DataFrame:
    return positions.select("id", F.get("pos", F.lit(0)).alias("x"), F.get("pos", F.lit(1)).alias("y"))


# ---- force layout -----------------------------------------------------------


@dataclass(frozen=True)
class ForceConfig:
    model: str = "fr"
    edge: float = EDGE
    barnes_hut: bool = False
    theta: float = THETA
    cap: int = 4
    gravity: float = 0.0
    jitter: float = JITTER
    prevent_overlap: bool = False
    radius: float = 0.0
    radius_per_degree: float = 0.0
    overlap: float = OVERLAP
    box: float = 0.0

    def configure(self, **changes: float) -> ForceConfig:
        """0 keeps a setting, except of gravity and the radii."""
        keep = {k: v for k, v in changes.items() if v or k in ("gravity", "radius", "radius_per_degree", "barnes_hut", "prevent_overlap")}
        return replace(self, **keep)


# Fixed values of the speed controller: noise per root of the vertices, most tolerance, bounds of the efficiency,
# swinging per traction that calls for less, what the efficiency is multiplied by, speed from which it stays, most rise.
NOISE, MOST_TOLERANCE = 0.05, 10.0
LEAST_EFFICIENCY, MOST_EFFICIENCY = 0.05, 1.0
WILD, TAMED, SLOWED, SPED = 2.0, 0.5, 0.7, 1.3
FAST, RISE = 1000.0, 0.5


def tolerated(traction: float, n: int, jitter: float) -> float:
    """Swinging per traction that n vertices may have: it grows with the mean traction, within bounds."""
    ideal = NOISE * math.sqrt(n)
    return jitter * max(math.sqrt(ideal), min(MOST_TOLERANCE, ideal * traction / n**2))


@dataclass(frozen=True)
class Speed:
    """Global speed of a force layout and its efficiency, by the published ForceAtlas2 rule.

    The speed aims at the tolerated share of swinging over the one seen, and
    rises by a bounded part of itself; the efficiency falls while vertices
    swing more than is tolerated and recovers while they don't.
    """

    speed: float = 1.0
    efficiency: float = 1.0

    def less(self, factor: float) -> Speed:
        """With a lower efficiency, unless it is at its floor."""
        return replace(self, efficiency=self.efficiency * factor) if self.efficiency > LEAST_EFFICIENCY else self

    def update(self, swinging: float, traction: float, n: int, jitter: float) -> Speed:
        if traction < TINY:
            return self
        seen, allowed, now = swinging / traction, tolerated(traction, n, jitter), self
        if seen > WILD:
            allowed, now = max(allowed, jitter), now.less(TAMED)
        goal = allowed * now.efficiency / seen if swinging > TINY else self.speed
        if seen > allowed:
            now = now.less(SLOWED)
        elif self.speed < FAST:
            now = replace(now, efficiency=now.efficiency * SPED)
        return Speed(min(goal, (1.0 + RISE) * self.speed), min(MOST_EFFICIENCY, max(LEAST_EFFICIENCY, now.efficiency)))


def edge_attraction(darts: DataFrame, positions: DataFrame, model: str, edge: float) -> DataFrame:
    """(id, ax, ay): attraction along the darts of each vertex."""
    a = positions.select(F.col("id").alias("src"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    b = positions.select(F.col("id").alias("dst"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    f = MODELS[model].attraction([F.col("vx"), F.col("vy")], [F.col("ux"), F.col("uy")], edge)
    return darts.join(a, "src").join(b, "dst").select(F.col("src").alias("id"), f[0].alias("ax"), f[1].alias("ay")).groupBy("id").agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))


#: Bodies of a block of the exact sums; bodies from which those without a radius are summed by far cells' expansions.
BLOCK, EXPANDED = 2048, 32_768


def exact_repulsion(bodies: DataFrame, model: str, edge: float, overlap: float) -> DataFrame:
    """(id, fx, fy) from all pairs of bodies(id, x, y, mass, radius).

    Bodies are dealt to blocks by a hash of their ids; every pair of blocks is
    summed in a task and gives a row per body, so pairs are never rows.  That
    is quadratic; more than ``EXPANDED`` bodies, none with a radius, are summed
    by quadtree.point_repulsion, which agrees within rounding.
    """
    spark = bodies.sparkSession
    own = materialise(bodies.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "mass", "radius")]))
    count, widest = own.agg(F.count(F.lit(1)), F.max(F.abs("radius"))).first()
    if count > EXPANDED and widest == 0.0:
        return quadtree.point_repulsion(own, MODELS[model], edge, overlap)
    n = max(1, -(-count // BLOCK))
    blocks = own.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "x", "y", "mass", "radius")).alias("rows"))
    fields = lambda side: [F.col("block").alias(f"{side}_block"), *[F.col(f"rows.{c}").alias(f"{side}_{c}") for c in ("id", "x", "y", "mass", "radius")]]
    blocks = materialise(blocks)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = blocks.select(*fields("v")).crossJoin(blocks.select(*fields("u"))).repartition(parts, "v_block", "u_block")

    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                yield _block_forces(r, model, edge, overlap)

    return pairs.mapInPandas(run, "id long, fx double, fy double").groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def _block_forces(r, model: str, edge: float, overlap: float) -> pd.DataFrame:
    """Forces of a block of bodies u on one of bodies v."""
    v, u = (Bodies(*[getattr(r, f"{side}_{c}") for c in ("id", "x", "y", "mass", "radius")]) for side in "vu")
    ids, out = [], []
    for at in range(0, len(v), ROWS_AT_ONCE):
        rows = v.take(slice(at, at + ROWS_AT_ONCE))
        other = rows.id[:, None] != u.id[None, :]
        some = other.any(1)
        ids.append(rows.id[some])
        out.append(summed(rows, u, other, model, edge, overlap)[some])
    f = np.concatenate(out)
    return pd.DataFrame({"id": np.concatenate(ids), "fx": f[:, 0], "fy": f[:, 1]})


def touching(bodies: DataFrame) -> DataFrame:
    """(id, n_touching) of bodies(id, x, y, radius) that touch another.

    Squares as wide as two of the largest bodies: what touches lies in one
    square or in neighbouring ones.
    """
    wide = bodies.agg(F.max("radius")).first()[0] or 0.0
    wide = 2.0 * wide * (1 + 1e-9) or 1e-9
    placed = bodies.select("id", "x", "y", "radius", F.floor(F.col("x") / wide).alias("i"), F.floor(F.col("y") / wide).alias("j"))
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    o = placed.select(F.col("id").alias("u_id"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("radius").alias("u_radius"), "i", F.col("j"), F.explode(near).alias("di"))
    o = o.select("u_id", "ux", "uy", "u_radius", (F.col("i") + F.col("di")).alias("i"), F.col("j"), F.explode(near).alias("dj")).withColumn("j", F.col("j") + F.col("dj"))
    gap = norm(difference([F.col("x"), F.col("y")], [F.col("ux"), F.col("uy")])) - F.col("radius") - F.col("u_radius")
    return placed.join(o, ["i", "j"]).where("id <> u_id").where(gap <= 0).groupBy("id").agg(F.count(F.lit(1)).alias("n_touching"))


class ForceLayout(Session):
    """Attraction along edges, repulsion between all vertices, gravity."""

    def __init__(self, g: Graph | View, config: ForceConfig | None = None):
        super().__init__()
        self.view, self.config, self.speed, self.positions = _view(g), config or ForceConfig(), Speed(), None
        self.old = None
        degrees = materialise(self.view.degrees())
        model = MODELS[self.config.model]
        r = radius(F.col("degree"), self.config.radius, self.config.radius_per_degree) if self.config.prevent_overlap else F.lit(0.0)
        self.bodies = materialise(degrees.select("id", "degree", model.mass(F.col("degree")).alias("mass"), r.alias("radius")))
        self.darts = materialise(self.view.darts())
        self.n, mean = self.bodies.agg(F.count(F.lit(1)), F.avg(F.col("degree") + 1)).first()
        self.mean_degree_plus_one = mean or 0.0
        self.action("forceEmbedder.step", lambda p: self.step() if self.positions is not None else None)
        self.action("forceEmbedder.toggleOverlapPrevention", lambda p: self.toggle_overlap())

    def toggle_overlap(self) -> None:
        self.config = replace(self.config, prevent_overlap=not self.config.prevent_overlap)
        r = radius(F.col("degree"), self.config.radius, self.config.radius_per_degree) if self.config.prevent_overlap else F.lit(0.0)
        self.bodies = materialise(self.bodies.withColumn("radius", r))

    def begin(self, seed: int = 1, positions: DataFrame | None = None) -> ForceLayout:
        box = self.config.box or (0.5 * math.sqrt(self.n) * self.config.edge if self.n else self.config.edge)
        start = flat(random_positions(self.bodies, box, 2, seed)) if positions is None else positions
        self.positions = materialise(start.select("id", "x", "y"))
        self.old = None
        self.speed = Speed()
        return self

    def forces(self) -> DataFrame:
        """(id, x, y, mass, ax, ay, rx, ry, gx, gy) at the present positions."""
        c = self.config
        bodies = materialise(self.positions.join(self.bodies, "id"))
        attract = edge_attraction(self.darts, self.positions, c.model, c.edge)
        if c.barnes_hut:
            repel = quadtree.repulsion(bodies, MODELS[c.model], c.edge, c.theta, c.overlap, c.cap)
        else:
            repel = exact_repulsion(bodies, c.model, c.edge, c.overlap)
        out = bodies.join(attract, "id", "left").join(repel, "id", "left")
        z = lambda n: F.coalesce(n, F.lit(0.0))
        g = gravity([F.col("x"), F.col("y")], c.gravity * (F.col("degree") + 1))
        return out.select("id", "x", "y", "mass", z("ax").alias("ax"), z("ay").alias("ay"), z("fx").alias("rx"), z("fy").alias("ry"), g[0].alias("gx"), g[1].alias("gy"))

    def step(self) -> float:
        """One round; the greatest displacement."""
        if self.positions is None:
            raise RuntimeError("begin() first")
        f = self.forces().withColumn("sx", F.col("ax") + F.col("rx")).withColumn("sy", F.col("ay") + F.col("ry"))
        if self.old is None:
            f = f.withColumn("ox", F.lit(0.0)).withColumn("oy", F.lit(0.0))
        else:
            f = f.join(self.old, "id")
        swing = F.col("mass") * norm([F.col("sx") - F.col("ox"), F.col("sy") - F.col("oy")])
        pull = F.col("mass") * 0.5 * norm([F.col("sx") + F.col("ox"), F.col("sy") + F.col("oy")])
        f = materialise(f.withColumn("swing", swing).withColumn("pull", pull))
        mags = f.agg(F.sum("swing"), F.sum("pull"), F.avg(norm([F.col("ax"), F.col("ay")])), F.avg(norm([F.col("rx"), F.col("ry")]))).first()
        self.speed = self.speed.update(mags[0] or 0.0, mags[1] or 0.0, self.n, self.config.jitter)
        s = self.speed.speed
        k = F.lit(s) / (1.0 + F.sqrt(F.lit(s) * F.col("swing")))
        moved = materialise(f.select("id", "x", "y", "sx", "sy", ((F.col("sx") + F.col("gx")) * k).alias("dx"), ((F.col("sy") + F.col("gy")) * k).alias("dy")))
        most = moved.agg(F.max(norm([F.col("dx"), F.col("dy")]))).first()[0] or 0.0
        self.positions = moved.select("id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
        self.old = moved.select("id", F.col("sx").alias("ox"), F.col("sy").alias("oy"))
        for name, value in (("maxDisp", most), ("speed", s), ("attractiveForce", mags[2] or 0.0), ("repulsiveForce", mags[3] or 0.0), ("gravityForce", self.config.gravity * self.mean_degree_plus_one)):
            self.append(f"forceEmbedder.{name}", value)
        return most

    def run(self, rounds: int, eps: float) -> int:
        """Rounds until no vertex moves by eps; the number done."""
        if self.positions is None:
            raise RuntimeError("begin() first")
        for k in range(rounds):
            if self.step() < eps:
                return k + 1
        return rounds


# ---- barycentric and spring layouts ------------------------------------------


def seed_interior(vertices: DataFrame, boundary: DataFrame) -> DataFrame:
    """(id, x, y, fixed): boundary vertices in place, the rest at the boundary's centroid."""
    centre = boundary.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    b = boundary.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    out = vertices.select("id").join(b, F.col("id") == F.col("b_id"), "left").crossJoin(F.broadcast(centre))  # one row
    fixed = F.col("b_id").isNotNull()
    return out.select("id", F.when(fixed, F.col("bx")).otherwise(F.col("mx")).alias("x"), F.when(fixed, F.col("by")).otherwise(F.col("my")).alias("y"), fixed.alias("fixed"))


def barycentres(darts: DataFrame, positions: DataFrame) -> DataFrame:
    """(b_id, mx, my): mean position of each vertex's neighbours."""
    p = positions.select(F.col("id").alias("dst"), "x", "y")
    return darts.join(p, "dst").groupBy(F.col("src").alias("b_id")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))


def relax(darts: DataFrame, positions: DataFrame, alpha: float) -> DataFrame:
    """One Jacobi round: free vertices with neighbours go alpha of the way to their mean."""
    joined = positions.join(barycentres(darts, positions), F.col("id") == F.col("b_id"), "left")
    free = ~F.col("fixed") & F.col("b_id").isNotNull()
    go = lambda a, m: F.when(free, F.col(a) + alpha * (F.col(m) - F.col(a))).otherwise(F.col(a))
    return joined.select("id", go("x", "mx").alias("x"), go("y", "my").alias("y"), "fixed", F.col("x").alias("x0"), F.col("y").alias("y0"))


@dataclass
class Pinned:
    """Arrays of one graph for whole runs in a task."""

    xy: np.ndarray
    fixed: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    velocity: np.ndarray = field(default=None)

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.xy)
        d = np.bincount(self.src, minlength=n)
        m = np.stack([np.bincount(self.src, weights=self.xy[self.dst, k], minlength=n) for k in (0, 1)], 1)
        free = ~self.fixed & (d > 0)
        return np.where(free[:, None], m / np.maximum(d, 1)[:, None], self.xy), free

    def jacobi(self, alpha: float) -> float:
        m, _ = self.means()
        step = alpha * (m - self.xy)
        self.xy = self.xy + step
        return float(np.sqrt((step**2).sum(1)).max(initial=0.0))

    def gauss_seidel(self, alpha: float, lists: list[np.ndarray]) -> float:
        most = 0.0
        for v in np.flatnonzero(~self.fixed):
            if len(lists[v]):
                step = alpha * (self.xy[lists[v]].mean(0) - self.xy[v])
                self.xy[v] += step
                most = max(most, float(np.hypot(*step)))
        return most

    def spring(self, stiffness: float, damping: float, dt: float) -> float:
        m, free = self.means()
        a = stiffness * (m - self.xy) - damping * self.velocity
        self.velocity = np.where(free[:, None], self.velocity + dt * a, 0.0)
        step = dt * self.velocity
        self.xy = self.xy + step
        return float(np.sqrt((step**2).sum(1)).max(initial=0.0))


def _pinned(frame: pd.DataFrame) -> tuple[np.ndarray, Pinned]:
    """Rows of kind v (id, x, y, fixed) and kind d (id -> other)."""
    v = frame[frame.other.isna()].sort_values("id")
    d = frame[~frame.other.isna()]
    ids = v.id.to_numpy(np.int64)
    at = lambda c: np.searchsorted(ids, c.to_numpy(np.int64))
    xy = v[["x", "y"]].to_numpy(float)
    return ids, Pinned(xy, v.fixed.to_numpy(bool), at(d.id), at(d.other), np.zeros_like(xy))


class TutteLayout(Session):
    """Barycentric layout with a pinned boundary.

    Convergence is a displacement below ``eps``, in both forms; ``spring``
    gives vertices velocities (semi-implicit Euler) instead of plain relaxation.
    """

    def __init__(self, g: Graph | View, eps: float = 1e-5, rate: float = 5.0, spring: tuple[float, float] | None = None, kernel_vertices: int = KERNEL_VERTICES):
        super().__init__()
        self.view, self.eps, self.rate, self.spring, self.kernel_vertices = _view(g), eps, rate, spring, kernel_vertices
        self.darts = materialise(self.view.darts())
        self.vertices = materialise(self.view.vertices().select("id"))
        self.n = self.vertices.count()
        self.positions = self.velocity = None
        self.planar, self.highlight = False, None
        name = "springTutte" if spring else "tutte"
        self.series_name = f"{name}.maxDelta"
        self.add_series(self.series_name, "line_log")
        self.action(f"{name}.fixOuterFace", lambda p: self.fix_outer_face() if self.planar and self.highlight is not None else None)
        self.action(f"{name}.step", lambda p: self.step(p.delta_time or 1 / 60) if self.positions is not None else None)

    def set_boundary(self, boundary: DataFrame) -> TutteLayout:
        """boundary(id, x, y): three known vertices at least; the interior is seeded."""
        boundary = materialise(boundary.join(self.vertices, "id", "left_semi").select("id", "x", "y"))
        if boundary.count() < 3:
            raise ValueError("a boundary has three vertices at least")
        self.positions = materialise(seed_interior(self.vertices, boundary))
        self.velocity = None
        return self

    def fix_polygon(self, corners: DataFrame, n: int, size: float = 200.0) -> TutteLayout:
        """corners(id, place) on a regular n-gon."""
        return self.set_boundary(regular_polygon(corners, n, size))

    def fix_outer_face(self, size: float = 200.0) -> TutteLayout:
        """Pins the cycle around the highlighted view to a polygon; all other vertices are free where they are.

        The graph's lists are a planar rotation (``planar``) and a view is
        highlighted, such as a face.
        """
        from weft.operators.planar import boundary_cycle

        if not self.planar or self.highlight is None:
            raise RuntimeError("a planar rotation and a highlighted view first")
        cycle = boundary_cycle(self.highlight)
        corners = regular_polygon(cycle, cycle.count(), size).select(F.col("id").alias("c_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
        if self.positions is None:
            self.positions = self.vertices.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(False).alias("fixed"))
        pinned = F.col("c_id").isNotNull()
        joined = self.positions.join(corners.dropDuplicates(["c_id"]), F.col("id") == F.col("c_id"), "left")
        self.positions = materialise(joined.select("id", F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"), pinned.alias("fixed")))
        self.velocity = None
        return self

    def step(self, dt: float) -> float:
        """One round of length dt; the greatest displacement."""
        if self.spring is None:
            moved = materialise(relax(self.darts, self.positions, min(1.0, max(0.0, self.rate * dt))))
        else:
            moved = materialise(self._spring_round(dt))
            self.velocity = moved.select("id", "vx", "vy")
        most = moved.agg(F.max(norm([F.col("x") - F.col("x0"), F.col("y") - F.col("y0")]))).first()[0] or 0.0
        self.positions = moved.select("id", "x", "y", "fixed")
        self.append(self.series_name, most)
        return most

    def _spring_round(self, dt: float) -> DataFrame:
        k, c = self.spring
        p = self.positions
        p = p.withColumn("vx", F.lit(0.0)).withColumn("vy", F.lit(0.0)) if self.velocity is None else p.join(self.velocity, "id")
        joined = p.join(barycentres(self.darts, self.positions), F.col("id") == F.col("b_id"), "left")
        free = ~F.col("fixed") & F.col("b_id").isNotNull()
        v = lambda a, m, u: F.when(free, F.col(u) + dt * (k * (F.col(m) - F.col(a)) - c * F.col(u))).otherwise(0.0)
        out = joined.select("id", "x", "y", "fixed", v("x", "mx", "vx").alias("vx"), v("y", "my", "vy").alias("vy"))
        return out.select("id", (F.col("x") + dt * F.col("vx")).alias("x"), (F.col("y") + dt * F.col("vy")).alias("y"), "fixed", "vx", "vy", F.col("x").alias("x0"), F.col("y").alias("y0"))

    def run(self, rounds: int, dt: float | None = None, gauss_seidel: bool = False) -> int:
        """Rounds until the displacement is below eps; the number done (a full relaxation each, unless dt is given)."""
        if self.positions is None:
            raise RuntimeError("a boundary first")
        dt = (1.0 if self.spring is None else 1 / 60) if dt is None else dt
        if self.n > self.kernel_vertices and not gauss_seidel:
            for k in range(rounds):
                if self.step(dt) < self.eps:
                    return k + 1
            return rounds
        alpha, spring, eps = min(1.0, max(0.0, self.rate * dt)), self.spring, self.eps

        def whole(frame: pd.DataFrame) -> pd.DataFrame:
            ids, p = _pinned(frame)
            lists = []
            if gauss_seidel:
                order = np.argsort(p.src, kind="stable")
                lists = np.split(p.dst[order], np.cumsum(np.bincount(p.src, minlength=len(ids)))[:-1])
            done, most = rounds, 0.0
            for k in range(rounds):
                most = p.spring(*spring, dt) if spring else p.gauss_seidel(alpha, lists) if gauss_seidel else p.jacobi(alpha)
                if most < eps:
                    done = k + 1
                    break
            return pd.DataFrame({"id": ids, "x": p.xy[:, 0], "y": p.xy[:, 1], "fixed": p.fixed, "done": done, "most": most})

        none = F.lit(None).cast("long").alias("other")
        rows = self.positions.select("id", "x", "y", "fixed", none).unionByName(self.darts.select(F.col("src").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(False).alias("fixed"), F.col("dst").alias("other")))
        out = materialise(rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(whole, "id long, x double, y double, fixed boolean, done int, most double"))
        self.positions = out.select("id", "x", "y", "fixed")
        done, most = out.agg(F.max("done"), F.max("most")).first()
        self.append(self.series_name, most or 0.0)
        return done or 0


def tutte_layout(g: Graph, size: float = 200.0, eps: float = 1e-5, spring: tuple[float, float] | None = None) -> TutteLayout:
    """Rotation, largest face on a polygon, interior seeded: ready to run."""
    from weft.operators.planar import apply_rotation, faces, largest_face

    rotated = apply_rotation(g)
    face = materialise(largest_face(faces(rotated)).select(F.posexplode("verts").alias("place", "id")))
    found = TutteLayout(rotated, eps, spring=spring).fix_polygon(face, face.count(), size)
    found.planar = True
    return found
