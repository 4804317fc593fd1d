"""Vectors and pair forces as column expressions.

A vector is a tuple of columns, one per dimension, so that whole-stage code
generation sees plain arithmetic.  d = u - v points from v to u; each force
acts on v.  Names say what a force does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]
# Below these distances a force is not defined and not applied.
TINY, TINY_SQ = 1e-9, 1e-18
#: Scale of the repulsive half of the multilevel pair force.
FINE_REPULSION = 0.05


def difference(v: Vec, u: Vec) -> list[Column]:
    return [b - a for a, b in zip(v, u, strict=True)]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm2(a: Vec) -> Column:
    return dot(a, a)


def norm(a: Vec) -> Column:
    return F.sqrt(norm2(a))


def scale(a: Vec, k) -> list[Column]:
    return [x * k for x in a]


def axpy(k, a: Vec, b: Vec) -> list[Column]:
    """k a + b."""
    return [k * x + y for x, y in zip(a, b, strict=True)]


def add_scaled_difference(acc: Vec, v: Vec, u: Vec, k) -> list[Column]:
    """acc + k (u - v)."""
    return [x + k * d for x, d in zip(acc, difference(v, u), strict=True)]


def zero(n: int) -> list[Column]:
    return [F.lit(0.0)] * n


def _unless(cond: Column, value: Vec) -> list[Column]:
    return [F.when(cond, 0.0).otherwise(x) for x in value]


def spring(v: Vec, u: Vec, hops: Column, edge: float) -> list[Column]:
    """(|d| / L - 1) d with L = hops * edge; nothing for L below 1e-9."""
    d, ideal = difference(v, u), hops * edge
    return _unless(ideal < TINY, scale(d, norm(d) / ideal - 1.0))


def fine_attraction(v: Vec, u: Vec, edge) -> list[Column]:
    """(|d|^2 / L^2) d."""
    d = difference(v, u)
    return _unless(norm2(d) < TINY_SQ, scale(d, norm2(d) / (edge * edge)))


def fine_repulsion(v: Vec, u: Vec, edge, strength: float = FINE_REPULSION) -> list[Column]:
    """-strength L^2 / |d|^2 d."""
    d = difference(v, u)
    return _unless(norm2(d) < TINY_SQ, scale(d, -strength * edge * edge / norm2(d)))


def fr_attraction(v: Vec, u: Vec, k) -> list[Column]:
    """Magnitude |d|^2 / k toward u."""
    d = difference(v, u)
    return _unless(norm2(d) < TINY_SQ, scale(d, norm(d) / k))


def _apart(v: Vec, u: Vec, magnitude: Column, v_id: Column | None, u_id: Column | None) -> list[Column]:
    """magnitude away from u; coincident points part along an angle hashed from their ids."""
    d = difference(v, u)
    r = norm(d)
    a = F.lit(0) if v_id is None else v_id
    b = F.lit(1) if u_id is None else u_id
    angle = F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(1 << 20)) / float(1 << 20) * 6.283185307179586
    side = F.when(a <= b, 1.0).otherwise(-1.0)
    away = [F.cos(angle) * side, F.sin(angle) * side, *[F.lit(0.0)] * (len(d) - 2)]
    return [F.when(r < TINY, magnitude * e).otherwise(-magnitude * x / r) for x, e in zip(d, away, strict=True)]


def fr_repulsion(v: Vec, u: Vec, k, radii=0.0, overlap: float = 100.0, weight=1.0, v_id=None, u_id=None) -> list[Column]:
    """k^2 weight / gap away from u, gap = |d| - radii; k^2 weight overlap where they touch."""
    gap = norm(difference(v, u)) - radii
    full = F.lit(1.0) * k * k * weight
    return _apart(v, u, F.when(gap <= 0, full * overlap).otherwise(full / gap), v_id, u_id)


def linlog_attraction(v: Vec, u: Vec) -> list[Column]:
    """log(1 + |d|) toward u."""
    d = difference(v, u)
    return _unless(norm2(d) < TINY_SQ, scale(d, F.log1p(norm(d)) / norm(d)))


def linlog_repulsion(v: Vec, u: Vec, v_mass, u_mass, radii=0.0, overlap: float = 100.0, v_id=None, u_id=None) -> list[Column]:
    """m1 m2 / gap away from u, with the same saturation."""
    gap = norm(difference(v, u)) - radii
    full = F.lit(1.0) * v_mass * u_mass
    return _apart(v, u, F.when(gap <= 0, full * overlap).otherwise(full / gap), v_id, u_id)


def gravity(v: Vec, strength) -> list[Column]:
    """Constant magnitude toward the origin."""
    r = norm(v)
    return _unless(r < TINY, scale(v, -F.lit(1.0) * strength / r))


def radius(degree: Column, base: float, per_degree: float) -> Column:
    return F.lit(base) * (1.0 + per_degree * F.sqrt(degree.cast("double")))


@dataclass(frozen=True)
class ForceModel:
    """Pair forces of a layout: attraction along edges, repulsion between all."""

    name: str

    def mass(self, degree: Column) -> Column:
        return F.lit(1.0) if self.name == "fr" else 1.0 + degree.cast("double")

    def attraction(self, v: Vec, u: Vec, edge) -> list[Column]:
        return fr_attraction(v, u, edge) if self.name == "fr" else linlog_attraction(v, u)

    def repulsion(self, v: Vec, u: Vec, edge, v_mass, u_mass, radii, overlap, v_id=None, u_id=None) -> list[Column]:
        if self.name == "fr":  # another body's mass counts in whole vertices
            return fr_repulsion(v, u, edge, radii, overlap, F.floor(u_mass), v_id, u_id)
        return linlog_repulsion(v, u, v_mass, u_mass, radii, overlap, v_id, u_id)


MODELS = {name: ForceModel(name) for name in ("fr", "linlog")}
