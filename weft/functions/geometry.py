"""Polygons as column expressions and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regular_polygon(ids: DataFrame, n: Column | int, radius: float, place: str = "place") -> DataFrame:
    """(id, x, y): the place-th corner of a regular n-gon around the origin."""
    angle = F.lit(2 * math.pi) * F.col(place) / n
    return ids.select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def polygon_edges(corners: DataFrame, key: str = "face_id", place: str = "place") -> DataFrame:
    """corners(key, place, x, y) with the next corner x2, y2, the last joined to the first."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(place)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return corners.select("*", F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y2"))


def signed_area(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """Aggregate: shoelace sum over a polygon's edges."""
    return F.sum(x * y2 - x2 * y) / 2.0


def crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the ray from (x, y) to the right crosses the edge."""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def inside(crossing: Column) -> Column:
    """Aggregate: even-odd rule over a polygon's edges."""
    return F.sum(F.coalesce(crossing, F.lit(False)).cast("int")) % 2 == 1
