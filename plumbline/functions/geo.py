"""Spherical and planar geometry, as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_008.8
CELLS = 1_000  # to a degree
CELL_COLUMNS = 360_001
DEGREE_METRES = 111_195


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def valid_point(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def cell_of(lat: Column, lng: Column) -> Column:
    return F.floor((lat + 90) * CELLS) * CELL_COLUMNS + F.floor((lng + 180) * CELLS)


def cells_within(lat: Column, lng: Column, metres: float) -> Column:
    """The cells of the box that holds a circle, clamped at the edges of the map."""
    up = metres / DEGREE_METRES
    wide = up / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    rows = F.sequence(F.floor((F.greatest(lat - up, F.lit(-90.0)) + 90) * CELLS), F.floor((F.least(lat + up, F.lit(90.0)) + 90) * CELLS))
    columns = F.sequence(F.floor((F.greatest(lng - wide, F.lit(-180.0)) + 180) * CELLS), F.floor((F.least(lng + wide, F.lit(180.0)) + 180) * CELLS))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: r * CELL_COLUMNS + c)))


def contains(south: Column, west: Column, north: Column, east: Column, lat: Column, lng: Column) -> Column:
    """Whether a closed viewport holds a point; west beyond east crosses the antimeridian."""
    inside = F.when(west <= east, (lng >= west) & (lng <= east)).otherwise((lng >= west) | (lng <= east))
    return (lat >= south) & (lat <= north) & inside


def centre_lng(west: Column, east: Column) -> Column:
    across = (west + east + 360) / 2
    return F.when(west <= east, (west + east) / 2).otherwise(F.when(across > 180, across - 360).otherwise(across))


def turn_between(one: Column, other: Column) -> Column:
    """Degrees from one longitude to another, the short way round."""
    by = other - one
    return F.when(by > 180, by - 360).when(by < -180, by + 360).otherwise(by)


def wrap_lng(lng: Column) -> Column:
    return F.when(lng.between(-180, 180), lng).otherwise(F.pmod(lng + 180, F.lit(360.0)) - 180)


def gaussian_decay(metres: Column, scale: Column, weight: float = 1.0, decay: float = 0.5) -> Column:
    return F.exp(F.lit(math.log(decay)) * F.pow(metres / scale, 2)) * weight


def viewport_scale(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Half the diagonal of a viewport in metres, between 2 km and 1000 km."""
    half = distance(south, west, north, F.when(west <= east, east).otherwise(east + 360)) / 2
    return F.least(F.lit(1_000_000.0), F.greatest(F.lit(2_000.0), half))


def clip(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> Column:
    """STRUCT<t0, t1> of the part of a segment inside a closed box (west, south, east, north); null if it misses."""
    west, south, east, north = (F.lit(float(v)) for v in box)
    dx, dy = x2 - x1, y2 - y1

    def span(start: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
        flat = step == 0
        outside = flat & ((start < low) | (start > high))
        a, b = (low - start) / F.when(~flat, step), (high - start) / F.when(~flat, step)
        first = F.when(outside, F.lit(2.0)).when(flat, F.lit(0.0)).otherwise(F.least(a, b))
        last = F.when(outside, F.lit(-1.0)).when(flat, F.lit(1.0)).otherwise(F.greatest(a, b))
        return first, last

    (a0, a1), (b0, b1) = span(x1, dx, west, east), span(y1, dy, south, north)
    t0, t1 = F.greatest(F.lit(0.0), a0, b0), F.least(F.lit(1.0), a1, b1)
    return F.when(t0 <= t1, F.struct(t0.alias("t0"), t1.alias("t1")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against a closed ring ARRAY<STRUCT<x, y>>."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges, crosses)) % 2 == 1


def valid_viewport(south: Column, west: Column, north: Column, east: Column) -> Column:
    ok = valid_point(south, west) & valid_point(north, east) & (south <= north) & ~((west == 180) & (east == -180))
    return F.coalesce(ok, F.lit(False))
