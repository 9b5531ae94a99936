"""Points on lines: ARRAY<STRUCT<lat, lng>> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.geo import distance


def _segments(points: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(i.alias("i"), points[i - 1].alias("a"), points[i].alias("b")))


def _length(s: Column) -> Column:
    return distance(s["a"]["lat"], s["a"]["lng"], s["b"]["lat"], s["b"]["lng"])


def total_length(points: Column) -> Column:
    """Metres of a line; 0 for fewer than two points."""
    return F.when(F.size(points) >= 2, F.aggregate(_segments(points), F.lit(0.0), lambda t, s: t + _length(s))).otherwise(0.0)


def between(a: Column, b: Column, t: Column) -> Column:
    mix = lambda c: (a[c] + (b[c] - a[c]) * t).alias(c)
    return F.struct(mix("lat"), mix("lng"))


def project(points: Column, lat: Column, lng: Column) -> Column:
    """STRUCT<gap, fraction, point>: the place of a line nearest to a point, in the plane at the point; the first of several."""
    shrink = F.cos(F.radians(lat))

    def one(s: Column) -> Column:
        ax, ay = (s["a"]["lng"] - lng) * shrink, s["a"]["lat"] - lat
        dx, dy = (s["b"]["lng"] - s["a"]["lng"]) * shrink, s["b"]["lat"] - s["a"]["lat"]
        square = dx * dx + dy * dy
        t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / F.when(square != 0, square))))
        at = between(s["a"], s["b"], t)
        return F.struct(distance(lat, lng, at["lat"], at["lng"]).alias("gap"), s["i"].alias("i"), t.alias("t"), at.alias("point"))

    best = F.array_min(F.transform(_segments(points), one))
    before = F.aggregate(F.filter(_segments(points), lambda s: s["i"] < best["i"]), F.lit(0.0), lambda t, s: t + _length(s))
    here = _length(F.element_at(_segments(points), best["i"]))
    whole = total_length(points)
    fraction = F.when(whole > 0, (before + best["t"] * here) / F.when(whole > 0, whole)).otherwise(0.0)
    return F.when(F.size(points) >= 2, F.struct(best["gap"].alias("gap"), fraction.alias("fraction"), best["point"].alias("point")))


def part(points: Column, start: Column, stop: Column) -> Column:
    """The points of a line from one fraction of its length to a later one, ends interpolated."""
    whole = total_length(points)
    seed = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<struct<run:double,len:double,a:struct<lat:double,lng:double>,b:struct<lat:double,lng:double>>>").alias("all"))

    def step(acc: Column, s: Column) -> Column:
        n = _length(s)
        return F.struct((acc["run"] + n).alias("run"), F.concat(acc["all"], F.array(F.struct(acc["run"].alias("run"), n.alias("len"), s["a"].alias("a"), s["b"].alias("b")))).alias("all"))

    cut = F.aggregate(_segments(points), seed, step)["all"]
    low, high = start * whole, stop * whole
    inside = F.filter(cut, lambda s: (s["run"] + s["len"] >= low) & (s["run"] <= high) & (s["len"] > 0))
    t = lambda s, metres: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (metres - s["run"]) / s["len"]))
    first = F.transform(F.slice(inside, 1, 1), lambda s: between(s["a"], s["b"], t(s, low)))
    rest = F.transform(inside, lambda s: between(s["a"], s["b"], t(s, high)))
    return F.array_distinct(F.concat(first, rest))
