"""Spatial tests of a feature's geometry against a constant, as Column expressions.

The window test compares four plain columns, so Parquet statistics skip files. The exact test comes after it. The constant's edges
are one array literal, dealt to horizontal slabs, so the expression has the same size for any constant and a row's
segment meets only the edges at its own height.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Geometry

#: Edges of a slab, about; and how many times an edge may be listed on average.
PER_SLAB, REPEATS = 8, 12
EDGE = "struct<ax:double,ay:double,bx:double,by:double,area:int>"


def overlaps_window(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Envelopes overlap or touch."""
    return (F.col("xmin") <= float(xmax)) & (F.col("xmax") >= float(xmin)) & (F.col("ymin") <= float(ymax)) & (F.col("ymax") >= float(ymin))


#: Bits of a curve's cell on each axis, and the steps that put a zero before each of them.
_AXIS = 31
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def curve(x: Column, y: Column, extent: tuple[float, float, float, float]) -> Column:
    """The place of a point on a space-filling curve (cells in Z-order) over the extent; points outside count as at its border."""

    def spread(v: Column, low: float, high: float) -> Column:
        scale = (2**_AXIS - 1) / (high - low) if high > low else 0.0
        cell = F.least(F.lit(2**_AXIS - 1), F.greatest(F.lit(0), F.floor((v - F.lit(low)) * F.lit(scale)).cast("bigint")))
        for by, mask in _SPREAD:
            cell = cell.bitwiseOR(F.shiftleft(cell, by)).bitwiseAND(F.lit(mask))
        return cell

    xmin, ymin, xmax, ymax = extent
    return spread(x, xmin, xmax).bitwiseOR(F.shiftleft(spread(y, ymin, ymax), 1))


def segments(rings: Column) -> Column:
    """All segments (a, b) of an array of rings; a lone vertex is a segment of length 0."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    of = lambda r: F.when(F.size(r) == 1, F.transform(r, lambda v: pair(v, v))).otherwise(F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), pair))
    return F.flatten(F.transform(rings, of))


#: The most that the rounded cross product may be wrong, as a share of its two products' sizes; and the factor that halves a double's digits.
_ERROR, _HALF = (3 + 16 * 2.0**-53) * 2.0**-53, 2.0**27 + 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _rest_of_sum(a: Column, b: Column, s: Column) -> Column:
    """What a rounded sum s of a and b lacks, exactly."""
    return (a - (s - (s - a))) + (b - (s - a))


def _rest_of_product(p: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """What a rounded product p lacks, exactly, from the factors' halves."""
    return a[1] * b[1] - (((p - a[0] * b[0]) - a[1] * b[0]) - a[0] * b[1])


def _halves(x: Column) -> Column:
    return _let(x * _HALF, lambda c: F.struct((c - (c - x)).alias("high"), (x - (c - (c - x))).alias("low")))


def _sign_of_sum(values: Column) -> Column:
    """The sign of the exact sum of an array of doubles, kept as an expansion: doubles of growing size whose digits don't overlap."""

    def add(expansion: Column, b: Column) -> Column:
        start = F.struct(b.alias("q"), F.array().cast("array<double>").alias("out"))
        step = lambda s, x: _let(s["q"] + x, lambda q: F.struct(q.alias("q"), F.concat(s["out"], F.array(_rest_of_sum(s["q"], x, q))).alias("out")))
        return F.aggregate(expansion, start, step, lambda s: F.concat(s["out"], F.array(s["q"])))

    expansion = F.aggregate(values, F.array().cast("array<double>"), add)
    return F.aggregate(expansion, F.lit(0.0), lambda last, x: F.when(x != 0, F.signum(x)).otherwise(last))


def _exact_side(ax, ay, bx, by, px, py) -> Column:
    minus = lambda a, b: _let(a - b, lambda d: F.struct(d.alias("d"), _rest_of_sum(a, -b, d).alias("rest")))

    def product(x: Column, y: Column) -> Column:
        both = F.struct((x * y).alias("p"), _halves(x).alias("x"), _halves(y).alias("y"))
        return _let(both, lambda s: F.array(s["p"], _rest_of_product(s["p"], (s["x"]["high"], s["x"]["low"]), (s["y"]["high"], s["y"]["low"]))))

    def products(d: Column) -> Column:
        pairs = [(d[k][i] * sign, d[j][n]) for k, j, sign in ((0, 1, 1.0), (2, 3, -1.0)) for i in ("d", "rest") for n in ("d", "rest")]
        return F.flatten(F.transform(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pairs]), lambda p: product(p["x"], p["y"])))

    differences = F.array(minus(bx, ax), minus(py, ay), minus(by, ay), minus(px, ax))
    return _sign_of_sum(_let(differences, products))


def side(ax, ay, bx, by, px, py) -> Column:
    """The side of the line a-b that p is on: 1 left, -1 right, 0 on it.

    Exact: where rounding leaves the sign open, it is found from all digits. Products of coordinates must stay within 1e-290 and 1e290.
    """
    left, right = (bx - ax) * (py - ay), (by - ay) * (px - ax)
    certain = (F.abs(left - right) > _ERROR * (F.abs(left) + F.abs(right))) | (left == 0) | (right == 0)
    return F.when(certain, F.signum(left - right)).otherwise(_exact_side(ax, ay, bx, by, px, py))


def _meet(s: Column, e: Column) -> Column:
    """Whether the row's segment and the constant's edge share a point."""
    ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
    cx, cy, dx, dy = e["ax"], e["ay"], e["bx"], e["by"]
    apart = (F.greatest(ax, bx) < F.least(cx, dx)) | (F.least(ax, bx) > F.greatest(cx, dx)) | (F.greatest(ay, by) < F.least(cy, dy)) | (F.least(ay, by) > F.greatest(cy, dy))
    sides = side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) <= 0
    back = side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) <= 0
    return ~apart & sides & back


def _ray(ax, ay, bx, by, px, py) -> Column:
    """Whether the ray from p to the right crosses the edge a-b; no division."""
    up = by > ay
    return ((ay > py) != (by > py)) & ((side(ax, ay, bx, by, px, py) > 0) == up)


@dataclass(frozen=True)
class Slabs:
    """A constant's edges by height: slab k has those that reach into it. Heights beyond the constant fall to the outer slabs."""

    low: float
    scale: float
    edges: list[list[tuple]]

    @classmethod
    def of(cls, edges: list[tuple]) -> Slabs:
        low, high = min(min(e[1], e[3]) for e in edges), max(max(e[1], e[3]) for e in edges)
        count = max(1, len(edges) // PER_SLAB)
        while True:
            scale = count / (high - low) if high > low else 0.0
            reach = [sorted((cls._number(e[1], low, scale, count), cls._number(e[3], low, scale, count))) for e in edges]
            if count == 1 or (math.isfinite(scale) and sum(b - a + 1 for a, b in reach) <= REPEATS * len(edges)):
                break
            count //= 2
        out: list[list[tuple]] = [[] for _ in range(count)]
        for e, (a, b) in zip(edges, reach, strict=True):
            for k in range(a, b + 1):
                out[k].append(e)
        return cls(low, scale, out)

    @staticmethod
    def _number(y: float, low: float, scale: float, count: int) -> int:
        return min(count - 1, max(0, math.floor((y - low) * scale)))

    def number(self, y: Column) -> Column:
        """The slab at a height; the same arithmetic as for the edges, so it grows with y alike."""
        return F.least(F.lit(len(self.edges) - 1), F.greatest(F.lit(0), F.floor((y - F.lit(self.low)) * F.lit(self.scale)).cast("int")))

    def literal(self) -> Column:
        """The slabs as an array of arrays; folded to a constant."""
        return F.from_json(F.lit(json.dumps([[dict(zip(("ax", "ay", "bx", "by", "area"), e, strict=True)) for e in s] for s in self.edges])), f"array<array<{EDGE}>>")


def _edges(geometry: Geometry) -> list[tuple]:
    """(ax, ay, bx, by, area): boundary edges, and the number of the area they belong to, -1 for none; a point is an edge of length 0."""
    out = []
    for k, (kind, rings) in enumerate(geometry.parts):
        for ring in rings:
            for a, b in list(zip(ring, ring[1:], strict=False)) or [(v, v) for v in ring]:
                out.append((*(float(c) for c in (a[0], a[1], b[0], b[1])), k if kind == "A" else -1))
    return out


def intersects_constant(geometry: Geometry, column: str = "geometry") -> Column:
    """Exact intersection, boundary included, of the geometry column with a constant; false if either is empty.

    Needs the columns xmin, ymin, xmax, ymax. A row that names another reference system than the constant fails the query.
    """
    window = geometry.envelope()
    if window is None:
        return F.lit(False)
    parts = F.col(column)["parts"]
    slabs = Slabs.of(_edges(geometry))
    lists = slabs.literal()

    def touches(s: Column) -> Column:
        low, high = slabs.number(F.least(s["a"]["y"], s["b"]["y"])), slabs.number(F.greatest(s["a"]["y"], s["b"]["y"]))
        return F.exists(F.slice(lists, low + 1, high - low + 1), lambda some: F.exists(some, lambda e: _meet(s, e)))

    meets = F.exists(parts, lambda p: F.exists(segments(p["rings"]), touches))
    if any(kind == "A" for kind, _ in geometry.parts):  # without crossing boundaries a part lies inside or outside as a whole

        def inside(v: Column) -> Column:
            crossed = F.filter(F.get(lists, slabs.number(v["y"])), lambda e: (e["area"] >= 0) & _ray(e["ax"], e["ay"], e["bx"], e["by"], v["x"], v["y"]))
            areas = F.transform(crossed, lambda e: e["area"])
            return F.exists(F.transform(F.array(areas), lambda a: F.exists(F.array_distinct(a), lambda k: F.size(F.filter(a, lambda x: x == k)) % 2 == 1)), lambda odd: odd)

        meets = meets | F.exists(parts, lambda p: inside(p["rings"][0][0]))
    starts = F.from_json(F.lit(json.dumps([{"x": float(rings[0][0][0]), "y": float(rings[0][0][1])} for _, rings in geometry.parts])), "array<struct<x:double,y:double>>")
    around = lambda p, v: F.size(F.filter(segments(p["rings"]), lambda s: _ray(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], v["x"], v["y"]))) % 2 == 1
    meets = meets | F.exists(parts, lambda p: (p["kind"] == "A") & F.exists(starts, lambda v: around(p, v)))
    test = F.when(overlaps_window(*window), meets)
    if geometry.srid is not None:
        own = F.col(column)["srid"]
        test = F.when(own != geometry.srid, F.raise_error(F.concat(F.lit(f"reference systems differ: {geometry.srid} and "), own.cast("string"))).cast("boolean")).otherwise(test)
    return F.coalesce(test, F.lit(False))
