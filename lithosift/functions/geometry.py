"""Geometries as plain Spark structs: constants, constructors, envelopes, GeoJSON and EWKT.

A geometry column is struct<type, srid, parts>; a part has a kind ('P' point, 'L' line, 'A' area) and rings of
vertices with x, y and nullable z, m. Everything is a Column expression, so it stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double,z:double,m:double>"
PARTS = f"array<struct<kind:string,rings:array<array<{VERTEX}>>>>"
GEOMETRY = f"struct<type:string,srid:int,parts:{PARTS}>"


class GeometryError(ValueError):
    """A constant geometry or bounding box that can't be used."""


@dataclass(frozen=True)
class Geometry:
    """A constant: parts are (kind, rings), a ring is a tuple of (x, y[, z[, m]])."""

    type: str
    parts: tuple
    srid: int | None = None

    def with_srid(self, srid: int | None) -> Geometry:
        return replace(self, srid=srid)

    def vertices(self) -> list[tuple]:
        return [v for _, rings in self.parts for ring in rings for v in ring]

    def envelope(self) -> tuple[float, float, float, float] | None:
        """(xmin, ymin, xmax, ymax); None if empty."""
        v = self.vertices()
        return (min(p[0] for p in v), min(p[1] for p in v), max(p[0] for p in v), max(p[1] for p in v)) if v else None

    def segments(self) -> list[tuple[float, float, float, float]]:
        """Boundary segments; a point is a segment of length 0."""
        out = []
        for _, rings in self.parts:
            for ring in rings:
                pairs = list(zip(ring, ring[1:], strict=False)) or [(v, v) for v in ring]
                out += [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in pairs]
        return out

    def column(self) -> Column:
        """The same geometry as a literal of the column type."""

        def vertex(v: tuple) -> Column:
            full = [*v, None, None][:4]
            return F.struct(*[F.lit(None if c is None else float(c)).cast("double").alias(n) for c, n in zip(full, "xyzm", strict=True)])

        parts = [F.struct(F.lit(kind).alias("kind"), F.array(*[F.array(*map(vertex, ring)) for ring in rings]).alias("rings")) for kind, rings in self.parts]
        return F.struct(F.lit(self.type).alias("type"), F.lit(self.srid).cast("int").alias("srid"), (F.array(*parts) if parts else F.array().cast(PARTS)).cast(PARTS).alias("parts"))


def point(x: float | None = None, y: float | None = None, *zm: float) -> Geometry:
    return Geometry("Point", () if x is None else (("P", (((x, y, *zm),),)),))


def line(*vertices: tuple) -> Geometry:
    if len(vertices) == 1:
        raise GeometryError("a line needs two vertices")
    return Geometry("LineString", (("L", (tuple(vertices),)),) if vertices else ())


def polygon(*rings: list[tuple]) -> Geometry:
    """Rings are closed if they aren't yet; the first is the outer one, the others are holes."""
    closed = tuple(tuple(r) if r[0] == r[-1] else (*r, r[0]) for r in rings)
    if any(len(r) < 4 for r in closed):
        raise GeometryError("a ring needs three different vertices")
    return Geometry("Polygon", (("A", closed),) if closed else ())


def multi(kind: str, *members: Geometry) -> Geometry:
    """MultiPoint, MultiLineString, MultiPolygon or GeometryCollection of the members."""
    return Geometry(kind, tuple(p for m in members for p in m.parts), members[0].srid if members else None)


def box(xmin: float, ymin: float, xmax: float, ymax: float, srid: int | None = None) -> Geometry:
    """An envelope as a rectangle."""
    if not (xmin <= xmax and ymin <= ymax):
        raise GeometryError(f"not a bounding box: {(xmin, ymin, xmax, ymax)}")
    return polygon([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]).with_srid(srid)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, also where body uses it inside of another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Constructors from columns.


def _vertex(x: Column, y: Column) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), none.alias("z"), none.alias("m"))


def _geometry(kind: str, parts: Column, srid: int | None) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(srid).cast("int").alias("srid"), parts.alias("parts"))


def _part(kind: str, *vertices: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.array(F.array(*vertices)).alias("rings"))


def point_of(x: Column, y: Column, srid: int | None = None) -> Column:
    return _geometry("Point", F.array(_part("P", _vertex(x, y))), srid)


def multipoint_of(*xy: tuple[Column, Column], srid: int | None = None) -> Column:
    return _geometry("MultiPoint", F.array(*[_part("P", _vertex(*p)) for p in xy]), srid)


def line_of(*xy: tuple[Column, Column], srid: int | None = None) -> Column:
    return _geometry("LineString", F.array(_part("L", *[_vertex(*p) for p in xy])), srid)


def rectangle_of(xmin: Column, ymin: Column, xmax: Column, ymax: Column, srid: int | None = None) -> Column:
    ring = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return _geometry("Polygon", F.array(_part("A", *[_vertex(*p) for p in ring])), srid)


# Envelopes.


def vertices(geometry: Column) -> Column:
    return F.flatten(F.flatten(F.transform(geometry["parts"], lambda p: p["rings"])))


def envelope(geometry: Column) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax; all null if the geometry is null or empty."""
    v = vertices(geometry)
    pick = lambda n: F.transform(v, lambda p: p[n])
    return {"xmin": F.array_min(pick("x")), "ymin": F.array_min(pick("y")), "xmax": F.array_max(pick("x")), "ymax": F.array_max(pick("y"))}


def envelope_array(geometry: Column) -> Column:
    """[xmin, ymin, xmax, ymax], or [] if empty."""
    e = envelope(geometry)
    return F.when(F.size(vertices(geometry)) > 0, F.array(*e.values())).otherwise(F.array().cast("array<double>"))


# Text.


def _number(c: Column) -> Column:
    """A coordinate without a trailing .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _joined(ring: Column, z: Column, m: Column) -> Column:
    vertex = lambda v: F.concat_ws(" ", _number(v["x"]), _number(v["y"]), F.when(z, F.coalesce(_number(v["z"]), F.lit("0"))), F.when(m, F.coalesce(_number(v["m"]), F.lit("0"))))
    return F.concat(F.lit("("), F.array_join(F.transform(ring, vertex), ","), F.lit(")"))


def ewkt(geometry: Column) -> Column:
    """Extended well-known text, with SRID=n; in front if the geometry has one."""
    has = lambda n: F.exists(vertices(geometry), lambda v: v[n].isNotNull())
    return let(F.struct(has("z").alias("z"), has("m").alias("m")), lambda d: _ewkt(geometry, d["z"], d["m"]))


def _ewkt(geometry: Column, z: Column, m: Column) -> Column:
    parts, kind = geometry["parts"], geometry["type"]
    ring = lambda r: _joined(r, z, m)
    area = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p["rings"], ring), ","), F.lit(")"))
    flat = lambda p: ring(p["rings"][0])
    name = {"P": "POINT", "L": "LINESTRING", "A": "POLYGON"}
    dims = F.when(z & m, F.lit("ZM")).when(z, F.lit("Z")).when(m, F.lit("M")).otherwise(F.lit(""))
    one = lambda p: F.concat(F.when(p["kind"] == "P", name["P"]).when(p["kind"] == "L", name["L"]).otherwise(name["A"]), dims, F.when(p["kind"] == "A", area(p)).otherwise(flat(p)))
    many = lambda f: F.concat(F.lit("("), F.array_join(F.transform(parts, f), ","), F.lit(")"))
    body = (
        F.when(F.size(parts) == 0, F.lit(" EMPTY")).when(kind.isin("Point", "LineString"), flat(parts[0])).when(kind == "Polygon", area(parts[0]))
        .when(kind.isin("MultiPoint", "MultiLineString"), many(flat)).when(kind == "MultiPolygon", many(area)).otherwise(many(one))
    )
    return F.concat(F.when(geometry["srid"].isNotNull(), F.concat(F.lit("SRID="), geometry["srid"].cast("string"), F.lit(";"))).otherwise(F.lit("")), F.upper(kind), dims, body)


# GeoJSON.

#: The nesting of coordinates by geometry type.
DEPTH = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def _decode_one(g: Column) -> Column:
    """The parts of one geometry that isn't a collection; null if it can't be read."""
    kind = F.try_variant_get(g, "$.type", "string")

    def coordinates(depth: int) -> Column:
        return F.try_variant_get(g, "$.coordinates", "array<" * depth + "double" + ">" * depth)

    def vertex(a: Column, n: Column) -> Column:
        at = lambda k: F.when(n > k, F.get(a, F.lit(k))).cast("double")
        return F.struct(F.get(a, F.lit(0)).alias("x"), F.get(a, F.lit(1)).alias("y"), at(2).alias("z"), at(3).alias("m"))

    def part(kind: str, rings: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), rings.alias("rings"))

    def good(points: Column) -> Column:
        """Each point has two numbers or more; null if there are no points to test."""
        return ~F.exists(points, lambda a: a.isNull() | (F.size(a) < 2) | F.exists(a, lambda c: c.isNull()))

    def read(depth: int, flat: Callable[[Column], Column], made: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
        """made(coordinates, vertex reader) if all points are good; the first point says how many dimensions there are."""
        points = lambda c: F.struct(c.alias("c"), F.size(F.get(flat(c), F.lit(0))).alias("n"))
        return let(coordinates(depth), lambda c: let(points(c), lambda s: F.when(good(flat(s["c"])), made(s["c"], lambda a: vertex(a, s["n"])))))

    empty, same, flat2 = F.array().cast(PARTS), lambda c: c, lambda c: F.flatten(c)
    flat3 = lambda c: F.flatten(F.flatten(c))
    or_empty = lambda c, made: F.when(F.size(c) == 0, empty).otherwise(made)
    return (
        F.when(kind == "Point", read(1, lambda c: F.when(F.size(c) == 0, F.array().cast("array<array<double>>")).otherwise(F.array(c)), lambda c, v: or_empty(c, F.array(part("P", F.array(F.array(v(c))))))))
        .when(kind == "LineString", read(2, same, lambda c, v: or_empty(c, F.array(part("L", F.array(F.transform(c, v)))))))
        .when(kind == "MultiPoint", read(2, same, lambda c, v: F.transform(c, lambda a: part("P", F.array(F.array(v(a)))))))
        .when(kind == "Polygon", read(3, flat2, lambda c, v: or_empty(c, F.array(part("A", F.transform(c, lambda r: F.transform(r, v)))))))
        .when(kind == "MultiLineString", read(3, flat2, lambda c, v: F.transform(c, lambda r: part("L", F.array(F.transform(r, v))))))
        .when(kind == "MultiPolygon", read(4, flat3, lambda c, v: F.transform(c, lambda p: part("A", F.transform(p, lambda r: F.transform(r, v))))))
        .cast(PARTS)
    )


def decode(g: Column, srid: int | None = None) -> Column:
    """A geometry column from a variant with a GeoJSON geometry; null if it is missing or can't be read.

    The members of a GeometryCollection inherit its CRS; a collection in a collection isn't read. The first coordinate decides whether
    there is a z and an m.
    """
    return let(g, lambda v: _decode(v, srid))


def _decode(g: Column, srid: int | None) -> Column:
    kind = F.try_variant_get(g, "$.type", "string")
    name = F.try_variant_get(g, "$.crs.properties.name", "string")
    own = F.regexp_extract(name, r"EPSG:+(\d+)$", 1).try_cast("int")
    members = F.transform(F.try_variant_get(g, "$.geometries", "array<variant>"), _decode_one)
    parts = F.when(kind == "GeometryCollection", let(members, lambda a: F.when(~F.exists(a, lambda m: m.isNull()), F.flatten(a)))).otherwise(_decode_one(g))
    return let(parts, lambda p: F.when(p.isNotNull(), F.struct(kind.alias("type"), F.coalesce(own, F.lit(srid).cast("int")).alias("srid"), p.alias("parts")).cast(GEOMETRY)))


def _coordinates(v: Column) -> Column:
    return F.filter(F.array(v["x"], v["y"], F.when(v["m"].isNotNull(), F.coalesce(v["z"], F.lit(0.0))).otherwise(v["z"]), v["m"]), lambda c: c.isNotNull())


def encode(geometry: Column) -> Column:
    """GeoJSON text of a geometry, with its CRS and bounding box; null for a null geometry and for an empty point."""
    parts, kind = geometry["parts"], geometry["type"]
    ring = lambda r: F.transform(r, _coordinates)
    json = lambda c: F.to_json(F.struct(c.alias("c")))
    inner = lambda c: F.regexp_extract(json(c), r'(?s)^\{"c":(.*)\}$', 1)
    c1 = F.transform(parts, lambda p: _coordinates(p["rings"][0][0]))
    c2 = F.transform(parts, lambda p: ring(p["rings"][0]))
    c3 = F.transform(parts, lambda p: F.transform(p["rings"], ring))
    first = lambda c, depth: F.coalesce(F.get(c, F.lit(0)), F.array().cast("array<" * depth + "double" + ">" * depth))
    named = {"P": "Point", "L": "LineString", "A": "Polygon"}

    def member(p: Column) -> Column:
        body = F.when(p["kind"] == "P", inner(_coordinates(p["rings"][0][0]))).when(p["kind"] == "L", inner(ring(p["rings"][0]))).otherwise(inner(F.transform(p["rings"], ring)))
        label = F.when(p["kind"] == "P", named["P"]).when(p["kind"] == "L", named["L"]).otherwise(named["A"])
        return F.concat(F.lit('{"type":"'), label, F.lit('","coordinates":'), body, F.lit("}"))

    body = (
        F.when(kind == "Point", inner(first(c1, 1))).when(kind == "MultiPoint", inner(c1)).when(kind == "LineString", inner(first(c2, 2))).when(kind == "MultiLineString", inner(c2))
        .when(kind == "Polygon", inner(first(c3, 3))).when(kind == "MultiPolygon", inner(c3)).otherwise(F.concat(F.lit("["), F.array_join(F.transform(parts, member), ","), F.lit("]")))
    )
    crs = F.when(geometry["srid"].isNotNull(), F.concat(F.lit('"crs":{"type":"name","properties":{"name":"EPSG:'), geometry["srid"].cast("string"), F.lit('"}},'))).otherwise(F.lit(""))
    text = F.concat(F.lit('{"type":"'), kind, F.lit('",'), crs, F.lit('"bbox":'), inner(envelope_array(geometry)), F.when(kind == "GeometryCollection", F.lit(',"geometries":')).otherwise(F.lit(',"coordinates":')), body, F.lit("}"))
    return F.when(~((kind == "Point") & (F.size(parts) == 0)), text)
