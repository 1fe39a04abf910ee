"""Predicates, projection, geometry, import and export, writes, views and streams on small literal rows."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lithosift import queries
from lithosift.functions.geometry import GEOMETRY, GeometryError, box, decode, encode, ewkt, line, multi, point, point_of, polygon
from lithosift.functions.predicates import always, intersects, intersects_bbox, prop, spark_date_format, to_date
from lithosift.operators.frame import FeatureFrame, with_envelope
from lithosift.operators.projection import Each, Path, flatten, project
from lithosift.operators.writes import Collection, ConcurrentWrite, DuplicateIds
from lithosift.plans import catalog
from lithosift.sources import features as io
from lithosift.sources import tables

#: Property a of each document, by id; None leaves it out.
VALUES = {"missing": None, "null": "null", "s12": '"12"', "n12": "12", "d12": "12.0", "arr": '[12,"a"]', "abc": '"abc"', "obj": '{"b":[1,{"c":"x"}]}', "yes": "true", "big": "1e30"}


def frame(spark, mode="typed"):
    rows = [(k, '{"id":"%s","properties":{%s}}' % (k, f'"a":{v}' if v else "")) for k, v in VALUES.items()]
    df = spark.createDataFrame(rows, "id string, json string").select("id", F.parse_json("json").alias("doc"))
    return FeatureFrame(df, mode=mode)


def ids(f, p):
    return {r.id for r in f.filter(p).df.select("id").collect()}


A = prop("properties.a")
ALL = set(VALUES)


@pytest.mark.parametrize(
    ("predicate", "typed", "text"),
    [
        (A.eq(12), {"n12", "d12", "arr"}, {"s12", "n12", "d12"}),
        (~A.eq(12), ALL - {"n12", "d12", "arr"}, None),
        (A.eq("12"), {"s12"}, {"s12", "n12", "d12"}),
        (A.eq("a"), {"arr"}, set()),
        (A.ne(12), {"null", "big"}, None),
        (A.gt(11), {"n12", "d12", "arr", "big"}, {"s12", "n12", "d12", "big"}),
        (A.eq(True), {"yes"}, {"yes"}),
        (A.isin(12), {"s12", "n12", "d12"}, {"s12", "n12", "d12"}),
        (~A.isin(13), {"s12", "n12", "d12", "big"}, {"s12", "n12", "d12", "big"}),
        (A.between(11, 12), {"s12", "n12", "d12"}, {"s12", "n12", "d12"}),
        (A.like("a%"), {"abc"}, {"abc"}),
        (A.ilike("AB_"), {"abc"}, {"abc"}),
        (A.matches("b"), {"abc"}, {"abc", "obj"}),
        (A.is_null(), {"null"}, {"missing", "null"}),
        (A.is_not_null(), ALL - {"null", "missing"}, ALL - {"null", "missing"}),
        (A.contains([12]), {"arr"}, {"arr"}),
        (A.contains('["a",12]'), {"arr"}, {"arr"}),
        (A.contains({"b": [{"c": "x"}]}), {"obj"}, {"obj"}),
        (A.contains({"b": {}}), set(), set()),
        (A.contains(12), {"n12", "d12", "arr"}, None),
        (always(False) | A.eq("abc") & always(True), {"abc"}, {"abc"}),
        (prop("properties.none").eq(1), set(), set()),
        (~prop("properties.none").eq(1), ALL, set()),
        (A.eq(A), None, None),
    ],
)
def test_predicates(spark, predicate, typed, text):
    if typed is not None:
        assert ids(frame(spark), predicate) == typed
    if text is not None:
        assert ids(frame(spark, "text"), predicate) == text


def test_dates_and_plain_mode(spark):
    df = spark.createDataFrame([(1, "2024-03-01", 5), (2, "2024-04-01", 7), (3, "no date", 7), (4, None, 9)], "k int, day string, n int")
    f = FeatureFrame(df, mode="plain", id="k")
    get = lambda p: {r.k for r in f.filter(p).df.collect()}
    assert get(prop("day").to_date("YYYY-MM-DD").gt(to_date("01/03/2024", "DD/MM/YYYY"))) == {2}
    assert get(prop("properties.n").eq(prop("k"))) == set() and get(prop("n").between(6, 8)) == {2, 3}
    assert [r.k for r in f.sort_by("n", directions=["DESC"]).page(1, 2).rows().collect()] == [2, 3]
    assert spark_date_format("YY/Mon/DD HH24:MI:SS") == "yy/MMM/dd HH:mm:ss"
    with pytest.raises(ValueError):
        spark_date_format("Q")
    with pytest.raises(TypeError):
        prop("a").isin(1, "x")
    with pytest.raises(ValueError):
        prop("a b")


def test_projection(spark):
    stop = {"id": 7, "type": "Feature", "name": "Mill Lane", "served": {"lines": [{"no": 4, "to": "harbour", "runs": [{"at": "07:10"}]}, {"no": 9, "to": "depot"}], "zone": "B"}, "roofed": True}
    df = spark.createDataFrame([(json.dumps(stop),)], "j string").select(F.parse_json("j").alias("doc"))
    get = lambda *items: json.loads(df.select(F.to_json(project(items, always=()), {"ignoreNullFields": "false"})).first()[0])
    assert get("name", "served.zone", "served.none") == {"name": "Mill Lane", "served": {"zone": "B", "none": None}}
    assert get(Each("served.lines", "no", "bay")) == {"served": {"lines": [{"no": 4, "bay": None}, {"no": 9, "bay": None}]}}
    assert get(Each("served.lines", Each("runs", "at"))) == {"served": {"lines": [{"runs": [{"at": "07:10"}]}, {"runs": []}]}}
    assert get(Each("roofed", "x"), Each("none", "x")) == {"roofed": [], "none": []}
    assert get("name", "name", Each("served.lines", "no"), Each("served.lines", "to")) == {"name": "Mill Lane", "served": {"lines": [{"to": "harbour"}, {"to": "depot"}]}}
    assert [k for k, _ in flatten(df)] == ["id", "name", "roofed", "served.zone", "type"]


SHAPES = [point(1, 2), point(1, 2, 3), point(1, 2, 3, 4), point(), line((0, 0), (3, 4), (6, 0)), polygon([(0, 0), (9, 0), (9, 9), (0, 9)], [(3, 3), (6, 3), (6, 6), (3, 6)]), multi("MultiPoint", point(0, 0), point(5, 5)), multi("MultiLineString", line((0, 0), (1, 1)), line((5, 5), (6, 7))), multi("MultiPolygon", polygon([(0, 0), (1, 0), (1, 1)]), polygon([(5, 5), (7, 5), (7, 7)])), multi("GeometryCollection", point(1, 1), line((2, 2), (3, 3)))]


def shapes(spark, values):
    out = None
    for k, g in enumerate(values):
        row = spark.range(1).select(F.lit(str(k)).alias("id"), g.column().cast(GEOMETRY).alias("geometry"))
        out = row if out is None else out.unionByName(row)
    return with_envelope(out)


def test_geojson_round_trip(spark):
    df = shapes(spark, [s.with_srid(4326) for s in SHAPES]).withColumn("json", encode(F.col("geometry")))
    rows = df.withColumn("back", decode(F.parse_json("json"))).orderBy(F.col("id").cast("int")).collect()
    for r, s in zip(rows, SHAPES, strict=True):
        if not s.parts:
            assert r.json is None
            continue
        assert r.back == r.geometry, r.json
        j = json.loads(r.json)
        assert j["type"] == s.type and j["bbox"] == list(map(float, s.envelope())) and j["crs"]["properties"]["name"] == "EPSG:4326"
    wkt = {r.id: r.w for r in df.select("id", ewkt(F.col("geometry")).alias("w")).collect()}
    assert wkt["0"] == "SRID=4326;POINT(1 2)" and wkt["3"] == "SRID=4326;POINT EMPTY" and wkt["1"] == "SRID=4326;POINTZ(1 2 3)"
    assert wkt["5"] == "SRID=4326;POLYGON((0 0,9 0,9 9,0 9,0 0),(3 3,6 3,6 6,3 6,3 3))"


@pytest.mark.parametrize("bad", ['{"type":"Circle","coordinates":[1,2]}', '{"type":"Point","coordinates":["x",2]}', '{"type":"Point","coordinates":[1]}', '{"type":"LineString","coordinates":[[1,2],[3]]}', '{"type":"Polygon","coordinates":[1,2]}', '{"type":"GeometryCollection","geometries":[{"type":"X"}]}', '"text"'])
def test_unreadable_geometries(spark, bad):
    assert spark.range(1).select(decode(F.parse_json(F.lit(bad))).alias("g")).first().g is None


@pytest.mark.parametrize(
    ("constant", "want"),
    [
        (point(3, 4), {4, 5}),  # a vertex, and on the hole's edge
        (point(1.5, 2), {4, 5}),  # on the line, inside the polygon
        (point(4, 4), set()),  # in the hole
        (point(3, 4.5), {5}),  # on the hole's edge
        (box(3.5, 3.5, 5.5, 5.5), {6, 7, 8}),  # in the hole, so not the polygon
        (box(-1, -1, 10, 10), {0, 1, 2, 4, 5, 6, 7, 8, 9}),
        (box(9, 9, 12, 12), {5}),  # corner to corner
        (box(20, 20, 21, 21), set()),
        (line((-5, 0), (-1, 0)), set()),
        (line((-5, 0), (0, 0)), {4, 5, 6, 7, 8}),  # ends at a vertex
        (line((0, 9), (4, 9)), {5}),  # along an edge
        (polygon([(0.9, 1.9), (1.1, 1.9), (1.1, 2.1), (0.9, 2.1)]), {0, 1, 2, 5}),
        (point(), set()),
    ],
)
def test_exact_intersection(spark, constant, want):
    df = shapes(spark, SHAPES)
    got = {int(r.id) for r in FeatureFrame(df).filter(intersects(constant)).df.collect()}
    assert got == want, constant


def test_intersection_against_sampling(spark):
    """Random triangles: points sampled from both decide."""
    rng = random.Random(6)
    tri = lambda: polygon([(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)])
    values = [tri() for _ in range(30)]
    c = tri()

    def inside(g, x, y):
        r = g.parts[0][1][0]
        s = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(r, r[1:], strict=False)]
        return all(v >= 0 for v in s) or all(v <= 0 for v in s)

    got = {int(r.id) for r in FeatureFrame(shapes(spark, values)).filter(intersects(c)).df.collect()}
    for k, g in enumerate(values):
        shared = sum(inside(g, x, y) and inside(c, x, y) for x, y in [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3000)])
        assert not shared or k in got


def test_windows_and_explode(spark):
    f = FeatureFrame(shapes(spark, SHAPES), srid=4326)
    assert {int(r.id) for r in f.window((9, 9, 20, 20)).df.collect()} == {5}  # touching counts
    assert f.window(None).df is f.df
    with pytest.raises(GeometryError):
        f.window((1, 2, 3))
    with pytest.raises(GeometryError):
        f.window((5, 0, 1, 1))
    with pytest.raises(GeometryError):
        f.intersecting(point(1, 1).with_srid(31370))
    parts = f.window((4, 4, 6, 6)).explode().df.collect()
    assert sorted((int(r.id), r.geometry.type) for r in parts) == [(4, "LineString"), (5, "Polygon"), (6, "Point"), (7, "LineString"), (8, "Polygon")]
    assert f.filter(intersects_bbox()).df.count() == 0
    assert f.extent().first().asDict() == {"xmin": 0.0, "ymin": 0.0, "xmax": 9.0, "ymax": 9.0}


LINES = ['{"id":"a","type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"t":"x \\"y\\"\\nz","n":1.5,"l":[1]}}', '{"id":"b","properties":{}}', '{"id":3,"geometry":null}', "[1]", "", "  ", "{broken", '{"id":"c","geometry":{"type":"Point","coordinates":[]}}', '{"id":"d","geometry":{"type":"Nope"}}', '{"geometry":null}', '{"id":"long","properties":{"p":"' + "x" * 300 + '"}}']


def test_import(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = io.parse(lines, max_size=250)
    assert {r.id for r in got.features.collect()} == {"a", "b", "c"}
    assert sorted(r.reason for r in got.rejects.collect()) == ["no JSON", "no id of type text", "no id of type text", "too large", "unreadable geometry"]
    assert {r.id for r in io.parse(lines, id_type="decimal").features.collect()} == {"3"}
    with pytest.raises(Exception, match="no JSON|too large|no id|unreadable"):
        got.strict().collect()
    assert io.parse(lines.limit(2)).strict().count() == 2
    a = got.features.filter("id = 'a'")
    line_ = json.loads(io.to_line(a).first().value)
    assert line_ == {**json.loads(LINES[0]), "geometry": {"type": "Point", "bbox": [1, 2, 1, 2], "coordinates": [1, 2]}}
    header, rows = io.csv_lines(a, ";")
    assert header == "id;geometry-wkt;n;t" and rows.first().value == 'a;"POINT(1 2)";1.5;"x ""y"" z"'
    assert io.parse(lines.limit(0)).features.count() == 0


def test_import_counts_bytes(spark):
    sizes = {k: len(json.dumps({"id": k, "p": "é" * 50}, ensure_ascii=False).encode()) for k in ("x", "yy")}
    lines = spark.createDataFrame([(json.dumps({"id": k, "p": "é" * 50}, ensure_ascii=False),) for k in sizes], "value string")
    got = io.parse(lines, max_size=sizes["x"])
    assert [r.id for r in got.features.collect()] == ["x"] and [r.reason for r in got.rejects.collect()] == ["too large"]


def test_sinks(spark, tmp_path):
    f = FeatureFrame(io.parse(spark.createDataFrame([(x,) for x in LINES[:2]], "value string")).features)
    io.write_collection(f.page(0, 1), str(tmp_path / "fc"))
    assert json.loads(spark.read.text(str(tmp_path / "fc/collection")).first().value) == {"type": "FeatureCollection", "total": 2, "count": 1}
    io.write_csv(f.df, str(tmp_path / "csv"), "|", [("properties.n", "double"), ("properties.t", "string")])
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.startswith("id|geometry-wkt|n|t\n") and 'a|"POINT(1 2)"|1.5|"x ""y"" z"' in text


def features(spark, rows):
    lines = [('{"id":"%s","geometry":{"type":"Point","coordinates":[%d,0]},"properties":{"v":%d}}' % (k, v, v),) for k, v in rows]
    return io.parse(spark.createDataFrame(lines, "value string")).features


def state(c):
    return {r.id: r.v for r in c.read().select("id", F.try_variant_get("doc", "$.properties.v", "int").alias("v")).collect()}


def test_writes(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError):
        c.read()
    assert c.insert(features(spark, [("a", 1), ("b", 2), ("c", 3)])) == 3
    for bad in ([("a", 9)], [("x", 1), ("x", 2)]):
        with pytest.raises(DuplicateIds):
            c.insert(features(spark, bad))
    assert state(c) == {"a": 1, "b": 2, "c": 3}
    new = features(spark, [("b", 20)]).withColumn("n", F.lit(1)).unionByName(features(spark, [("b", 21), ("d", 4)]).withColumn("n", F.lit(2)))
    assert c.upsert(new, order="n") == 2 and state(c) == {"a": 1, "b": 21, "c": 3, "d": 4}
    v = prop("properties.v")
    assert c.delete(v.lt(3)) == 1 and state(c) == {"b": 21, "c": 3, "d": 4}
    assert c.delete(prop("properties.none").like("x")) == 0
    assert c.update(v.le(4), features(spark, [("z", 50)])) == 2 and state(c) == {"b": 21, "c": 50, "d": 50}
    assert {r.xmin for r in c.read().collect()} == {21.0, 50.0}


def test_views_catalog_and_layout(spark, tmp_path):
    views = catalog.Views()
    f = FeatureFrame(features(spark, [("a", 1), ("b", 2), ("c", 3)]))
    assert views.put("c", "low", prop("properties.v").lt(3), (Path("properties.v", "int"),), f) == "created"
    assert views.put("c", "low", prop("properties.v").lt(3), (Path("properties.v", "int"),), f) == "replaced"
    seen = views.apply(f, "c", "low").filter(prop("properties.v").gt(1))
    assert [(r.id, r.feature.properties.v) for r in seen.select("other").collect()] == [("b", 2)]
    assert spark.table("low").count() == 2
    catalog.create_collection(spark, "things", (0, 0, 9, 9))
    f.df.write.insertInto("things")
    assert catalog.metadata(spark, "things") == {"extent": [0, 0, 9, 9], "id_type": "text", "srid": None, "mode": "typed", "id": "id", "geometry": "geometry", "count": 3}
    f.df.withColumn("n", F.col("xmin").cast("int")).drop("doc").write.saveAsTable("plain")
    catalog.register(spark, "plain", "n", "geometry")
    with pytest.raises(catalog.AlreadyRegistered):
        catalog.register(spark, "plain", "n", "geometry")
    assert catalog.metadata(spark, "plain")["id_type"] == "decimal" and catalog.collection(spark, "plain").filter(prop("n").gt(1)).df.count() == 2
    laid = catalog.optimize_layout(f, [("properties.v", "number")], str(tmp_path / "layout"), files=2)
    q = laid.filter(prop("properties.v").eq(2)).df
    assert [r.id for r in q.collect()] == ["b"] and "EqualTo(p_properties_v,2" in q._jdf.queryExecution().toString()


def test_layout_changes_no_answer(spark, tmp_path):
    """Every comparison of every kind of value, with its negation, before and after."""
    values = [*VALUES.values(), "12.5", "-3", "1e-30", "12345678901234567890123", "9007199254740993", '"b"', "false", "[null]", "[]", "[[12]]", "[true]", '["12"]', "{}", "0.1"]
    rows = [(str(k), '{"properties":{%s}}' % (f'"a":{v}' if v else "")) for k, v in enumerate(values)]
    f = FeatureFrame(spark.createDataFrame(rows, "id string, json string").select("id", F.parse_json("json").alias("doc")))
    for kind, others in (("number", [12, 0.1, 1e30, 1e-30, -3, 12345678901234567890123]), ("string", ["12", "abc", ""]), ("boolean", [True, False])):
        laid = catalog.optimize_layout(f, [("properties.a", kind)], str(tmp_path / kind))
        tests = [getattr(A, op)(o) for op in ("eq", "ne", "lt", "le", "gt", "ge") for o in [*others, 12, "12", True]]
        both = [t for p in tests for t in (p, ~p)]
        got = [[tuple(r) for r in x.df.select("id", *[p.column(x.binding).alias(f"c{k}") for k, p in enumerate(both)]).orderBy(F.col("id").cast("int")).collect()] for x in (f, laid)]
        assert got[0] == got[1], kind
        assert not any(v is None for r in got[1] for v in r)


def test_layouts_and_views_of_tables(spark, tmp_path):
    catalog.create_collection(spark, "kept", (0, 0, 9, 9), path=str(tmp_path / "kept"))
    table = catalog.Table(spark, "kept")
    assert table.insert(features(spark, [("a", 1), ("b", 2), ("c", 3)])) == 3 and table.insert(features(spark, [("d", 4)])) == 1
    with pytest.raises(DuplicateIds):
        table.insert(features(spark, [("d", 5)]))
    catalog.put_layout(spark, "kept", "by_v", [("properties.v", "number")], str(tmp_path / "layout"))
    assert catalog.layouts(spark, "kept") == {"by_v": [("properties.v", "number")]}
    v = prop("properties.v")
    names = lambda f: {r.id for r in f.df.select("id").collect()}
    assert catalog.collection(spark, "kept", "by_v").ready and names(catalog.collection(spark, "kept", "by_v").filter(v.gt(2))) == {"c", "d"}
    shape = polygon([(0, -1), (5, -1), (5, 1), (0, 1)])
    p = (v.gt(1) & ~v.eq(3) | v.isin(1, 7)) & intersects(shape) & ~prop("properties.day").to_date("YYYY").lt(to_date("2024", "YYYY"))
    assert catalog.put_view(spark, "kept", "some", p, (Path("properties.v", "int"), Each("properties.l", "x"), "other's")[:2]) == "created"
    assert catalog.put_view(spark, "kept", "some", p, (Path("properties.v", "int"),)) == "replaced" and catalog.views(spark, "kept") == ["some"]
    assert names(catalog.through_view(spark, "kept", "some", "by_v")) == {"a", "b", "d"}
    assert table.upsert(features(spark, [("d", 40), ("e", 2)])) == 2 and table.delete(v.eq(1)) == 1 and table.update(v.eq(3), features(spark, [("z", 7)])) == 1
    assert {r.id: r.v for r in spark.table("kept").select("id", F.try_variant_get("doc", "$.properties.v", "int").alias("v")).collect()} == {"b": 2, "c": 7, "d": 40, "e": 2}
    assert not catalog.collection(spark, "kept", "by_v").ready  # the layout is of an earlier state
    assert names(catalog.through_view(spark, "kept", "some")) == {"b", "e"}
    catalog.drop_view(spark, "kept", "some")
    catalog.drop_layout(spark, "kept", "by_v")
    assert catalog.views(spark, "kept") == [] and catalog.layouts(spark, "kept") == {} and catalog.metadata(spark, "kept")["count"] == 4
    with pytest.raises(KeyError):
        catalog.through_view(spark, "kept", "some")
    catalog.drop_collection(spark, "kept")
    assert not (tmp_path / "kept").exists()


def test_states_survive_writers(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.insert(features(spark, [("a", 1)]))
    before = c.version()
    assert c.insert(features(spark, [("b", 2)])) == 1 and len(c.state()["base"]) == 2  # nothing is written again
    with pytest.raises(ConcurrentWrite):
        c.commit(before, c.state())
    (tmp_path / "c/_states/.9-broken").write_text("half")
    assert state(c) == {"a": 1, "b": 2}
    for k in range(10):
        assert c.upsert(features(spark, [("b", 10 + k), (f"n{k}", k)]), source="s", number=k) == 2
        assert c.upsert(features(spark, [("b", -1)]), source="s", number=k) == 0
    assert state(c) == {"a": 1, "b": 19} | {f"n{k}": k for k in range(10)} and len(c.state()["deltas"]) < 8
    assert c.vacuum() == 0 and c.vacuum(spared=0) > 0 and state(c)["b"] == 19


def test_any_key_is_exported(spark, tmp_path):
    doc = {"type": "Feature", "properties": {"a b": 1, "a,b": "x", 'q"q': True, "it's": 2.5, "ünï": {"in ner": "y"}, "both\"'": "z", "dot.ted": 3, "dot": {"ted": 4}, "OBJECT<": 5, "`t`": 6, "empty": {}, "list": [1]}}
    df = spark.createDataFrame([("k", json.dumps(doc))], "id string, j string").select("id", F.lit(None).cast(GEOMETRY).alias("geometry"), F.parse_json("j").alias("doc"))
    keys = {".".join(k.names[1:]): k for k, _ in io.csv_columns(df)}
    assert set(keys) == {"a b", "a,b", 'q"q', "it's", "ünï.in ner", "both\"'", "dot.ted", "OBJECT<", "`t`"} and len(io.csv_columns(df)) == 10
    io.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    import csv

    (part,) = (tmp_path / "csv").glob("part-*")
    head, row = csv.reader(part.read_text().splitlines())
    got = sorted(zip(head, row, strict=True))
    assert got == sorted([("id", "k"), ("geometry-wkt", ""), ("a b", "1"), ("a,b", "x"), ('q"q', "true"), ("it's", "2.5"), ("ünï.in ner", "y"), ("both\"'", "z"), ("dot.ted", "3"), ("dot.ted", "4"), ("OBJECT<", "5"), ("`t`", "6")])


def test_one_document(spark, tmp_path):
    f = FeatureFrame(features(spark, [(f"f{k}", k) for k in range(9)]))
    for name, page in (("some", f.page(2, 4)), ("none", f.page(20, 4)), ("all", f)):
        io.write_document(page, str(tmp_path / name))
        (part,) = (tmp_path / name).glob("part-*")
        got = json.loads(part.read_text())
        assert got["type"] == "FeatureCollection" and got["total"] == 9 and len(got["features"]) == {"some": 4, "none": 0, "all": 9}[name]


def test_rows_of_another_reference_system_fail(spark):
    df = shapes(spark, [point(1, 1).with_srid(4326), point(1, 1), point(50, 50).with_srid(31370)])
    assert FeatureFrame(df).intersecting(box(0, 0, 2, 2, srid=4326)).df.count() == 2
    with pytest.raises(Exception, match="reference systems differ"):
        FeatureFrame(df).filter(intersects(box(0, 0, 60, 60, srid=4326))).df.collect()


def test_large_polygons(spark):
    """A star of 4,000 vertices and many islands against the plain rule, for points, and a constant of constant size."""
    rng = random.Random(12)
    star = [((3 + 5 * (k % 2) + rng.random()) * math.cos(k * math.pi / 2000), (3 + 5 * (k % 2) + rng.random()) * math.sin(k * math.pi / 2000)) for k in range(4000)]
    islands = multi("MultiPolygon", *[polygon([(x, y), (x + 0.4, y), (x + 0.4, y + 0.3)]) for x in range(-9, 9) for y in range(-9, 9)])
    spots = [(rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(400)]
    df = with_envelope(spark.createDataFrame([(str(k), x, y) for k, (x, y) in enumerate(spots)], "id string, x double, y double").select("id", point_of(F.col("x"), F.col("y")).alias("geometry")))

    def inside(g, x, y):
        def odd(rings):
            return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:], strict=False)) % 2

        return any(odd(rings) for _, rings in g.parts)

    for g in (polygon(star), islands):
        got = {int(r.id) for r in FeatureFrame(df).filter(intersects(g)).df.select("id").collect()}
        assert got == {k for k, p in enumerate(spots) if inside(g, *p)} and 0 < len(got) < 400


def test_stream(spark, tmp_path):
    from lithosift.streaming.ingest import ingest

    target, source = Collection(spark, str(tmp_path / "c")), tmp_path / "in"
    source.mkdir()
    text = lambda rows: "\n".join('{"id":%d,"geometry":null,"properties":{"v":%d}}' % r for r in rows)
    for name, rows in (("1", [(1, 1), (2, 2), (1, 3)]), ("2", [(2, 5), (3, 6)])):
        (source / name).write_text(text(rows) + "\nbroken")
        ingest(spark, str(source), target, str(tmp_path / "state"), id_type="decimal", once=True, rejects=str(tmp_path / "rejects")).awaitTermination()
    assert state(target) == {"1": 3, "2": 5, "3": 6}
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 2


# Sides of lines, and pages far into a collection.


def test_sides_equal_rational_arithmetic(spark):
    import math
    import random
    from fractions import Fraction

    from lithosift.functions.spatial import side

    rng = random.Random(4)
    rows = []
    for k in range(3000):
        a, b = (rng.uniform(-180, 180), rng.uniform(-90, 90)), (rng.uniform(-180, 180), rng.uniform(-90, 90))
        t = rng.choice([0.5, 0.25, rng.random(), 2.0])
        p = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
        for _ in range(rng.randrange(3)):
            p[k % 2] = math.nextafter(p[k % 2], rng.choice([-math.inf, math.inf]))
        rows.append((*a, *b, *p))
    rows += [(0.0, 0.0, 1.0, 1.0, 0.5, 0.5), (0.1, 0.1, 0.3, 0.3, 0.2, 0.2), (1e-9, 1e9, 1e9, 1e-9, 1.0, 5.0), (0.0, 0.0, 3.0, 0.0, 9.0, 0.0), (12.0, 12.0, 24.0, 24.0, 0.5, math.nextafter(0.5, 1))]

    def exact(*v):
        ax, ay, bx, by, px, py = map(Fraction, v)
        d = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        return (d > 0) - (d < 0)

    names = ["ax", "ay", "bx", "by", "px", "py"]
    got = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(*names, side(*map(F.col, names)).alias("side")).collect()
    rounded = sum(math.copysign((r.bx - r.ax) * (r.py - r.ay) - (r.by - r.ay) * (r.px - r.ax) != 0, (r.bx - r.ax) * (r.py - r.ay) - (r.by - r.ay) * (r.px - r.ax)) != exact(*r[:6]) for r in got)
    assert all(r.side == exact(*r[:6]) for r in got) and rounded > 100  # plain doubles are wrong for these


def test_deep_pages(spark, monkeypatch):
    from lithosift.operators import frame as frames
    from lithosift.operators import paging

    rows = [(f"{k * 7919 % 5000:05d}", [None, "a", "b", "c"][k % 4], k % 3 or None) for k in range(5000)]
    rows += [("00007", "b", 1)] * 5
    df = spark.createDataFrame(rows, "id string, s string, n int")
    f = FeatureFrame(df, mode="plain")
    monkeypatch.setattr(paging, "FAN", 3)
    monkeypatch.setattr(paging, "DEEP", 50)
    for keys, ways in ((("s", "n"), ["DESC", "ASC"]), ((), [])):
        sorted_ = f.sort_by(*keys, directions=ways)
        plain = sorted_.page(0).rows().collect()
        for start, limit in ((1, 5), (2600, 30), (4990, None), (5005, 2)):
            key = paging.key_at(df, [*sorted_.order, (F.col("id"), False)], start, 50)
            assert (key is None) == (start >= 5005)
            monkeypatch.setattr(frames, "after_offset", lambda df, keys, start: paging.after_offset(df, keys, start, 50))
            monkeypatch.setattr(frames, "DEEP", 0)
            page = sorted_.page(start, limit).rows()
            assert page.collect() == plain[start:][: limit if limit is not None else None], (keys, start)
            assert "Offset" not in page._jdf.queryExecution().toString() or key[1]
            monkeypatch.setattr(frames, "DEEP", paging.DEEP)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_line_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"id":1,"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":2}}',), ('{"id":"x"}',), ("[1]",), ("{",), ("  ",)], "value string")
    got = io.parse(lines, id_type="decimal")
    for df in (got.features, got.rejects, got.both):
        assert _plan(df).count("parseJson(value") + _plan(df).count("parseJson(line") == 1
    assert sorted((r.id or "", r.reason or "") for r in got.both.select("id", "reason").collect()) == [("", "no JSON"), ("", "no id of type decimal"), ("1", "")]
    assert [(r.id, r.xmin) for r in got.features.collect()] == [("1", 1.0)] and got.rejects.count() == 2


def test_decoding_evaluates_its_argument_once(spark):
    df = spark.createDataFrame([('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}',), ('{"type":"Point","coordinates":[1]}',)], "t string")
    got = df.select(decode(F.parse_json("t"), srid=7).alias("g"))
    assert _plan(got).count("parseJson(") == 1
    assert [(g and (g.type, g.srid, len(g.parts))) for g, in got.collect()] == [("GeometryCollection", 7, 1), None]


def test_stripping_goes_through_text_only_for_rewritten_numbers(spark):
    docs = ['{"id":1,"a":null,"geometry":{"type":"Point"},"b":[1,null,{"geometry":2}]}', "{}", '{"geometry":1}', '{"n":1e2,"m":12.50,"k":100.0,"z":-0,"q":-0.0}', '{"n":1E300,"x":1e-7}', '{"":1," ":{"a\\"b":"q\\u0001\\n\\\\é"}}', '{"a":[1,1.5,"x",2e1],"DOUBLE":true}', '{"n":1.00000000000000000000000000000000000000}']
    df = spark.createDataFrame([(d,) for d in docs], "j string").select(F.parse_json("j").alias("d"))
    through = F.parse_json(F.to_json(F.map_filter(F.from_json(F.to_json("d"), "map<string,variant>"), lambda k, _: k != "geometry")))
    got = df.select(io.strip_geometry(F.col("d")).alias("a"), through.alias("b"))
    for a, b, *kinds in got.select(F.to_json("a"), F.to_json("b"), F.schema_of_variant("a"), F.schema_of_variant("b")).collect():
        assert a == b and kinds[0] == kinds[1]
    plan = df.select(io.strip_geometry(F.col("d")).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.index("CASE WHEN RLIKE(schema_of_variant") < plan.index("to_json")


def test_objects_are_known_by_their_first_character(spark):
    lines = ['{"id":1}', ' \t{"id":2}', "[3]", "4", '"{"', "null", " ", "{"]
    both = io.parse(spark.createDataFrame([(x,) for x in lines], "value string"), id_type="decimal").both
    assert sorted((r.line, r.reason) for r in both.select("line", "reason").collect()) == sorted([(lines[0], None), (lines[1], None), ("{", "no JSON")])


def test_lines_of_two_loads_are_made_once_and_dealt_out(spark, sf):
    df = queries.QUERIES["w05_id"](spark, sf)
    assert df.count() == 2 * spark.read.parquet(f"{sf}/events.parquet").count()
    rows = tables.events(spark, sf, spread=True).df
    assert sorted(r.id for r in rows.select("id").collect()) == sorted(r.id for r in tables.events(spark, sf).df.select("id").collect())
    for d, shuffle in ((rows, "hashpartitioning(event_id"), (df, "hashpartitioning(value")):
        assert shuffle in d._jdf.queryExecution().executedPlan().toString()
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
