"""One query per operator over the given tables, with the same query in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import box, decode, encode, envelope_array, ewkt, line, polygon, rectangle_of
from .functions.predicates import always, intersects, intersects_bbox, overlaps_bbox, prop, to_date
from .operators import writes
from .operators.frame import BOX, FeatureFrame, with_envelope
from .operators.paging import after_offset
from .operators.projection import Each, Path, flatten
from .operators.writes import Collection
from .plans import catalog
from .sources import features as io
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def work(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lithosift-")
    return f"{root}/q-{uuid.uuid4().hex}"


ID = "CAST(event_id AS VARCHAR) AS id"
TYPE, USER, VALUE, OPT, DAY = (f"properties.{n}" for n in ("event_type", "user_id", "value", "opt", "day"))

# Predicates: ids of the events for which they hold. opt is missing, null, "12", 12 or [12,"a"] by event_id % 5.

PREDICATES = {
    "f01_eq": (lambda: prop(TYPE).eq("click"), "event_type = 'click'"),
    "f01_eq_typed_array": (lambda: prop(OPT).eq(12), "event_id % 5 IN (3, 4)"),
    "f02_ne": (lambda: prop(TYPE).ne("click") & prop(USER).ne(8), "event_type <> 'click' AND user_id <> 8"),
    "f02_ne_typed": (lambda: prop(OPT).ne(12), "event_id % 5 = 1"),
    "f03_order": (lambda: prop(VALUE).ge(5) & prop(VALUE).lt(20.5) & (prop(USER).gt(10) | prop(USER).le(3)), "value >= 5 AND value < 20.5 AND (user_id > 10 OR user_id <= 3)"),
    "f05_and_or": (lambda: prop(TYPE).eq("click") | prop(TYPE).eq("error") & prop(USER).lt(50), "event_type = 'click' OR (event_type = 'error' AND user_id < 50)"),
    "f06_not": (lambda: ~prop("properties.none").eq(1) & ~prop(OPT).eq("12"), "event_id % 5 <> 2"),
    "f06_not_three_valued": (lambda: ~prop(OPT).isin(13) | ~prop("properties.none").like("x"), "event_id % 5 IN (2, 3)"),
    "f07_boolean": (lambda: always(True) & prop("properties.flag").eq(True), "event_id % 2 = 0"),
    "f08_in": (lambda: prop(TYPE).isin("click", "error") & prop(OPT).isin(12, 13), "event_type IN ('click', 'error') AND event_id % 5 IN (2, 3)"),
    "f09_between": (lambda: prop(VALUE).between(5, 20), "value BETWEEN 5 AND 20"),
    "f09_between_dates": (lambda: prop(DAY).to_date("YYYY-MM-DD").between(to_date("2024-01-05", "YYYY-MM-DD"), to_date("10/01/2024", "DD/MM/YYYY")), "CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'"),
    "f10_like": (lambda: prop(TYPE).like("c%") & ~prop(TYPE).like("C%"), "event_type LIKE 'c%' AND event_type NOT LIKE 'C%'"),
    "f11_ilike": (lambda: prop(TYPE).ilike("C%K"), "event_type ILIKE 'C%K'"),
    "f12_regex": (lambda: prop(TYPE).matches("[lr]+i?"), "regexp_matches(event_type, '[lr]+i?')"),
    "f12_regex_typed": (lambda: prop(OPT).matches("^(12|a)$"), "event_id % 5 IN (2, 4)"),
    "f13_is_null": (lambda: prop(OPT).is_null(), "event_id % 5 = 1"),
    "f14_is_not_null": (lambda: prop(OPT).is_not_null(), "event_id % 5 IN (2, 3, 4)"),
    "f15_contains": (lambda: prop("properties").contains('{"props":{"k":69}}') | prop(OPT).contains('["a"]'), "props LIKE '%: 69}' OR event_id % 5 = 4"),
    "f15_contains_array": (lambda: prop("properties.tags").contains([{"n": 2, "t": "click"}]), "user_id % 3 = 2 AND event_type = 'click'"),
    "f16_to_date": (lambda: prop(DAY).to_date("YYYY-MM-DD").lt(to_date("2024-01-09", "YYYY-MM-DD")), "CAST(ts AS DATE) < DATE '2024-01-09'"),
    "f17_properties": (lambda: prop(USER).gt(prop(VALUE)), "user_id > value"),
    "g04_intersects_predicate": (lambda: intersects(TRIANGLE) & ~prop(TYPE).eq("click") | overlaps_bbox(100, 0, 110, 8), "({triangle}) AND event_type <> 'click' OR (user_id BETWEEN 100 AND 110 AND value BETWEEN 0 AND 8)"),
}
#: A triangle, and the test of an event's point against it.
TRIANGLE = polygon([(10, 5), (60, 5), (10, 105)])
IN_TRIANGLE = "user_id >= 10 AND value >= 5 AND (-50.0 * (value - 5.0) - 100.0 * (user_id - 60.0)) >= 0"


def _predicate(build) -> Query:
    return lambda spark, sf_dir: tables.events(spark, sf_dir).filter(build()).df.select("id")


for _name, (_build, _where) in PREDICATES.items():
    query(_name, f"SELECT {ID} FROM events WHERE {_where.replace('{triangle}', IN_TRIANGLE)}")(_predicate(_build))


@query("f04_cast", f"SELECT {ID}, event_id % 5 IN (3, 4) AS typed, CASE WHEN event_id % 5 IN (2, 3) THEN true END AS text FROM events WHERE event_id % 5 <> 4")
def f04_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.events(spark, sf_dir)
    p = prop(OPT).eq(12)
    text = p.column(FeatureFrame(f.df, mode="text").binding)
    return f.df.select("id", p.column(f.binding).alias("typed"), text.alias("text")).filter(F.col("id").cast("long") % 5 != 4)


@query("f21_exact_numbers", f"""SELECT {ID}, v = 7.25::DECIMAL(38,26) AS same, v > 7.25::DECIMAL(38,26) AS more, v BETWEEN '7.25000000000000000000000001'::DECIMAL(38,26) AND '7.25000000000000000000000002'::DECIMAL(38,26) AS inside
FROM (SELECT *, CAST(CASE WHEN event_id % 3 = 0 THEN CAST(value AS VARCHAR) ELSE '7.2500000000000000000000000' || CAST(event_id % 3 AS VARCHAR) END AS DECIMAL(38,26)) AS v FROM events)
WHERE v >= '7.25000000000000000000000001'::DECIMAL(38,26) OR event_id % 7 = 0""")
def f21_exact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the numbers differ in their 26th place only."""
    f = tables.events(spark, sf_dir)
    number = F.when(F.col("id").cast("long") % 3 == 0, f.get(VALUE)).otherwise(F.concat(F.lit("7.2500000000000000000000000"), (F.col("id").cast("long") % 3).cast("string")))
    f = FeatureFrame(f.df.withColumn("doc", F.parse_json(F.concat(F.lit('{"properties":{"v":'), number, F.lit("}}")))))
    v, low = prop("properties.v"), Decimal("7.25000000000000000000000001")
    tests = {"same": v.eq(Decimal("7.25")), "more": v.gt(7.25), "inside": v.between(low, Decimal("7.25000000000000000000000002"))}
    kept = v.ge(low).column(f.binding) | (F.col("id").cast("long") % 7 == 0)
    return f.df.filter(kept).select("id", *[p.column(f.binding).alias(n) for n, p in tests.items()])


@query("f13_null_text", f"SELECT {ID} FROM events WHERE event_id % 5 IN (0, 1)")
def f13_null_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir, mode="text").filter(prop(OPT).is_null()).df.select("id")


@query("f18_combined", f"SELECT {ID} FROM events WHERE user_id BETWEEN 20 AND 60 AND value BETWEEN 0 AND 40 AND {IN_TRIANGLE} AND event_type = 'click'")
def f18_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).window((20, 0, 60, 40)).intersecting(TRIANGLE).filter(prop(TYPE).eq("click")).df.select("id")


def _views(frame: FeatureFrame, in_sql: bool = False) -> catalog.Views:
    views = catalog.Views()
    views.put("events", "clicks", prop(TYPE).eq("click"), (Path(TYPE, "string"),), frame if in_sql else None)
    return views


@query("f19_view_and_request", f"SELECT {ID} FROM events WHERE event_type = 'click' AND value < 15")
def f19_view_and_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.events(spark, sf_dir)
    return _views(f).apply(f, "events", "clicks").filter(prop(VALUE).lt(15)).df.select("id")


@query("f20_plain_mode", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#17' AND p_size BETWEEN 5 AND 30 AND NOT p_type = 'ECONOMY'")
def f20_plain_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.parts(spark, sf_dir).filter(prop("properties.p_brand").eq("Brand#17") & prop("p_size").between(5, 30) & ~prop("p_type").eq("ECONOMY"))
    return f.df.select("p_partkey", "p_name")


# Space.

#: A triangle and a rectangle away from round coordinates, so that no test is decided by the last bit.
SMALL = polygon([(5, 2.003), (15, 2.003), (5, 12.003)])
RECTANGLE = box(4, 3.3337, 11, 9.7771)


@query("g01_bbox_argument", f"SELECT {ID} FROM events WHERE user_id BETWEEN 10 AND 60 AND value BETWEEN 5 AND 20 UNION ALL SELECT 'all ' || CAST(count(*) AS VARCHAR) FROM events")
def g01_bbox_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.events(spark, sf_dir)
    return f.window((10, 5, 60, 20)).df.select("id").unionByName(f.window(None).count().select(F.concat(F.lit("all "), F.col("total").cast("string")).alias("id")))


@query("g02_window", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey <= 8 AND c_nationkey + 3 >= 5 AND c_acctbal / 500 <= 9.01 AND c_acctbal / 500 + 2 >= 4.03")
def g02_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.customers(spark, sf_dir).window((5, 4.03, 8, 9.01)).df.select("id")


@query("g03_intersection", f"SELECT {ID} FROM events WHERE {IN_TRIANGLE}")
def g03_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).intersecting(TRIANGLE).df.select("id")


LINE_MEETS = "greatest(0, (4 - c_nationkey) / 3, (3.3337 - c_acctbal / 500) / 2) <= least(1, (11 - c_nationkey) / 3, (9.7771 - c_acctbal / 500) / 2)"


@query("g05_intersects_bbox", f"SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE {LINE_MEETS}")
def g05_intersects_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.customers(spark, sf_dir).window(RECTANGLE.envelope()).filter(intersects_bbox()).df.select("id")


@query("g06_polygons", "SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_nationkey - 2 <= 15 AND s_nationkey + 2 >= 5 AND s_acctbal / 500 - 2 <= 12.003 AND s_acctbal / 500 + 2 >= 2.003 AND s_nationkey + s_acctbal / 500 - 4 <= 17.003")
def g06_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.suppliers(spark, sf_dir).intersecting(SMALL).df.select("id")


@query("g06_lines", f"SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE {LINE_MEETS}")
def g06_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.customers(spark, sf_dir).intersecting(RECTANGLE).df.select("id")


@query("g06_line_constant", "SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE greatest(0, (s_nationkey - 2 - 3.001) / 12, (s_acctbal / 500 - 2 - 1.003) / 9) <= least(1, (s_nationkey + 2 - 3.001) / 12, (s_acctbal / 500 + 2 - 1.003) / 9)")
def g06_line_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.suppliers(spark, sf_dir).intersecting(line((3.001, 1.003), (15.001, 10.003))).df.select("id")


@query("g07_explode", "SELECT id, x, y FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey % 100 + d AS DOUBLE) AS x, CAST(o_orderkey % 100 + d AS DOUBLE) AS y FROM orders, (VALUES (0), (5)) AS v(d)) WHERE x BETWEEN 20 AND 40 AND y BETWEEN 30 AND 35")
def g07_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).window((20, 30, 40, 35)).explode().df.select("id", F.col("xmin").alias("x"), F.col("ymin").alias("y"))


@query("g08_rectangle", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'POLYGON((' || x || ' ' || y || ',' || x + 5 || ' ' || y || ',' || x + 5 || ' ' || y + 5 || ',' || x || ' ' || y + 5 || ',' || x || ' ' || y || '))' AS wkt FROM (SELECT o_orderkey, o_custkey % 100 AS x, o_orderkey % 100 AS y FROM orders)")
def g08_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).df.select("id", ewkt(rectangle_of(*map(F.col, BOX))).alias("wkt"))


@query("g09_envelope", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_nationkey - 2.0::DOUBLE AS a, s_acctbal / 500 - 2 AS b, s_nationkey + 2.0::DOUBLE AS c, s_acctbal / 500 + 2 AS d FROM supplier")
def g09_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.suppliers(spark, sf_dir).df.select("id", envelope_array(F.col("geometry")).alias("e")).select("id", *[F.get("e", F.lit(k)).alias(n) for k, n in enumerate("abcd")])


@query("g10_srid", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 4326 ELSE 31370 END AS srid FROM orders")
def g10_srid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second geometry names its own reference system, the others inherit the collection's."""
    df = tables.orders(spark, sf_dir).df
    g = F.when(F.col("id").cast("long") % 2 == 0, F.col("geometry").withField("srid", F.lit(4326))).otherwise(F.col("geometry"))
    return df.select("id", g.alias("g")).select("id", decode(F.parse_json(encode(F.col("g"))), srid=31370)["srid"].alias("srid"))


# Sources and sinks.


@query("s01_scan", f"SELECT {ID}, CAST(user_id AS DOUBLE) AS xmin, value AS ymin, event_type FROM events")
def s01_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.events(spark, sf_dir)
    return f.df.select("id", "xmin", "ymin", f.get(TYPE).alias("event_type"))


@query("s02_registered_scan", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, CAST(p_size AS DOUBLE) AS xmin FROM part")
def s02_registered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = FeatureFrame(tables.part_features(spark, sf_dir))
    return f.df.select("id", f.get("properties.p_name").alias("name"), f.get("properties.p_size", "long").alias("size"), f.get("properties.p_retailprice", "double").alias("price"), "xmin")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.to_line(tables.events(spark, sf_dir, spread=True).df)


@query("s03_import_lines", f"SELECT {ID}, CAST(user_id AS DOUBLE) AS xmin, event_type, NULL AS reason FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT NULL, NULL, NULL, 'no JSON' FROM events WHERE event_id % 11 = 0")
def s03_import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh line is cut off; some lines are JSON but no object."""
    lines = tables.events(spark, sf_dir, spread=True).df
    text = io.to_line(lines, keep=("id",)).select(F.when(F.col("id").cast("long") % 11 == 0, F.expr("left(value, length(value) - 3)")).otherwise(F.col("value")).alias("value"))
    path = work(spark)
    text.unionByName(lines.select(F.concat(F.lit("["), F.col("id"), F.lit("]")).alias("value"))).write.text(path)
    f = FeatureFrame(io.read_lines(spark, path, id_type="decimal").both)
    return f.df.select("id", "xmin", f.get(TYPE).alias("event_type"), "reason")


@query("s04_decode", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'LineString' AS type, 1 AS n, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_nationkey + 3 AS DOUBLE) AS x2 FROM customer UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'MultiPoint', 2, CAST(o_custkey % 100 AS DOUBLE), CAST(o_custkey % 100 + 5 AS DOUBLE) FROM orders UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'Polygon', 1, CAST(s_nationkey - 2 AS DOUBLE), CAST(s_nationkey + 2 AS DOUBLE) FROM supplier")
def s04_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for f in (tables.customers(spark, sf_dir), tables.orders(spark, sf_dir), tables.suppliers(spark, sf_dir)):
        df = f.df.select("id", F.parse_json(encode(F.col("geometry"))).alias("g")).select("id", decode(F.col("g")).alias("geometry"))
        df = with_envelope(df).select("id", F.col("geometry.type").alias("type"), F.size("geometry.parts").alias("n"), F.col("xmin").alias("x"), F.col("xmax").alias("x2"))
        out = df if out is None else out.unionByName(df)
    return out


@query("s05_validate", "SELECT 'decimal' AS id_type, NULL AS reason, count(*) AS n FROM events UNION ALL SELECT 'text', 'no id of type text', count(*) FROM events")
def s05_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for kind in io.ID_TYPES:
        both = io.parse(_lines(spark, sf_dir), id_type=kind).both
        out.append(both.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(kind).alias("id_type"), "reason", "n"))
    return out[0].unionByName(out[1])


@query("s06_encode", """SELECT CAST(o_orderkey AS VARCHAR) AS id, '{"type":"MultiPoint","bbox":[' || x || '.0,' || y || '.0,' || x + 5 || '.0,' || y + 5 || '.0],"coordinates":[[' || x || '.0,' || y || '.0],[' || x + 5 || '.0,' || y + 5 || '.0]]}' AS json FROM (SELECT o_orderkey, o_custkey % 100 AS x, o_orderkey % 100 AS y FROM orders)""")
def s06_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).df.select("id", encode(F.col("geometry")).alias("json"))


@query("s07_strip_and_reassemble", f"SELECT {ID}, true AS line_has, false AS doc_has, event_type FROM events")
def s07_strip_and_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select(F.parse_json("value").alias("v"))
    has = lambda c: F.coalesce(F.try_variant_get(c, "$.geometry.type", "string") == "Point", F.lit(False))
    return lines.select(F.try_variant_get("v", "$.id", "string").alias("id"), has(F.col("v")).alias("line_has"), has(io.strip_geometry(F.col("v"))).alias("doc_has"), F.try_variant_get("v", "$.properties.event_type", "string").alias("event_type"))


@query("s08_line_sink", f"SELECT {ID}, event_type, CAST(user_id AS DOUBLE) AS x FROM events WHERE event_type = 'click'")
def s08_line_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work(spark)
    io.write_lines(tables.events(spark, sf_dir).filter(prop(TYPE).eq("click")).df, path)
    v = spark.read.text(path).select(F.parse_json("value").alias("v"))
    return v.select(*[F.try_variant_get("v", p, t).alias(n) for p, t, n in (("$.id", "string", "id"), ("$.properties.event_type", "string", "event_type"), ("$.geometry.coordinates[0]", "double", "x"))])


@query("s09_feature_collection", f"SELECT id, total FROM (SELECT {ID}, count(*) OVER () AS total FROM events WHERE event_type = 'click') ORDER BY id LIMIT 10 OFFSET 20")
def s09_feature_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = io.feature_collection(tables.events(spark, sf_dir).filter(prop(TYPE).eq("click")).page(20, 10))
    return page.select(F.try_variant_get(F.parse_json("value"), "$.id", "string").alias("id"), "total")


@query("s09_empty_page", "SELECT CAST(NULL AS VARCHAR) AS value, count(*) AS total FROM events WHERE event_type = 'click'")
def s09_empty_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page beyond the end still has its total."""
    return io.feature_collection(tables.events(spark, sf_dir).filter(prop(TYPE).eq("click")).sort_by(USER).page(10**9, 10))


@query("s10_csv", """SELECT CAST(o_orderkey AS VARCHAR) || ';"MULTIPOINT((' || o_custkey % 100 || ' ' || o_orderkey % 100 || '),(' || o_custkey % 100 + 5 || ' ' || o_orderkey % 100 + 5 || '))";"' || strftime(o_orderdate, '%Y-%m-%d') || '";"' || o_orderstatus || '"' AS value FROM orders""")
def s10_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.csv_lines(tables.orders(spark, sf_dir).df, separator=";")[1]


@query("s11_ewkt", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'SRID=4326;MULTIPOINT((' || o_custkey % 100 || ' ' || o_orderkey % 100 || '),(' || o_custkey % 100 + 5 || ' ' || o_orderkey % 100 + 5 || '))' AS wkt FROM orders")
def s11_ewkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).df.select("id", ewkt(F.col("geometry").withField("srid", F.lit(4326))).alias("wkt"))


# Collections.


def _stored(spark: SparkSession, df: DataFrame) -> str:
    name, path = f"lithosift_{uuid.uuid4().hex}", work(spark)
    df.write.parquet(path)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    return name


def _dropped(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """df, which has read the table's files, without the table in the catalog; the files stay."""
    spark.sql(f"DROP TABLE {name}")
    return df


def _unlisted(c: Collection, df: DataFrame) -> DataFrame:
    """The same for a collection's parts."""
    c.unlist()
    return df


@query("c01_create", "SELECT 'typed' AS mode, 'decimal' AS id_type, count(*) AS n, CAST(min(user_id) AS DOUBLE) AS xmin FROM events")
def c01_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"lithosift_{uuid.uuid4().hex}"
    catalog.create_collection(spark, name, (0, 0, 1000, 1000), id_type="decimal", path=work(spark))
    table = catalog.Table(spark, name)
    table.insert(tables.events(spark, sf_dir).df)
    m = catalog.metadata(spark, name, count=False)
    df = _unlisted(table.states, catalog.collection(spark, name).df)
    spark.sql(f"DROP VIEW {name}")
    return df.agg(F.lit(m["mode"]).alias("mode"), F.lit(m["id_type"]).alias("id_type"), F.count("*").alias("n"), F.min("xmin").alias("xmin"))


@query("c02_register", "SELECT 'decimal' AS id_type, p_partkey, p_name FROM part WHERE p_size > 40")
def c02_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _stored(spark, tables.parts(spark, sf_dir).df)
    catalog.register(spark, name, "p_partkey", "geometry")
    f = catalog.collection(spark, name).filter(prop("p_size").gt(40))
    kind = catalog.metadata(spark, name, count=False)["id_type"]
    return _dropped(spark, name, f.df).select(F.lit(kind).alias("id_type"), "p_partkey", "p_name")


@query("c03_metadata", "SELECT 'plain' AS mode, 4326 AS srid, count(*) AS n FROM part")
def c03_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _stored(spark, tables.parts(spark, sf_dir).df)
    catalog.register(spark, name, "p_partkey", "geometry", srid=4326)
    m = catalog.metadata(spark, name)
    return _dropped(spark, name, catalog.collection(spark, name).df).agg(F.lit(m["mode"]).alias("mode"), F.lit(m["srid"]).alias("srid"), F.count("*").alias("n")).filter(F.col("n") == m["count"])


@query("c04_extent", "SELECT CAST(min(c_nationkey) AS DOUBLE) AS xmin, min(c_acctbal / 500) AS ymin, CAST(max(c_nationkey) + 3 AS DOUBLE) AS xmax, max(c_acctbal / 500 + 2) AS ymax, true AS inside FROM customer")
def c04_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.extent_check(tables.customers(spark, sf_dir), (-5, -5, 40, 40))


@query("c05_layout", f"SELECT {ID} FROM events WHERE event_type = 'click' AND value < 12")
def c05_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = catalog.optimize_layout(tables.events(spark, sf_dir), [(TYPE, "string"), (VALUE, "number")], work(spark))
    return f.filter(prop(TYPE).eq("click") & prop(VALUE).lt(12)).df.select("id")


@query("c06_space_layout", f"SELECT {ID} FROM events WHERE user_id BETWEEN 40 AND 60 AND value BETWEEN 20 AND 45 AND {IN_TRIANGLE}")
def c06_space_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted along a curve over the envelopes; the window's statistics skip row groups, the triangle is tested exactly."""
    f = catalog.optimize_layout(tables.events(spark, sf_dir), [], work(spark), by_space=True)
    return f.window((40, 20, 60, 45)).intersecting(TRIANGLE).df.select("id")


@query("c07_layout_and_writes", f"SELECT {ID}, event_id % 4 = 1 AS changed FROM events WHERE (event_type = 'click' OR event_id % 4 = 1) AND value < 50")
def c07_layout_and_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout of three quarters of the events; the last quarter is inserted later, then a quarter becomes clicks."""
    name, f = f"lithosift_{uuid.uuid4().hex}", tables.events(spark, sf_dir, spread=True)
    rest = F.col("id").cast("long") % 4
    catalog.create_collection(spark, name, (0, 0, 1000, 1000), id_type="decimal", path=work(spark))
    table = catalog.Table(spark, name)
    table.insert(f.df.filter(rest != 0))
    catalog.put_layout(spark, name, "clicks", [(TYPE, "string"), (VALUE, "number")], work(spark))
    table.insert(f.df.filter(rest == 0))
    doc = F.parse_json(F.concat(F.lit('{"properties":{"event_type":"click","new":true,"value":'), f.get(VALUE), F.lit("}}")))
    table.upsert(f.df.filter(rest == 1).withColumn("doc", doc))
    seen = catalog.collection(spark, name, "clicks").filter(prop(TYPE).eq("click") & prop(VALUE).lt(50))
    df = seen.df.select("id", F.coalesce(seen.get("properties.new", "boolean"), F.lit(False)).alias("changed"))
    spark.sql(f"DROP VIEW {name}")
    return _unlisted(table.states, df)


# Projection.


@query("p01_path", f"SELECT {ID}, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS gone FROM events")
def p01_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.events(spark, sf_dir).select(Path("properties.props.k", "long"), Path("properties.none.deep", "string"))
    return p.select("id", F.col("feature.properties.props.k").alias("k"), F.col("feature.properties.none.deep").alias("gone"))


@query("p02_array", f"SELECT {ID}, user_id % 3 AS n0, event_type AS t0, 0 AS missing FROM events")
def p02_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.events(spark, sf_dir).select(Each("properties.tags", Path("n", "long"), Path("t", "string")), Each("properties.value", Path("x")))
    return p.select("id", F.get("feature.properties.tags", F.lit(0))["n"].alias("n0"), F.get("feature.properties.tags", F.lit(0))["t"].alias("t0"), F.size("feature.properties.value").alias("missing"))


@query("p03_nested_array", "SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n, sum(l_partkey) AS parts, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey")
def p03_nested_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.items(spark, sf_dir).select(Each("properties.items", Path("partkey", "long"), Path("more.flag", "string")))
    items = F.col("feature.properties.items")
    return p.select("id", F.size(items).cast("long").alias("n"), F.aggregate(items, F.lit(0).cast("long"), lambda a, i: a + i["partkey"]).alias("parts"), F.size(F.filter(items, lambda i: i["more"]["flag"] == "R")).cast("long").alias("returned"))


@query("p04_merge", f"SELECT {ID}, event_type, user_id, value FROM events")
def p04_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.events(spark, sf_dir).select(Path(TYPE, "string"), Path(USER, "long"), Path(TYPE, "string"), Path(VALUE, "double"))
    return p.select("id", "feature.properties.*")


@query("p05_always", f"SELECT {ID}, CAST(event_id AS VARCHAR) AS feature_id, 'Feature' AS type, 'Point' AS shape FROM events")
def p05_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.events(spark, sf_dir).select()
    return p.select("id", F.col("feature.id").alias("feature_id"), "feature.type", F.col("geometry.type").alias("shape"))


@query("p06_flatten", f"SELECT {ID}, event_type || '|' || user_id || '|' || json_extract_string(props, '$.k') AS flat FROM events")
def p06_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.events(spark, sf_dir)
    keys = [k for k, _ in flatten(f.df, under="properties") if k.rsplit(".")[-1] in ("event_type", "user_id", "k")]
    keys.sort(key=lambda k: ("event_type", "user_id", "k").index(k.rsplit(".")[-1]))
    return f.df.select("id", F.concat_ws("|", *[f.get(k) for k in keys]).alias("flat"))


@query("p07_resolver", f"SELECT {ID}, event_type AS typed, event_type AS text, user_id AS number FROM events")
def p07_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.events(spark, sf_dir)
    return f.df.select("id", f.get(TYPE).alias("typed"), FeatureFrame(f.df, mode="text").binding.text(TYPE).alias("text"), f.get(USER, "long").alias("number"))


@query("p08_view_projection", f"SELECT {ID}, event_type, value FROM events WHERE event_type = 'click'")
def p08_view_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.events(spark, sf_dir)
    return _views(f).apply(f, "events", "clicks").select(Path(VALUE, "double")).select("id", "feature.properties.*")


# Aggregates.


@query("a01_count", "SELECT count(*) AS total FROM orders")
def a01_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).count()


@query("a02_total", "SELECT count(*) AS total FROM events WHERE event_type = 'click' AND user_id BETWEEN 10 AND 60 AND value BETWEEN 5 AND 20")
def a02_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).window((10, 5, 60, 20)).filter(prop(TYPE).eq("click")).sort_by(VALUE).page(5, 5).count()


@query("a03_distinct", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'error' AND user_id BETWEEN 3 AND 90")
def a03_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).window((3, 0, 90, 1000)).filter(prop(TYPE).eq("error")).distinct(USER)


@query("a04_written", "SELECT count(*) AS written FROM events WHERE event_type = 'click'")
def a04_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Collection(spark, work(spark))
    n = c.insert(tables.events(spark, sf_dir).filter(prop(TYPE).eq("click")).df)
    return _unlisted(c, c.read()).agg(F.count("*").alias("written")).filter(F.col("written") == n)


# Order and pages.


@query("o01_sort", f"SELECT id FROM (SELECT {ID}, user_id, event_type FROM events) ORDER BY event_type DESC NULLS FIRST, CAST(user_id AS VARCHAR) ASC NULLS LAST, id LIMIT 50")
def o01_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).sort_by(TYPE, USER, directions=["DESC", "ASC"]).page(None, 50).rows().select("id")


@query("o02_directions", f"SELECT id FROM (SELECT {ID}, user_id, event_type FROM events) ORDER BY CAST(user_id AS VARCHAR) DESC NULLS FIRST, event_type, id LIMIT 40")
def o02_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).sort_by(USER, TYPE, directions=["DESC"]).page(None, 40).rows().select("id")


@query("o03_default_order", f"SELECT id FROM (SELECT {ID} FROM events) ORDER BY id LIMIT 25")
def o03_default_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).page(None, 25).rows().select("id")


@query("o04_limit", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC NULLS FIRST, p_partkey LIMIT 30")
def o04_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parts(spark, sf_dir).sort_by("p_retailprice", directions=["desc"]).page(None, 30).rows().select("p_partkey")


@query("o05_offset", f"SELECT id FROM (SELECT {ID} FROM events WHERE event_type = 'click') ORDER BY id OFFSET 100")
def o05_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).filter(prop(TYPE).eq("click")).page(100).rows().select("id")


@query("o06_stable_page", f"SELECT id FROM (SELECT {ID}, event_type FROM events) ORDER BY event_type, id LIMIT 20 OFFSET 35")
def o06_stable_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).sort_by(TYPE).page(35, 20).rows().select("id")


@query("o07_deep_page", f"SELECT id FROM (SELECT {ID}, event_type, user_id FROM events) ORDER BY event_type DESC NULLS FIRST, CAST(user_id AS VARCHAR), id OFFSET 3000")
def o07_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the three thousandth event on: the rows before it are counted by ranges of keys, not sorted."""
    f = tables.events(spark, sf_dir).sort_by(TYPE, USER, directions=["DESC", "ASC"])
    return after_offset(f.df, [*f.order, (F.col("id"), False)], 3000, few=500).select("id")


# Writes: the state afterwards.


@query("w01_insert", f"SELECT {ID}, event_type FROM events")
def w01_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = Collection(spark, work(spark)), tables.events(spark, sf_dir)
    c.insert(f.filter(prop(TYPE).eq("click")).df)
    c.insert(f.filter(prop(TYPE).ne("click")).df)
    return _unlisted(c, c.read()).select("id", f.get(TYPE).alias("event_type"))


@query("w02_upsert", f"SELECT {ID}, CASE WHEN event_id % 10 = 3 THEN 'new' WHEN event_id % 10 = 4 THEN 'last' ELSE event_type END AS event_type FROM events")
def w02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the ids changes once, a tenth twice in the same load."""
    f = tables.events(spark, sf_dir)
    number = F.col("id").cast("long") % 10
    doc = lambda t: F.parse_json(F.lit('{"type":"Feature","properties":{"event_type":"%s"}}' % t))
    new = f.df.filter(number.isin(3, 4)).withColumn("doc", doc("new")).withColumn("n", F.lit(1))
    new = new.unionByName(f.df.filter(number == 4).withColumn("doc", doc("last")).withColumn("n", F.lit(2)))
    return writes.upserted(f.df, new, order="n").select("id", f.get(TYPE).alias("event_type"))


@query("w03_delete", f"SELECT {ID} FROM events WHERE NOT (event_type = 'click' AND value > 10)")
def w03_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.deleted(tables.events(spark, sf_dir).df, prop(TYPE).eq("click") & prop(VALUE).gt(10)).select("id")


@query("w04_update", f"SELECT {ID}, CASE WHEN event_type = 'click' THEN 'done' ELSE event_type END AS event_type, CASE WHEN event_type = 'click' THEN 1.0 ELSE CAST(user_id AS DOUBLE) END AS xmin FROM events")
def w04_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.events(spark, sf_dir)
    line = spark.range(1).select(F.lit('{"id":1,"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"event_type":"done"}}').alias("value"))
    feature = io.parse(line, id_type="decimal").features
    return writes.updated(f.df, prop(TYPE).eq("click"), feature).select("id", f.get(TYPE).alias("event_type"), "xmin")


@query("w06_collection", f"""SELECT {ID}, CASE WHEN event_id % 6 IN (1, 2) THEN 'moved' ELSE event_type END AS event_type, CASE WHEN event_id % 6 = 2 THEN 1.0 ELSE CAST(user_id AS DOUBLE) END AS xmin FROM events
WHERE NOT (event_id % 6 = 4 AND event_type = 'click')""")
def w06_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection through all its changes: two inserts, two upserts, a delete and an update; merged by id when it is read."""
    c, f = Collection(spark, work(spark)), tables.events(spark, sf_dir)
    six = F.col("id").cast("long") % 6
    doc = lambda t: F.parse_json(F.concat(F.lit('{"properties":{"event_type":"'), t, F.lit('","six":'), six.cast("string"), F.lit("}}")))
    rows = f.df.withColumn("doc", doc(f.get(TYPE)))
    c.insert(rows.filter(six < 3))
    c.insert(rows.filter(six >= 3))
    c.upsert(rows.filter(six < 2).withColumn("doc", doc(F.lit("moved"))))
    c.upsert(rows.filter(six == 0))
    c.delete(prop("properties.six").eq(4) & prop(TYPE).eq("click"))
    line = spark.range(1).select(F.lit('{"id":1,"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"event_type":"moved"}}').alias("value"))
    c.update(prop("properties.six").eq(2), io.parse(line, id_type="decimal").features)
    return _unlisted(c, c.read()).select("id", f.get(TYPE).alias("event_type"), "xmin")


@query("w05_id", f"SELECT {ID} FROM events UNION ALL SELECT 'k' || CAST(event_id AS VARCHAR) FROM events")
def w05_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are numbers in the one load and strings in the other. Both read the same shuffled lines, so these are made once."""
    lines = _lines(spark, sf_dir).repartition("value")
    text = lines.select(F.regexp_replace("value", r'"id":(\d+)', r'"id":"k$1"').alias("value"))
    return io.parse(lines, id_type="decimal").features.select("id").unionByName(io.parse(text, id_type="text").features.select("id"))


# Views and streams.


@query("v01_put_view", f"SELECT {ID}, event_type FROM events WHERE event_type = 'click'")
def v01_put_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(tables.events(spark, sf_dir), in_sql=True)
    seen = spark.sql('SELECT id, try_variant_get(doc, "$.properties.event_type", "string") AS event_type FROM clicks')
    spark.catalog.dropTempView("clicks")  # seen holds its plan
    return seen


@query("v02_query_view", f"SELECT id, event_type, user_id FROM (SELECT {ID}, event_type, user_id FROM events WHERE event_type = 'click' AND user_id > 20) ORDER BY CAST(user_id AS VARCHAR), id LIMIT 15")
def v02_query_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.events(spark, sf_dir)
    seen = _views(f).apply(f, "events", "clicks").filter(prop(USER).gt(20)).sort_by(USER).page(0, 15)
    return seen.select(Path(USER, "long")).select("id", "feature.properties.*")


@query("t01_stream_ingest", f"SELECT {ID}, CASE WHEN event_id % 4 = 0 THEN 'late' ELSE event_type END AS event_type FROM events")
def t01_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of files; the second changes every fourth event."""
    from .streaming.ingest import ingest

    root, f = work(spark), tables.events(spark, sf_dir, spread=True)
    target = Collection(spark, f"{root}/collection")
    late = f.df.filter(F.col("id").cast("long") % 4 == 0).withColumn("doc", F.parse_json(F.concat(F.lit('{"type":"Feature","id":'), F.col("id"), F.lit(',"properties":{"event_type":"late"}}'))))
    for load in (f.df, late):
        io.to_line(load).write.mode("append").text(f"{root}/in")
        ingest(spark, f"{root}/in", target, f"{root}/state", id_type="decimal", once=True).awaitTermination()
    return _unlisted(target, target.read()).select("id", f.get(TYPE).alias("event_type"))


@query("flagship_page", f"SELECT id, event_type, value FROM (SELECT {ID}, event_type, value, user_id FROM events WHERE user_id BETWEEN 10 AND 60 AND value BETWEEN 5 AND 20 AND event_type = 'click' AND value > 6) ORDER BY CAST(user_id AS VARCHAR), id LIMIT 10 OFFSET 10")
def flagship_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks in a window, ordered, the second page of ten, projected."""
    f = tables.events(spark, sf_dir).window((10, 5, 60, 20)).filter(prop(TYPE).eq("click") & prop(VALUE).gt(6)).sort_by(USER).page(10, 10)
    return f.select(Path(TYPE, "string"), Path(VALUE, "double")).select("id", "feature.properties.*")
