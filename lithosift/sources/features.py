"""Features in: newline-delimited GeoJSON, registered tables, validation. Features out: GeoJSON lines, collections, CSV."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import GEOMETRY, decode, encode, ewkt, let
from ..functions.paths import steps, value_at
from ..operators.frame import BOX, FeatureFrame, with_envelope
from ..operators.projection import flatten

#: Characters of a line at most, unless said otherwise.
MAX_SIZE = 26_214_400
ID_TYPES = ("text", "decimal")
FEATURE = ["id", "geometry", *BOX, "doc"]


@dataclass(frozen=True)
class Import:
    """Features, and the lines that aren't: line, reason. both has the two in one pass: a feature's columns, line, reason; reason is null for features."""

    features: DataFrame
    rejects: DataFrame
    both: DataFrame

    def strict(self) -> DataFrame:
        """The features; reading them fails on the first reject."""
        bad = self.rejects.select(F.raise_error(F.concat(F.col("reason"), F.lit(": "), F.substring("line", 1, 200))).alias("e"))
        none = bad.agg(F.count("e").alias("__n"))  # one row
        return self.features.join(F.broadcast(none), F.col("__n") == 0).drop("__n")


#: Schemas of documents with numbers that may be written otherwise as text: doubles, decimals without places, values of several types.
_REWRITTEN = r"DOUBLE|FLOAT|VARIANT|DECIMAL\(\d+,0\)"


def strip_geometry(doc: Column) -> Column:
    """The document without its geometry, as it is stored: numbers as their text is read, so 1e2 and 100.0 are 100.

    Only documents that may have such numbers go through text, which takes several times as long.
    """
    kept = F.map_filter(F.try_variant_get(doc, "$", "map<string,variant>"), lambda k, _: k != "geometry")
    read = lambda v: F.parse_json(F.to_json(F.from_json(F.to_json(v), "map<string,variant>")))
    return let(F.to_variant_object(kept), lambda v: F.when(F.schema_of_variant(v).rlike(_REWRITTEN), read(v)).otherwise(v))


def parse(lines: DataFrame, id_type: str = "text", srid: int | None = None, max_size: int = MAX_SIZE, keep: Iterable[str] = ()) -> Import:
    """Features from a DataFrame with a column value, a line of GeoJSON each.

    Lines that are empty, or JSON but no object, are skipped; lines of more than max_size bytes (UTF-8), no JSON, without an id of the id type or without a
    readable geometry are rejects. A missing or null geometry is allowed and stays null.
    """
    if id_type not in ID_TYPES:
        raise ValueError(f"id type is one of {ID_TYPES}")
    rows = lines.select(F.col("value").alias("line"), *keep)
    rows = rows.withColumn("whole", F.when(F.octet_length("line") <= max_size, F.try_parse_json("line")))
    rows = rows.withColumns({"key": F.try_variant_get("whole", "$.id", "variant"), "shape": F.try_variant_get("whole", "$.geometry", "variant")})
    is_id = F.schema_of_variant("key").rlike(r"^(BIGINT|DECIMAL\(\d+,0\))" if id_type == "decimal" else "^STRING")
    none = F.col("shape").isNull() | F.is_variant_null("shape")
    rows = rows.withColumn("geometry", F.when(~none, decode(F.col("shape"), srid)))
    reason = (
        F.when(F.octet_length("line") > max_size, "too large").when(F.col("whole").isNull(), "no JSON").when(~F.coalesce(is_id, F.lit(False)), f"no id of type {id_type}")
        .when(~none & F.col("geometry").isNull(), "unreadable geometry")
    )
    # JSON is an object if it begins like one; the schema of the whole line isn't made for that.
    read = (F.trim("line") != "") & (F.col("whole").isNull() | F.col("line").rlike(r"^[ \t\r\n]*\{"))
    # Filters go below a projection and take its expressions along, but not below a generator: so each line is read once.
    rows = rows.select(*keep, F.inline(F.array(F.struct("line", "whole", "geometry", reason.alias("reason"), read.alias("read"))))).filter("read")
    ok = F.col("reason").isNull()
    both = rows.select(F.when(ok, F.try_variant_get("whole", "$.id", "string")).alias("id"), F.when(ok, F.col("geometry")).alias("geometry"), F.when(ok, strip_geometry(F.col("whole"))).alias("doc"), "line", "reason", *keep)
    both = with_envelope(both).select(*FEATURE, "line", "reason", *keep)
    return Import(both.filter(ok).select(*FEATURE, *keep), both.filter(~ok).select("line", "reason"), both)


def read_lines(spark: SparkSession, path: str, **options) -> Import:
    return parse(spark.read.text(path), **options)


def from_table(df: DataFrame, key: str, geometry: Column, srid: int | None = None) -> DataFrame:
    """Features from any table: the id as text, every other column but geometries a property of its own type."""
    drop = {key, *(f.name for f in df.schema.fields if f.dataType.simpleString() == GEOMETRY)}
    rest = F.struct(*[F.col(c) for c in df.columns if c not in drop])
    doc = F.to_variant_object(F.struct(F.col(key).cast("string").alias("id"), F.lit("Feature").alias("type"), rest.alias("properties")))
    return with_envelope(df.select(F.col(key).cast("string").alias("id"), geometry.alias("geometry"), doc.alias("doc"))).select(*FEATURE)


def id_type_of(df: DataFrame, key: str) -> str:
    """text or decimal, from the key's column type."""
    return "decimal" if dict(df.dtypes)[key].startswith(("bigint", "int", "smallint", "tinyint", "decimal")) else "text"


def to_line(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Column value: each feature as a line of GeoJSON, its geometry put back; and the columns to keep."""
    body = F.regexp_replace(F.to_json("doc"), r"\}$", "")
    geometry = F.coalesce(encode(F.col("geometry")), F.lit("null"))
    comma = F.when(body == "{", "").otherwise(",")
    return df.select(F.concat(body, comma, F.lit('"geometry":'), geometry, F.lit("}")).alias("value"), *keep)


def write_lines(df: DataFrame, path: str) -> None:
    to_line(df).write.text(path)


def feature_collection(frame: FeatureFrame) -> DataFrame:
    """The page's features with the total beside each: value, total; of an empty page one row without a value. The total ignores order and page."""
    return to_line(frame.rows()).join(F.broadcast(frame.count()), F.lit(True), "right")  # the total is one row


def write_collection(frame: FeatureFrame, path: str) -> None:
    """A folder with the page as GeoJSON lines in features/ and its totals in collection/: {"type", "total", "count"}."""
    to_line(frame.rows()).write.text(f"{path}/features")
    page = frame.rows().agg(F.count("*").alias("count"))
    frame.count().crossJoin(F.broadcast(page)).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "total", "count")).alias("value")).write.text(f"{path}/collection")


def write_document(frame: FeatureFrame, path: str) -> None:
    """The page as one GeoJSON document, {"type": "FeatureCollection", "total", "features"}: a folder with a single part, streamed by one task."""
    head = frame.count().select(F.concat(F.lit('{"type":"FeatureCollection","total":'), F.col("total").cast("string"), F.lit(',"features":[')).alias("value"))
    first = F.monotonically_increasing_id() == 0
    features = to_line(frame.rows()).coalesce(1).select(F.concat(F.when(first, "").otherwise(","), "value").alias("value"))
    tail = frame.df.sparkSession.range(1).select(F.lit("]}").alias("value"))
    head.coalesce(1).unionByName(features).unionByName(tail).coalesce(1).write.text(path)


def csv_columns(df: DataFrame) -> list[tuple[str, str]]:
    """The flattened properties of all features, sorted."""
    return flatten(df, under="properties")


def _quoted(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"[\r\n]", " "), '"', '""'), F.lit('"')))


def _csv(columns: list[tuple[str, str]]) -> list[tuple[str, Column]]:
    """(name, value) of each column; names needn't differ."""
    out = [("id", F.col("id")), ("geometry-wkt", _quoted(ewkt(F.col("geometry"))))]
    for path, kind in columns:
        c = value_at(F.col("doc"), path, "string")
        out.append((".".join(steps(path)[1:]), _quoted(c) if kind == "string" else c))
    return out


def to_csv(df: DataFrame, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """id, geometry-wkt and the properties, one column each; text in quotes, line ends as spaces, null as nothing."""
    return df.select(*[c.alias(n) for n, c in _csv(csv_columns(df) if columns is None else columns)])


def csv_lines(df: DataFrame, separator: str = ",", columns: list[tuple[str, str]] | None = None) -> tuple[str, DataFrame]:
    """The header, and a column value with a line per feature. A name with a separator, quotes or line ends stands in quotes."""
    made = _csv(csv_columns(df) if columns is None else columns)
    plain = lambda n: n if not any(c in n for c in (separator, '"', "\r", "\n")) else '"' + re.sub(r"[\r\n]", " ", n).replace('"', '""') + '"'
    return separator.join(plain(n) for n, _ in made), df.select(F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for _, c in made]).alias("value"))


def write_csv(df: DataFrame, path: str, separator: str = ",", columns: list[tuple[str, str]] | None = None) -> None:
    """A folder of CSV parts, each with the header."""
    header, lines = csv_lines(df, separator, columns)
    # One column whose name is the header line; the separator given here is in none of them.
    lines.toDF(header).write.option("sep", "\u0001").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
