"""Collections, their saved views and layouts in Spark's catalog.

A collection is a table; what is declared for it, its views and its layouts are table properties, so they outlive the session. A table
that create_collection() made becomes, with the first write, a view of the current state of a versioned Collection: a write commits a
state there and then changes the view's text, so nothing is written but what the change brings.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import GEOMETRY
from ..functions.numbers import EXACT, number_key
from ..functions.paths import is_kind_of, steps
from ..functions.predicates import Predicate, from_spec, odd_column
from ..functions.spatial import curve
from ..operators.frame import FeatureFrame
from ..operators.projection import Each, Path
from ..operators.writes import Collection
from ..sources.features import ID_TYPES, id_type_of

PREFIX = "features."
FEATURE_SCHEMA = f"id STRING, geometry {GEOMETRY}, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, doc VARIANT"


class AlreadyRegistered(ValueError):
    pass


def _set(spark: SparkSession, table: str, values: dict) -> None:
    text = lambda v: json.dumps(v).replace("\\", "\\\\").replace("'", "\\'")
    pairs = ", ".join(f"'{PREFIX}{k}' = '{text(v)}'" for k, v in values.items())
    spark.sql(f"ALTER {_kind(spark, table)} {table} SET TBLPROPERTIES ({pairs})")


def _kind(spark: SparkSession, table: str) -> str:
    return "VIEW" if spark.catalog.getTable(table).tableType == "VIEW" else "TABLE"


def _unset(spark: SparkSession, table: str, key: str) -> None:
    spark.sql(f"ALTER {_kind(spark, table)} {table} UNSET TBLPROPERTIES IF EXISTS ('{PREFIX}{key}')")


def _properties(spark: SparkSession, table: str) -> dict:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()  # a handful
    return {r.key.removeprefix(PREFIX): json.loads(r.value) for r in rows if r.key.startswith(PREFIX)}


def create_collection(spark: SparkSession, table: str, extent: tuple[float, float, float, float], id_type: str = "text", srid: int | None = None, mode: str = "typed", path: str | None = None, buckets: int | None = None) -> None:
    """An empty table of features with its declared extent. Its versions are in path, by default beside the table's own folder, in that many buckets by id."""
    if id_type not in ID_TYPES:
        raise ValueError(f"id type is one of {ID_TYPES}")
    spark.sql(f"CREATE TABLE {table} ({FEATURE_SCHEMA}) USING parquet" + (f" LOCATION '{path}/empty'" if path else ""))
    own = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first().data_type
    _set(spark, table, {"extent": list(extent), "id_type": id_type, "srid": srid, "mode": mode, "id": "id", "geometry": "geometry", "versions": path or f"{own.rstrip('/')}-versions", "buckets": buckets})


def register(spark: SparkSession, table: str, key: str, geometry: str, extent: tuple | None = None, srid: int | None = None) -> None:
    """Makes an existing table with a key and a geometry column a collection in plain mode."""
    if metadata(spark, table, count=False):
        raise AlreadyRegistered(table)
    df = spark.table(table)
    missing = {key, geometry} - set(df.columns)
    if missing:
        raise ValueError(f"{table} has no column {', '.join(sorted(missing))}")
    _set(spark, table, {"extent": extent and list(extent), "id_type": id_type_of(df, key), "srid": srid, "mode": "plain", "id": key, "geometry": geometry})


def metadata(spark: SparkSession, table: str, count: bool = True) -> dict:
    """What is declared for a collection, and its row count; empty if the table isn't one."""
    out = {k: v for k, v in _properties(spark, table).items() if k not in ("versions", "buckets") and "." not in k}
    if out and count:
        out["count"] = spark.table(table).count()
    return out


def collection(spark: SparkSession, table: str, layout: str | None = None) -> FeatureFrame:
    """The table as a frame; with the name of a layout, the rows of that layout, if it is of the table's current state."""
    p = _properties(spark, table)
    if not p:
        raise ValueError(f"{table} is not a collection")
    options = {"mode": p["mode"], "id": p["id"], "geometry": p["geometry"], "srid": p["srid"]}
    if layout is not None:
        known = p[f"layout.{layout}"]
        laid = _laid(spark, table, p, known)
        if laid is not None:
            return FeatureFrame(laid, ready=tuple(map(tuple, known["ready"])), **options)
    return FeatureFrame(spark.table(table), **options)


def _versions(spark: SparkSession, table: str, p: dict) -> Collection | None:
    """The states of a table that was written to."""
    return Collection(spark, p["versions"], p["buckets"]) if "versions" in p and _kind(spark, table) == "VIEW" else None


def _laid(spark: SparkSession, table: str, p: dict, known: dict) -> DataFrame | None:
    """The table's rows, as far as possible those of the layout. Rows that were written later are marked as odd, so they are compared as without it.

    None if what the layout was made from is gone (put together with other parts, or a table's files changed).
    """
    rows = spark.read.parquet(known["path"])
    states = _versions(spark, table, p)
    if states is None:
        return rows if known["state"] == _state(spark, table) else None
    if known["parts"] is None:
        return None
    more = {}
    for _, c, _ in known["ready"]:
        more |= {c: F.lit(None).cast(rows.schema[c].dataType), odd_column(c): F.lit(True)}
    return states.since(rows, known["parts"], states.state(), more)


# Writes.


class Table:
    """Insert, upsert, delete and update on a table that create_collection() made; each returns the number of features."""

    def __init__(self, spark: SparkSession, table: str):
        p = _properties(spark, table)
        if "versions" not in p:
            raise ValueError(f"{table} was not made by create_collection()")
        self.spark, self.table, self.mode = spark, table, p["mode"]
        self.states = Collection(spark, p["versions"], p["buckets"])
        if self.states.version() is None:
            self.states.replace(spark.table(table))
        if _kind(spark, table) == "TABLE":
            spark.sql(f"DROP TABLE {table}")
            spark.sql(f"CREATE VIEW {table} AS {self.states.sql()}")
            _set(spark, table, p)

    def _moved(self, n: int) -> int:
        """The view follows the state."""
        version = None
        while version != (version := self.states.version()):
            self.spark.sql(f"ALTER VIEW {self.table} AS {self.states.sql(self.states.state(version))}")
        return n

    def insert(self, new: DataFrame) -> int:
        return self._moved(self.states.insert(new))

    def upsert(self, new: DataFrame, order: str | None = None) -> int:
        return self._moved(self.states.upsert(new, order))

    def delete(self, predicate: Predicate) -> int:
        return self._moved(self.states.delete(predicate, mode=self.mode))

    def update(self, predicate: Predicate, feature: DataFrame) -> int:
        return self._moved(self.states.update(predicate, feature, mode=self.mode))


def drop_collection(spark: SparkSession, table: str) -> None:
    """Drops the table; of one that create_collection() made all versions too."""
    p = _properties(spark, table)
    spark.sql(f"DROP {_kind(spark, table)} {table}")
    if "versions" in p:
        Collection(spark, p["versions"]).drop()


# Views.


def _item(item) -> dict:
    if isinstance(item, str):
        return {"path": item, "type": "variant"}
    return {"path": item.path, "members": [_item(m) for m in item.members]} if isinstance(item, Each) else {"path": item.path, "type": item.type}


def _from_item(item: dict):
    return Each(item["path"], *map(_from_item, item["members"])) if "members" in item else Path(item["path"], item["type"])


def put_view(spark: SparkSession, table: str, name: str, predicate: Predicate | None = None, items: tuple = ()) -> str:
    """Saves a predicate and a projection under a name with the collection; 'created' or 'replaced'."""
    for item in items:
        steps(item if isinstance(item, str) else item.path)
    known = f"view.{name}" in _properties(spark, table)
    _set(spark, table, {f"view.{name}": {"predicate": predicate and predicate.spec, "items": [_item(i) for i in items]}})
    return "replaced" if known else "created"


def views(spark: SparkSession, table: str) -> list[str]:
    return sorted(k.removeprefix("view.") for k in _properties(spark, table) if k.startswith("view."))


def drop_view(spark: SparkSession, table: str, name: str) -> None:
    _unset(spark, table, f"view.{name}")


def through_view(spark: SparkSession, table: str, name: str, layout: str | None = None) -> FeatureFrame:
    """The collection seen through a saved view; further filters are added, further projections come after the view's."""
    v = _properties(spark, table).get(f"view.{name}")
    if v is None:
        raise KeyError(name)
    frame = collection(spark, table, layout)
    seen = frame.filter(from_spec(v["predicate"])) if v["predicate"] else frame
    return seen._with(seen.df, view_items=tuple(map(_from_item, v["items"])))


class Views:
    """Views of frames that are no tables: kept in this process and, as rows, in a temporary view."""

    def __init__(self):
        self._views: dict[tuple[str, str], tuple[Predicate | None, tuple]] = {}

    def put(self, collection: str, name: str, predicate: Predicate, items: tuple = (), frame: FeatureFrame | None = None) -> str:
        """'created' or 'replaced'. With a frame the view's rows can also be read from SQL by its name."""
        for item in items:
            steps(item if isinstance(item, str) else item.path)
        known = (collection, name) in self._views
        self._views[collection, name] = (predicate, tuple(items))
        if frame is not None:
            self.apply(frame, collection, name).df.createOrReplaceTempView(name)
        return "replaced" if known else "created"

    def apply(self, frame: FeatureFrame, collection: str, name: str) -> FeatureFrame:
        """The frame seen through the view; further filters are added, further projections come after the view's."""
        predicate, items = self._views[collection, name]
        seen = frame.filter(predicate) if predicate is not None else frame
        return seen._with(seen.df, view_items=items)


# Layouts.


def optimize_layout(frame: FeatureFrame, paths: list[tuple[str, str]], path: str, files: int | None = None, by_space: bool = False, rows: int | None = None) -> FeatureFrame:
    """Writes the frame with typed columns of the given (property path, kind), sorted by them, and reads it back.

    kind is number, string or boolean. Comparisons of these paths then use the columns, so they are pushed down
    and Parquet's statistics and Bloom filters skip row groups. Beside each column a boolean one marks the documents whose value it can't
    stand for (arrays, nulls, numbers beyond the decimal type or with more digits); these are compared as without a layout, so no answer
    changes. by_space sorts along a space-filling curve over the envelopes instead, so that near features share row groups and
    windows skip the others. Without a number of files Spark deals them out by their size; rows bounds those of a file.
    """
    types = {"number": "decimal(38,18)", "string": "string", "boolean": "boolean"}
    # The path's letters may meet with another path's, so columns have a number.
    names = {p: f"p_{'_'.join(steps(p)).replace('-', '_')}" + (f"_{k}" if k else "") for k, (p, _) in enumerate(paths)}

    def with_columns(df: DataFrame, p: str, kind: str) -> DataFrame:
        # Each step is a column of its own, so it is made once a row.
        df, value, typed, text = df.withColumn("__value", frame.binding.value(p)), F.col("__value"), F.col("__typed"), F.col("__text")
        df = df.withColumn("__schema", F.schema_of_variant(value))
        schema = F.col("__schema")
        df = df.withColumns({"__typed": F.when(is_kind_of(schema, kind), F.try_variant_get(value, "$", types[kind])), "__text": F.when(is_kind_of(schema, kind), F.try_variant_get(value, "$", "string"))})
        odd = is_kind_of(schema, "array") | is_kind_of(schema, "null") | (is_kind_of(schema, kind) & typed.isNull())
        if kind == "number":  # rounded; most texts show that they aren't
            df = df.withColumn("__rounded", F.coalesce(typed.isNotNull() & F.when(text.rlike(EXACT), F.lit(False)).otherwise(number_key(text) != number_key(typed.cast("string"))), F.lit(False)))
            df = df.withColumns({names[p]: F.when(~F.col("__rounded"), typed), odd_column(names[p]): odd | F.col("__rounded")})
        else:
            df = df.withColumns({names[p]: typed, odd_column(names[p]): odd})
        return df.drop("__value", "__schema", "__typed", "__text", "__rounded")

    df = frame.df
    for p, k in paths:
        df = with_columns(df, p, k)
    keys = [names[p] for p, _ in paths]
    order = keys
    if by_space:
        extent = tuple(v or 0.0 for v in frame.extent().first())  # nulls without geometries
        df = df.withColumn("__curve", curve((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, extent))
        order = ["__curve", *keys]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    out = dealt.sortWithinPartitions(*order).drop("__curve").write
    for k in keys:
        out = out.option(f"parquet.bloom.filter.enabled#{k}", "true")
    if rows:
        out = out.option("maxRecordsPerFile", rows)
    out.parquet(path)
    stored = frame.df.sparkSession.read.parquet(path)
    return frame._with(stored, ready=tuple((p, names[p], k) for p, k in paths))


def _state(spark: SparkSession, table: str) -> str:
    """Where the table's rows are and how many files there are: what a layout was made from."""
    files = sorted(spark.table(table).inputFiles())
    return f"{len(files)}:{files[0] if files else ''}:{files[-1] if files else ''}"


def put_layout(spark: SparkSession, table: str, name: str, paths: list[tuple[str, str]], path: str, files: int | None = None, by_space: bool = False) -> FeatureFrame:
    """Lays the collection out under a name. collection(spark, table, name) then reads the layout, and what was written since beside it."""
    p = _properties(spark, table)
    frame, states = collection(spark, table), _versions(spark, table, p)
    parts = None
    if states:
        now = states.state()
        parts = [*now["base"], *now["deltas"]]
        frame = frame._with(spark.sql(states.sql(now)))
    laid = optimize_layout(frame, paths, path, files, by_space)
    _set(spark, table, {f"layout.{name}": {"path": path, "ready": [list(r) for r in laid.ready], "parts": parts, "state": None if states else _state(spark, table)}})
    return laid


def layouts(spark: SparkSession, table: str) -> dict[str, list[tuple[str, str]]]:
    """The (path, kind) pairs of each layout."""
    return {k.removeprefix("layout."): [(p, kind) for p, _, kind in v["ready"]] for k, v in _properties(spark, table).items() if k.startswith("layout.")}


def drop_layout(spark: SparkSession, table: str, name: str) -> None:
    """Forgets a layout and deletes its files."""
    known = _properties(spark, table).get(f"layout.{name}")
    if known is None:
        raise KeyError(name)
    _unset(spark, table, f"layout.{name}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(known["path"])
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def extent_check(frame: FeatureFrame, declared: tuple[float, float, float, float]) -> DataFrame:
    """The computed extent, and whether it lies in the declared one."""
    e = frame.extent()
    inside = (F.col("xmin") >= declared[0]) & (F.col("ymin") >= declared[1]) & (F.col("xmax") <= declared[2]) & (F.col("ymax") <= declared[3])
    return e.withColumn("inside", inside)
