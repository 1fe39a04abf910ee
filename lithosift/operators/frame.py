"""FeatureFrame: a collection of features and the query operators on it.

A feature is a row with id (string), geometry (struct), xmin, ymin, xmax, ymax and doc (VARIANT). A frame wraps such a DataFrame, or
any DataFrame with a key and a geometry column ('plain' mode), and stays lazy.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Geometry, GeometryError, box, envelope
from ..functions.paths import Binding, value_at
from ..functions.predicates import Predicate
from ..functions.spatial import intersects_constant, overlaps_window
from .paging import DEEP, after_offset, sorting
from .projection import ALWAYS, project

BOX = ("xmin", "ymin", "xmax", "ymax")


def with_envelope(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    return df.withColumns(envelope(F.col(geometry)))


@dataclass(frozen=True)
class FeatureFrame:
    df: DataFrame
    mode: str = "typed"
    id: str = "id"
    geometry: str = "geometry"
    doc: str = "doc"
    srid: int | None = None
    ready: tuple = ()
    bbox: tuple[float, float, float, float] | None = None
    view_items: tuple = ()
    order: tuple[tuple[Column, bool], ...] = field(default=(), compare=False)  # (what, whether descending)
    sliced: tuple[int | None, int | None] = (None, None)

    @property
    def binding(self) -> Binding:
        return Binding(self.mode, self.doc, self.ready)

    def _with(self, df: DataFrame, **more) -> FeatureFrame:
        return replace(self, df=df, **more)

    # Filters. They are successive, so Catalyst joins them and pushes down what the scan can take.

    def filter(self, predicate: Predicate | Column) -> FeatureFrame:
        c = predicate.column(self.binding, self.bbox) if isinstance(predicate, Predicate) else predicate
        return self._with(self.df.filter(c))

    def window(self, bbox: tuple[float, float, float, float] | None) -> FeatureFrame:
        """Envelope overlap; None is no filter, anything that isn't a box raises."""
        if bbox is None:
            return self
        if len(bbox) != 4:
            raise GeometryError(f"not a bounding box: {bbox}")
        w = tuple(float(v) for v in bbox)
        box(*w)
        return self._with(self.df.filter(overlaps_window(*w)), bbox=w)

    def intersecting(self, geometry: Geometry) -> FeatureFrame:
        """Exact intersection with a constant of the same reference system; the window of its envelope reaches the scan."""
        if geometry.srid is not None and self.srid is not None and geometry.srid != self.srid:
            raise GeometryError(f"reference systems differ: {geometry.srid} and {self.srid}")
        window = geometry.envelope()
        df = self.df.filter(overlaps_window(*window)) if window else self.df
        return self._with(df.filter(intersects_constant(geometry, self.geometry)))

    def explode(self) -> FeatureFrame:
        """A row per part of each geometry, with the feature's id and document and the part's envelope.

        The window, if there is one, was tested on the whole feature and is tested again on the part.
        """
        part = F.struct(F.when(F.col("__part.kind") == "P", "Point").when(F.col("__part.kind") == "L", "LineString").otherwise("Polygon").alias("type"), F.col(f"{self.geometry}.srid").alias("srid"), F.array("__part").alias("parts"))
        df = self.df.withColumn("__part", F.explode(F.col(self.geometry)["parts"])).withColumn(self.geometry, part).drop("__part", *BOX)
        df = with_envelope(df, self.geometry)
        return self._with(df.filter(overlaps_window(*self.bbox)) if self.bbox else df)

    # Order and pages.

    def sort_by(self, *paths: str, directions: Iterable[str] = ()) -> FeatureFrame:
        """Documents sort as text, plain columns by their type; ties by id. Missing directions are ASC, unknown ones too."""
        b = self.binding
        order = []
        for path, way in zip_longest(paths, list(directions)[: len(paths)]):
            c = b.plain(path) if self.mode == "plain" else b.text(path)
            order.append((c, (way or "").upper() == "DESC"))
        return self._with(self.df, order=tuple(order))

    def page(self, start: int | None = None, limit: int | None = None) -> FeatureFrame:
        """Offset, then limit. From DEEP on rows() finds the offset's key first, see key_at()."""
        return self._with(self.df, sliced=(start, limit))

    def rows(self) -> DataFrame:
        """The frame's rows, sorted only if an order or a page was asked for."""
        df, (start, limit) = self.df, self.sliced
        keys = [*self.order, (F.col(self.id), False)]
        if start is not None and start >= DEEP:
            df, start = after_offset(df, keys, start), None
        if self.order or self.sliced != (None, None):
            df = df.orderBy(*sorting(keys))
        df = df.offset(start) if start else df
        return df.limit(limit) if limit is not None else df

    # Results.

    def count(self) -> DataFrame:
        """One row: total, whatever the order and page."""
        return self.df.agg(F.count("*").alias("total"))

    def distinct(self, path: str) -> DataFrame:
        """The distinct values of a property as text, without nulls, sorted; order and page don't count."""
        return self.df.select(self.binding.text(path).alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value")

    def select(self, *items, always: Iterable = ALWAYS) -> DataFrame:
        """id, geometry and the projected document as a struct named feature; a view's items come first."""
        return self.rows().select(F.col(self.id), F.col(self.geometry), project([*self.view_items, *items], self.doc, always).alias("feature"))

    def extent(self) -> DataFrame:
        """One row: the envelope of all features, all null if there is none."""
        return self.df.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))

    def get(self, path: str, type: str = "string") -> Column:
        """A property's value as a column."""
        return self.binding.plain(path).try_cast(type) if self.mode == "plain" else value_at(F.col(self.doc), path, type)
