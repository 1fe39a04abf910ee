"""Projections of documents: nested paths, arrays of objects, merged lists of both, and flattening."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NullType, StructType, VariantType, _parse_datatype_string

from ..functions.paths import Key, json_path, steps


@dataclass(frozen=True)
class Path:
    """A path to keep, its value as a Spark type (a variant by default)."""

    path: str
    type: str = "variant"


@dataclass(frozen=True)
class Each:
    """An array at path, with these members of each of its elements."""

    path: str
    members: tuple

    def __init__(self, path: str, *members):
        object.__setattr__(self, "path", path)
        object.__setattr__(self, "members", members)


#: What every projection keeps.
ALWAYS = (Path("id", "string"), Path("type", "string"))


def _tree(items: Iterable) -> dict:
    """Paths merged: nested dicts with a Path, or the tree of an array's elements, at the leaves.

    Naming a path twice is harmless; of two projections of one array the later holds; a longer path into a kept value
    replaces the value by an object of what is named.
    """
    out: dict = {}
    for item in items:
        item = Path(item) if isinstance(item, str) else item
        *way, last = steps(item.path)
        at = out
        for s in way:
            if not isinstance(at.get(s), dict):
                at[s] = {}
            at = at[s]
        if isinstance(item, Each):
            at[last] = [_tree(item.members)]
        elif not isinstance(at.get(last), dict):
            at[last] = item
    return out


def _build(value: Column, tree: dict, way: tuple[str, ...]) -> Column:
    fields = []
    for name, sub in tree.items():
        here = (*way, name)
        path = json_path(".".join(here))
        if isinstance(sub, dict):
            c = _build(value, sub, here)
        elif isinstance(sub, list):
            elements = F.try_variant_get(value, path, "array<variant>")
            made = F.transform(elements, _element(sub[0]))
            c = F.coalesce(made, F.filter(F.transform(F.array(F.parse_json(F.lit("{}"))), _element(sub[0])), lambda _: F.lit(False)))
        else:
            c = F.try_variant_get(value, path, sub.type)
        fields.append(c.alias(name))
    return F.struct(*fields)


def _element(tree: dict):
    return lambda e: _build(e, tree, ())


def project(items: Iterable, doc: str = "doc", always: Iterable = ALWAYS) -> Column:
    """A struct of the document's named parts. Missing paths are null, missing arrays empty."""
    return _build(F.col(doc), _tree([*always, *items]), ())


def flatten(df: DataFrame, doc: str = "doc", under: str | None = None) -> list[tuple[Key, str]]:
    """(key, Spark type) of every scalar leaf that any document has, sorted; arrays are left out. Names may be any text.

    One aggregate over the documents finds the schema; values are then read with one variant_get a leaf.
    """
    value = F.try_variant_get(F.col(doc), json_path(under), "variant") if under else F.col(doc)
    text = df.agg(F.schema_of_variant_agg(value)).first()[0]
    if not text or not text.startswith("OBJECT<"):
        return []
    # The same as a struct's type, which Spark can read; names stand in backticks where they need them.
    struct = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], text)
    return sorted(_leaves(_parse_datatype_string(struct), tuple(steps(under)) if under else ()))


def _leaves(kind: DataType, names: tuple[str, ...]) -> list[tuple[Key, str]]:
    if isinstance(kind, StructType):
        return [leaf for f in kind.fields for leaf in _leaves(f.dataType, (*names, f.name))]
    if isinstance(kind, ArrayType):
        return []
    return [(Key(names), "string" if isinstance(kind, (NullType, VariantType)) else kind.simpleString())]
