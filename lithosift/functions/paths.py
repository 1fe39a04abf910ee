"""Property paths: one extraction for documents in a VARIANT column and one for plain columns.

Modes: 'typed' compares JSON values of the literal's type, looking into arrays; 'text' reads everything as text and casts;
'plain' takes the DataFrame's own columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("typed", "text", "plain")
_STEP = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")


class Key(str):
    """A dotted path whose names may be any text; names has them one by one."""

    def __new__(cls, names):
        key = super().__new__(cls, ".".join(names))
        key.names = tuple(names)
        return key


def steps(path: str) -> list[str]:
    """The names of a dotted path; names have letters, digits, - and _, but those of a Key."""
    if isinstance(path, Key):
        return list(path.names)
    out = path.split(".")
    if not all(_STEP.match(s) for s in out):
        raise ValueError(f"not a property path: {path!r}")
    return out


def json_path(path: str) -> str:
    return "$" + "".join(f"['{s}']" if '"' in s else f'["{s}"]' for s in steps(path))


def value_at(doc: Column, path: str, type: str = "variant") -> Column:
    """The value at a path; null if it is missing. A name with both kinds of quotes is looked up in its object's map."""
    names = steps(path)
    for k, name in enumerate(names):
        if '"' in name and "'" in name:
            above = value_at(doc, Key(names[:k])) if k else doc
            inner = F.try_element_at(F.try_variant_get(above, "$", "map<string,variant>"), F.lit(name))
            return value_at(inner, Key(names[k + 1 :]), type) if names[k + 1 :] else F.try_variant_get(inner, "$", type)
    return F.try_variant_get(doc, json_path(path), type)


@dataclass(frozen=True)
class Binding:
    """How paths are read: the mode, the document's column, and columns that hold a path's value already.

    ready maps a path to a column that optimize_layout() made; comparisons then reach the scan.
    """

    mode: str = "typed"
    doc: str = "doc"
    ready: tuple[tuple[str, str, str], ...] = ()  # (path, column, type)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"no such mode: {self.mode}")

    def plain(self, path: str) -> Column:
        names = steps(path)
        names = names[1:] if names[0] == "properties" and len(names) > 1 else names
        return F.col(".".join(f"`{n}`" for n in names))

    def value(self, path: str) -> Column:
        """The JSON value as a variant; null if the path is missing."""
        return F.try_variant_get(F.col(self.doc), json_path(path), "variant")

    def text(self, path: str) -> Column:
        """The value as text; null if missing or JSON null."""
        if self.mode == "plain":
            return self.plain(path).cast("string")
        return F.try_variant_get(F.col(self.doc), json_path(path), "string")

    def items(self, path: str) -> Column:
        """The elements of an array, or the value itself as the only one; null if missing."""
        doc = F.col(self.doc)
        return F.coalesce(F.try_variant_get(doc, json_path(path), "array<variant>"), F.array(F.try_variant_get(doc, json_path(path), "variant")))


#: The names of JSON kinds in schema_of_variant's words, and how those of the others begin.
_NAMED = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
_BEGIN = {"object": "^OBJECT<", "array": "^ARRAY<", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"}


def is_kind(value: Column, kind: str) -> Column:
    """Whether the variant is of that kind; false if it is missing. The schema is made once, also where Spark doesn't share expressions."""
    return is_kind_of(F.schema_of_variant(value), kind)


def is_kind_of(schema: Column, kind: str) -> Column:
    """The same, from the variant's schema."""
    return F.coalesce(schema == _NAMED[kind] if kind in _NAMED else schema.rlike(_BEGIN[kind]), F.lit(False))
