"""Predicates over features, built from Python: prop('a.b').eq(12) & ~prop('c').is_null().

A predicate is bound to a frame's mode when the frame filters by it. In typed mode comparisons, dates, regular expressions and
null tests are two-valued: a missing property makes them false, so their negation keeps the row. The text-based ones (isin, between,
like, ilike, contains) are null for a missing property in both modes, so neither they nor their negation keep it.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, ROUND_HALF_UP, Context, Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Geometry, box
from .numbers import key_of, number_key
from .paths import Binding, is_kind, steps
from .spatial import intersects_constant, overlaps_window


class Predicate:
    """Something that becomes a boolean Column once it is bound. spec says the same in JSON; from_spec() reads it back."""

    def __init__(self, build: Callable[[Binding, Any], Column], spec: list | None = None):
        self._build, self.spec = build, spec

    def column(self, binding: Binding, bbox=None) -> Column:
        return self._build(binding, bbox)

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(lambda b, w: self.column(b, w) & other.column(b, w), ["and", self.spec, other.spec])

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(lambda b, w: self.column(b, w) | other.column(b, w), ["or", self.spec, other.spec])

    def __invert__(self) -> Predicate:
        return Predicate(lambda b, w: ~self.column(b, w), ["not", self.spec])


def always(value: bool) -> Predicate:
    """A boolean literal."""
    return Predicate(lambda b, w: F.lit(value), ["always", value])


def intersects(geometry: Geometry) -> Predicate:
    """The feature's geometry meets the constant, boundary included."""
    return Predicate(lambda b, w: intersects_constant(geometry), ["intersects", geometry.type, geometry.parts, geometry.srid])


def intersects_bbox() -> Predicate:
    """The feature's geometry meets the frame's bounding box; false without one."""
    return Predicate(lambda b, w: intersects_constant(box(*w)) if w else F.lit(False), ["intersects_bbox"])


def overlaps_bbox(xmin: float, ymin: float, xmax: float, ymax: float) -> Predicate:
    return Predicate(lambda b, w: overlaps_window(xmin, ymin, xmax, ymax), ["overlaps_bbox", xmin, ymin, xmax, ymax])


@dataclass(frozen=True)
class Prop:
    """A property of the feature, by dotted path."""

    path: str
    date_format: str | None = None

    def to_date(self, fmt: str) -> Prop:
        """The property's text read as a date, to be compared with dates."""
        return Prop(self.path, spark_date_format(fmt))

    def _spec(self, name: str, *values) -> list:
        return ["prop", name, self.path, self.date_format, *map(_plain, values)]

    def eq(self, other) -> Predicate:
        return _compare(self, operator.eq, other, self._spec("eq", other))

    def ne(self, other) -> Predicate:
        return _compare(self, operator.ne, other, self._spec("ne", other))

    def lt(self, other) -> Predicate:
        return _compare(self, operator.lt, other, self._spec("lt", other))

    def le(self, other) -> Predicate:
        return _compare(self, operator.le, other, self._spec("le", other))

    def gt(self, other) -> Predicate:
        return _compare(self, operator.gt, other, self._spec("gt", other))

    def ge(self, other) -> Predicate:
        return _compare(self, operator.ge, other, self._spec("ge", other))

    def isin(self, *values) -> Predicate:
        if len({_kind(v) for v in values}) != 1:
            raise TypeError("a list needs values of one type")

        def build(b: Binding, _) -> Column:
            kind = _kind(values[0])
            if kind == "number" and b.mode != "plain":
                return reduce(operator.or_, [_number(operator.eq, _as(b, self, kind), b.text(self.path), v) for v in values])
            return _as(b, self, kind).isin(*[_literal(v) for v in values])

        return Predicate(build, self._spec("isin", *values))

    def between(self, low, high) -> Predicate:
        """low to high, both included."""

        def build(b: Binding, _) -> Column:
            value = _as(b, self, _kind(low))
            if _kind(low) == "number" and b.mode != "plain":
                return _number(operator.ge, value, b.text(self.path), low) & _number(operator.le, value, b.text(self.path), high)
            return value.between(_literal(low), _literal(high))

        return Predicate(build, self._spec("between", low, high))

    def like(self, pattern: str) -> Predicate:
        return Predicate(lambda b, w: b.text(self.path).like(pattern), self._spec("like", pattern))

    def ilike(self, pattern: str) -> Predicate:
        return Predicate(lambda b, w: b.text(self.path).ilike(pattern), self._spec("ilike", pattern))

    def matches(self, pattern: str) -> Predicate:
        """A regular expression that is found anywhere in the text."""

        def build(b: Binding, _) -> Column:
            if b.mode != "typed":
                return b.text(self.path).rlike(pattern)
            return F.coalesce(F.exists(b.items(self.path), lambda e: is_kind(e, "string") & F.try_variant_get(e, "$", "string").rlike(pattern)), F.lit(False))

        return Predicate(build, self._spec("matches", pattern))

    def is_null(self) -> Predicate:
        """Typed mode: the value is JSON null. Text mode: that, or it is missing."""

        def build(b: Binding, _) -> Column:
            if b.mode == "plain":
                return b.plain(self.path).isNull()
            return F.coalesce(F.is_variant_null(b.value(self.path)), F.lit(False)) if b.mode == "typed" else b.text(self.path).isNull()

        return Predicate(build, self._spec("is_null"))

    def is_not_null(self) -> Predicate:
        def build(b: Binding, _) -> Column:
            if b.mode == "plain":
                return b.plain(self.path).isNotNull()
            return b.value(self.path).isNotNull() & ~F.is_variant_null(b.value(self.path)) if b.mode == "typed" else b.text(self.path).isNotNull()

        return Predicate(build, self._spec("is_not_null"))

    def contains(self, value) -> Predicate:
        """The JSON value contains this one: objects by key, arrays by element, scalars if equal; null if missing."""
        value = json.loads(value) if isinstance(value, str) and value[:1] in '{["' else value

        def build(b: Binding, _) -> Column:
            left = F.parse_json(b.plain(self.path)) if b.mode == "plain" else b.value(self.path)
            test = _contains(left, value)
            if not isinstance(value, (dict, list)):  # an array contains its scalars
                test = test | F.coalesce(F.exists(F.try_variant_get(left, "$", "array<variant>"), lambda e: _contains(e, value)), F.lit(False))
            return F.when(left.isNotNull(), test)

        return Predicate(build, ["prop", "contains", self.path, self.date_format, value])


def _plain(value) -> Any:
    """A comparison's other side in JSON: numbers, booleans and texts as they are."""
    if isinstance(value, Prop):
        return {"prop": value.path, "date_format": value.date_format}
    if isinstance(value, DateLiteral):
        return {"date": value.text, "fmt": value.fmt}
    return {"decimal": str(value)} if isinstance(value, Decimal) else value


def _value(plain) -> Any:
    if not isinstance(plain, dict):
        return plain
    if "prop" in plain:
        return Prop(plain["prop"], plain["date_format"])
    return DateLiteral(plain["date"], plain["fmt"]) if "date" in plain else Decimal(plain["decimal"])


def from_spec(spec: list) -> Predicate:
    """The predicate that has this spec."""
    name, *rest = spec
    if name in ("and", "or"):
        a, b = map(from_spec, rest)
        return a & b if name == "and" else a | b
    if name == "not":
        return ~from_spec(rest[0])
    if name == "prop":
        method, path, fmt, *values = rest
        return getattr(Prop(path, fmt), method)(*(values if method == "contains" else map(_value, values)))
    if name == "intersects":
        kind, parts, srid = rest
        return intersects(Geometry(kind, tuple((k, tuple(tuple(map(tuple, r)) for r in rings)) for k, rings in parts), srid))
    return {"always": always, "intersects_bbox": intersects_bbox, "overlaps_bbox": overlaps_bbox}[name](*rest)


def prop(path: str) -> Prop:
    steps(path)
    return Prop(path)


#: The date pattern letters that are known, and Spark's.
_DATES = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "Mon": "MMM", "DD": "dd", "HH24": "HH", "MI": "mm", "SS": "ss"}


def spark_date_format(fmt: str) -> str:
    out, at = "", 0
    while at < len(fmt):
        name = next((n for n in _DATES if fmt.startswith(n, at)), None)
        if name is None and fmt[at].isalpha():
            raise ValueError(f"unknown date pattern at {fmt[at:]!r}")
        out += _DATES[name] if name else fmt[at]
        at += len(name) if name else 1
    return out


@dataclass(frozen=True)
class DateLiteral:
    text: str
    fmt: str


def to_date(text: str, fmt: str) -> DateLiteral:
    """A date constant."""
    return DateLiteral(text, spark_date_format(fmt))


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, Decimal)):
        return "number"
    if isinstance(value, DateLiteral) or (isinstance(value, Prop) and value.date_format):
        return "date"
    if isinstance(value, str):
        return "string"
    raise TypeError(f"no property has a value like {value!r}")


#: The decimal type of fast comparisons: places after the point, and what is too large.
_PLACES, _LARGE = Decimal(1).scaleb(-18), Decimal(10) ** 20
_EXACT = Context(prec=100)


def _decimal(value) -> Decimal | None:
    """The number as it is written; None if it isn't finite."""
    d = Decimal(str(value))
    return d if d.is_finite() else None


def _round(d: Decimal, how: str) -> Decimal:
    return d.quantize(_PLACES, how, _EXACT)


def _fits(value) -> bool:
    d = _decimal(value)
    return d is not None and d.copy_abs() < _LARGE and d == _round(d, ROUND_FLOOR)  # abs() rounds to 28 digits


def _number(op: Callable, value: Column, text: Column, other) -> Column:
    """op between a number, given in the decimal type (rounded, or null where it is too large) and as text, and a constant, whatever their digits.

    Rounding keeps the order, so the keys of all digits are made only where both round to the same.
    """
    d = _decimal(other)
    if d is None:
        return op(text.try_cast("double"), F.lit(float(other)))
    exact = op(number_key(text), F.lit(key_of(d)))
    if d.copy_abs() >= _LARGE - 1:
        return exact
    rounded = F.lit(str(_round(d, ROUND_HALF_UP))).cast("decimal(38,18)")
    return F.when(value.isNull() | (value == rounded), exact).otherwise(op(value, rounded))


def _stored(op: Callable, column: Column, other) -> Column:
    """op between a column of the decimal type and a constant, as a comparison that Parquet's statistics know."""
    d = _decimal(other)
    if d is None or _fits(other):
        return op(column, _literal(other))
    if op in (operator.eq, operator.ne):
        return F.lit(op is operator.ne)
    less = op in (operator.lt, operator.le)
    near = _round(d, ROUND_FLOOR if less else ROUND_CEILING) if d.copy_abs() < _LARGE else d
    if near.copy_abs() >= _LARGE:
        return F.lit(less == (d > 0))
    near = F.lit(str(near)).cast("decimal(38,18)")
    return column <= near if less else column >= near


def _literal(value) -> Column:
    if isinstance(value, DateLiteral):
        return F.try_to_date(F.lit(value.text), value.fmt)
    if _kind(value) == "number":
        return F.lit(str(value)).cast("decimal(38,18)") if _fits(value) else F.lit(float(value))
    return F.lit(value)


def _as(b: Binding, p: Prop, kind: str) -> Column:
    """The property's text cast to a kind; what can't be cast is null."""
    if p.date_format or kind == "date":
        return F.try_to_date(b.text(p.path), p.date_format or "yyyy-MM-dd")
    if b.mode == "plain":
        return b.plain(p.path)
    text = b.text(p.path)
    return {"number": lambda: text.try_cast("decimal(38,18)"), "boolean": lambda: text.try_cast("boolean"), "string": lambda: text}[kind]()


def _element(e: Column, kind: str) -> Column:
    return F.try_variant_get(e, "$", {"number": "decimal(38,18)", "string": "string", "boolean": "boolean"}[kind])


def _compare(p: Prop, op: Callable, other, spec: list) -> Predicate:
    if isinstance(other, Prop) and not other.date_format and not p.date_format:
        return Predicate(lambda b, w: _two_properties(b, p, op, other), spec)
    kind = "date" if p.date_format else _kind(other)

    def build(b: Binding, _) -> Column:
        right = _as(b, other, "date") if isinstance(other, Prop) else _literal(other)
        if b.mode == "plain":
            return op(_as(b, p, kind), right)
        if kind == "date":
            test = op(_as(b, p, kind), right)
            return F.coalesce(test, F.lit(False)) if b.mode == "typed" else test
        if b.mode == "text":
            return _number(op, _as(b, p, kind), b.text(p.path), other) if kind == "number" else op(_as(b, p, kind), right)

        def one(e: Column) -> Column:
            test = _number(op, _element(e, kind), F.try_variant_get(e, "$", "string"), other) if kind == "number" else op(_element(e, kind), right)
            test = is_kind(e, kind) & test
            return test | is_kind(e, "null") if op is operator.ne else test  # null differs from everything

        general = F.coalesce(F.exists(b.items(p.path), one), F.lit(False))
        ready = next((c for path, c, t in b.ready if path == p.path and t == kind), None)
        if ready is None:
            return general
        # The column has all values of its kind but those that the odd column marks. The first part reaches the scan; where it is
        # null, the second is false, so both together are two-valued.
        odd, test = F.col(odd_column(ready)), _stored(op, F.col(ready), other) if kind == "number" else op(F.col(ready), right)
        return (test | odd) & (F.col(ready).isNotNull() & test | general)

    return Predicate(build, spec)


def odd_column(ready: str) -> str:
    """The name of the boolean column beside a laid-out one: whether the document has a value that the column can't stand for."""
    return f"{ready}__odd"


def _two_properties(b: Binding, p: Prop, op: Callable, other: Prop) -> Column:
    if b.mode == "plain":
        return op(b.plain(p.path), b.plain(other.path))
    if b.mode == "text":
        return op(b.text(p.path), b.text(other.path))
    left, right = b.value(p.path), b.value(other.path)
    tests = [is_kind(left, k) & is_kind(right, k) & op(_element(left, k), _element(right, k)) for k in ("string", "boolean")]
    x, y = _element(left, "number"), _element(right, "number")
    keys = [number_key(F.try_variant_get(v, "$", "string")) for v in (left, right)]
    numbers = F.when(x.isNull() | y.isNull() | (x == y), op(*keys)).otherwise(op(x, y))
    tests.append(is_kind(left, "number") & is_kind(right, "number") & numbers)
    return F.coalesce(tests[0] | tests[1] | tests[2], F.lit(False))


def _contains(left: Column, value) -> Column:
    """Whether the variant contains the constant; never null.

    Only objects have members and only arrays elements, so the kind itself is asked for where the constant has none.
    """
    if isinstance(value, dict):
        test = F.lit(True) if value else is_kind(left, "object")
        for k, v in value.items():
            path = "$[" + json.dumps(k) + "]"
            inner = F.try_variant_get(left, path, "variant")
            test = test & inner.isNotNull() & _contains(inner, v)
    elif isinstance(value, list):
        test = F.lit(True) if value else is_kind(left, "array")
        for v in value:
            test = test & F.coalesce(F.exists(F.try_variant_get(left, "$", "array<variant>"), _containing(v)), F.lit(False))
    elif value is None:
        test = F.is_variant_null(left)
    else:
        kind = _kind(value)
        same = _number(operator.eq, _element(left, kind), F.try_variant_get(left, "$", "string"), value) if kind == "number" else _element(left, kind) == _literal(value)
        test = is_kind(left, kind) & same
    return F.coalesce(test, F.lit(False))


def _containing(value) -> Callable[[Column], Column]:
    return lambda e: _contains(e, value)
