"""Numbers of any precision: keys of text that sort as the numbers do.

A key is the sign, the exponent and the digits of 0.d1d2... * 10 ** exponent without zeros at either end, so keys of equal numbers are equal
whatever way these are written, and keys compare by bytes. Of negative numbers exponent and digits are turned round (9 for 0)
and end with a sign above all digits. Exponents have nine digits at most; what is no number has no key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

#: Texts of numbers that the type decimal(38,18) has as they are.
EXACT = r"^-?\d{1,20}(\.\d{1,18})?$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,9})?\s*$"
_PARTS = r"^\s*([+-]?)0*(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?\s*$"
#: Added to exponents, so that none is negative; with texts of at most 2^31 digits they stay below its double.
_BIAS, _WIDTH = 5 * 10**9, 11
_UP, _DOWN = "0123456789", "9876543210"


def number_key(text: Column) -> Column:
    """The key of a number's text; null if it is none."""
    return let(text, lambda t: F.when(t.rlike(_NUMBER), let(F.struct(*[F.regexp_extract(t, _PARTS, k).alias(f"p{k}") for k in range(1, 5)]), _key)))


def _key(parts: Column) -> Column:
    digits = F.concat(parts["p2"], parts["p3"])
    some = F.ltrim(digits, F.lit("0"))
    exponent = F.length(parts["p2"]) - (F.length(digits) - F.length(some)) + F.coalesce(parts["p4"].try_cast("bigint"), F.lit(0).cast("bigint"))
    size = F.concat(F.lpad((exponent + _BIAS).cast("string"), _WIDTH, "0"), F.rtrim(some, F.lit("0")))
    return F.when(some == "", "1").when(parts["p1"] == "-", F.concat(F.lit("0"), F.translate(size, _UP, _DOWN), F.lit("~"))).otherwise(F.concat(F.lit("2"), size))


def key_of(number: Decimal) -> str:
    """The key of a finite number."""
    sign, digits, exponent = number.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    if not text:
        return "1"
    size = f"{len(text) + exponent + _BIAS:0{_WIDTH}d}{text.rstrip('0')}"
    return "0" + size.translate(str.maketrans(_UP, _DOWN)) + "~" if sign else "2" + size
