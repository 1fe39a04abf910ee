"""Deep pages: an offset becomes the key of its row, found by counting ranges of keys, so that no task gets the rows before it.

A round samples the keys, deals all rows to the ranges between them and counts these; the range that has the offset's row is dealt again until it has
few rows. Then only that range is sorted. The rows of the page and all after it are those whose keys aren't before the row's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a sort may skip.
DEEP = 100_000
#: Ranges of a round are at most FAN * FAN; keys sampled for each.
FAN, SAMPLED = 24, 4

#: A sort key: what, and whether it is descending. Nulls come last, or first if it is descending.
Key = tuple[Column, bool]


def sorting(keys: list[Key]) -> list[Column]:
    return [c.desc_nulls_first() if desc else c.asc_nulls_last() for c, desc in keys]


def _later(a: list[Column], b: list[Column], keys: list[Key]) -> Column:
    """Whether a comes after b; never null."""
    test = F.lit(False)
    for x, y, (_, desc) in reversed(list(zip(a, b, keys, strict=True))):
        null, more = (x.isNotNull() & y.isNull(), x < y) if desc else (x.isNull() & y.isNotNull(), x > y)
        test = F.coalesce(more, F.lit(False)) | null | (x.eqNullSafe(y) & test)
    return test


#: How the sampled keys are written as text and read again: with all digits of a second.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _of(names: list[str], body: Callable[[list[Column]], Column]) -> Column:
    """body of a row's keys, which are made once, however often it uses them."""
    return F.get(F.transform(F.array(F.struct(*names)), lambda row: body([row[n] for n in names])), 0)


def _range(names: list[str], bounds: list[str], keys: list[Key], type: str) -> Column:
    """How many of the sorted bounds (structs as JSON) the key comes after: first among each FAN-th of them, then within its stretch."""
    stretches = [f"[{','.join(bounds[k : k + FAN])}]" for k in range(0, len(bounds), FAN)]
    heads = f"[{','.join(bounds[::FAN])}]"
    constant = lambda text, depth: F.from_json(F.lit(text), "array<" * depth + type + ">" * depth, _JSON)

    def number(key: list[Column]) -> Column:
        passed = lambda some: F.size(F.filter(some, lambda b: _later(key, [b[n] for n in names], keys)))
        first = F.transform(F.array(F.greatest(passed(constant(heads, 1)) - 1, F.lit(0))), lambda k: k * FAN + passed(F.get(constant(f"[{','.join(stretches)}]", 2), k)))
        return F.get(first, 0)

    return _of(names, number)


def key_at(df: DataFrame, keys: list[Key], number: int, few: int = DEEP) -> tuple[tuple, int] | None:
    """The key of the row at that offset, and how many rows with an equal key come before it; None if there are no so many rows."""
    names = [f"__k{k}" for k in range(len(keys))]
    every = df.select(*[c.alias(n) for n, (c, _) in zip(names, keys, strict=True)])
    types = [f.dataType.simpleString() for f in every.schema.fields]
    own = [(F.col(n), desc) for n, (_, desc) in zip(names, keys, strict=True)]
    rest, before = every, number
    size = rest.count()
    if number >= size:
        return None
    while size > few:
        share = min(1.0, FAN * FAN * SAMPLED / size)
        sample = rest.sample(share, seed=1).orderBy(*sorting(own)).limit(2 * FAN * FAN * SAMPLED).select(F.to_json(F.struct(*names), _JSON)).collect()
        bounds = list(dict.fromkeys(r[0] for r in sample[SAMPLED - 1 :: SAMPLED]))
        if not bounds:
            break
        dealt = rest.withColumn("__range", _range(names, bounds, own, every.select(F.struct(*names)).schema[0].dataType.simpleString()))
        counts = dict(dealt.groupBy("__range").count().collect())  # a row for each bound at most
        at = 0
        while before >= counts.get(at, 0):
            before -= counts.get(at, 0)
            at += 1
        if counts[at] == size:
            break  # nearly all keys are equal
        rest, size = dealt.filter(F.col("__range") == at).drop("__range"), counts[at]
    row = tuple(rest.orderBy(*sorting(own)).offset(before).limit(1).first())
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.lit(v).cast(t)) for (c, _), v, t in zip(own, row, types, strict=True)])
    first = rest.filter(~same & ~_of(names, lambda key: _later(key, [F.lit(v).cast(t) for v, t in zip(row, types, strict=True)], own))).count()
    return row, before - first


def after_offset(df: DataFrame, keys: list[Key], start: int, few: int = DEEP) -> DataFrame:
    """The rows from that offset on, in no order; some jobs are run to find its key."""
    found = key_at(df, keys, start, few)
    if found is None:
        return df.limit(0)
    row, equal = found
    types = [f.dataType.simpleString() for f in df.select(*[c for c, _ in keys]).schema.fields]
    values = [F.lit(v).cast(t) for v, t in zip(row, types, strict=True)]
    names = [f"__k{k}" for k in range(len(keys))]
    every = df.withColumns({n: c for n, (c, _) in zip(names, keys, strict=True)})
    if not equal:
        return every.filter(_of(names, lambda key: ~_later(values, key, keys))).drop(*names)
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(v) for n, v in zip(names, values, strict=True)])
    return every.filter(same).offset(equal).unionByName(every.filter(_of(names, lambda key: _later(key, values, keys)))).drop(*names)
