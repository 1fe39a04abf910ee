"""Interleaved writers, merging without a shuffle of what is there, layouts along a curve and through writes, numbers of any precision."""

import json
import operator
import re
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithosift.functions.numbers import key_of, number_key
from lithosift.functions.predicates import prop
from lithosift.operators.frame import FeatureFrame
from lithosift.operators.writes import Collection, ConcurrentWrite, DuplicateIds
from lithosift.plans import catalog

from .test_features import features, state

V = prop("properties.v")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Writers.

CHANGES = {
    "insert": lambda c, spark: c.insert(features(spark, [("x", 1)])),
    "upsert": lambda c, spark: c.upsert(features(spark, [("a", 9), ("x", 1)])),
    "delete": lambda c, spark: c.delete(V.eq(2)),
    "update": lambda c, spark: c.update(V.eq(2), features(spark, [("z", 7)])),
    "compact": lambda c, spark: c.compact(),
}


@pytest.mark.parametrize("late", CHANGES)
@pytest.mark.parametrize("early", ["insert", "delete"])
def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch, late, early):
    """The late one has read the state before the early one commits."""
    c, path = Collection(spark, str(tmp_path / "c"), buckets=2), str(tmp_path / "c")
    c.insert(features(spark, [("a", 1), ("b", 2), ("c", 3)]))
    write, between = Collection._write, [lambda: CHANGES[early](Collection(spark, path), spark)]

    def interrupted(self, df, state):
        if between:
            between.pop()()
        return write(self, df, state)

    monkeypatch.setattr(Collection, "_write", interrupted)
    with pytest.raises(ConcurrentWrite):
        CHANGES[late](c, spark)
    want = {"insert": {"a": 1, "b": 2, "c": 3, "x": 1}, "upsert": {"a": 9, "b": 2, "c": 3, "x": 1}, "delete": {"a": 1, "c": 3}, "update": {"a": 1, "b": 7, "c": 3}}[early]
    assert state(c) == want
    monkeypatch.undo()
    if (early, late) not in {("insert", "insert"), ("upsert", "insert")}:
        CHANGES[late](c, spark)  # again, from the new state
    c.drop()


def test_an_update_takes_one_feature(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), buckets=2)
    c.insert(features(spark, [("a", 1), ("b", 2)]))
    before = c.version()
    for some in ([], [("y", 1), ("z", 2)]):
        with pytest.raises(ValueError, match="one feature"):
            c.update(V.ge(0), features(spark, [("q", 0), *some]).filter(F.col("id") != "q"))
    assert c.version() == before and state(c) == {"a": 1, "b": 2}


def test_states_of_any_length(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), buckets=2)
    c.insert(features(spark, [("a", 1)]))
    now = c.state()
    c.commit(c.version(), {**now, "applied": {f"source {k}": k for k in range(20000)}})
    assert c.upsert(features(spark, [("b", 2)])) == 1 and len(c.state()["applied"]) == 20000


def test_a_state_that_is_being_written_is_not_read(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), buckets=2)
    c.insert(features(spark, [("a", 1)]))
    (tmp_path / "c/_states/2.json").write_text('{"base": [')
    assert c.version() == 1 and state(c) == {"a": 1}
    with pytest.raises(ConcurrentWrite):
        c.insert(features(spark, [("b", 2)]))
    assert c.vacuum(spared=0) == 1 and c.insert(features(spark, [("b", 2)])) == 1 and state(c) == {"a": 1, "b": 2}


def test_vacuum_spares_writers(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), buckets=2)
    c.insert(features(spark, [("a", 1)]))
    version = c.version()
    name, new = c._write(features(spark, [("b", 2)]), c.state())
    assert c.vacuum() == 0
    c.commit(version, {**new, "base": [*new["base"], name]})
    assert state(c) == {"a": 1, "b": 2}


def test_small_parts_are_put_together(spark, tmp_path, monkeypatch):
    c = Collection(spark, str(tmp_path / "c"), buckets=2)
    c.insert(features(spark, [(f"n{k}", k) for k in range(200)]))
    big = c.state()["base"][0]
    written = []
    write = Collection._write
    monkeypatch.setattr(Collection, "_write", lambda self, df, state: (written.append(df.count()), write(self, df, state))[1])
    for k in range(10):
        c.insert(features(spark, [(f"i{k}", k)]))
        c.upsert(features(spark, [(f"n{k}", -k)]))
        now = c.state()
        assert len(now["base"]) <= 8 and len(now["deltas"]) <= 8 and big in now["base"]  # the large part isn't written again
    assert sum(written) < 100 and max(written) < 20
    assert state(c) == {f"n{k}": -k if k < 10 else k for k in range(200)} | {f"i{k}": k for k in range(10)}
    with pytest.raises(DuplicateIds):
        c.insert(features(spark, [("i3", 0)]))


def test_what_is_there_is_not_shuffled(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), buckets=8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c.insert(features(spark, [(f"n{k}", k) for k in range(50)]))
        c.insert(features(spark, [(f"m{k}", k) for k in range(50)]))
        c.upsert(features(spark, [("n1", -1)]))
        c.upsert(features(spark, [("n2", -1)]))
        text = plan(c.read())
        # On the way from a base part to the root no line is an exchange: below an exchange stand deltas only.
        parts = [n for n in c.state()["base"]]
        lines = text.splitlines()
        depth = lambda line: len(re.match(r"[ :+\-]*", line)[0])
        checked = 0
        for at, line in enumerate(lines):
            if any(f"features_{n}" in line for n in parts):
                level = depth(line)
                for above in reversed(lines[:at]):
                    if depth(above) < level:
                        level = depth(above)
                        assert "Exchange" not in above, text
                checked += 1
        assert checked == 2 and "SortMergeJoin" in text and "Bucketed: true" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_new_session_finds_the_parts(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), buckets=3)
    c.insert(features(spark, [("a", 1), ("b", 2)]))
    c.upsert(features(spark, [("b", 3)]))
    c.unlist()
    again = Collection(spark, str(tmp_path / "c"))
    assert state(again) == {"a": 1, "b": 3} and again.state()["buckets"] == 3
    assert "Bucketed: true" in plan(again._part(again.state()["base"][0]).groupBy("id").count())


def test_tables_are_not_written_again(spark, tmp_path):
    catalog.create_collection(spark, "grown", (0, 0, 9, 9), path=str(tmp_path / "grown"), buckets=2)
    t = catalog.Table(spark, "grown")
    t.insert(features(spark, [(f"n{k}", k) for k in range(100)]))
    first = set(t.states.state()["base"])
    t.insert(features(spark, [("x", 1)]))
    t.upsert(features(spark, [("n1", -1)]))
    assert first <= set(t.states.state()["base"]) and t.states.state()["rows"] | {"": 0} != {}
    assert spark.table("grown").count() == 101 and catalog.metadata(spark, "grown")["count"] == 101
    assert catalog.collection(spark, "grown").filter(V.lt(0)).df.first().id == "n1"
    catalog.drop_collection(spark, "grown")
    assert not spark.catalog.tableExists("grown")


# Layouts.


def test_windows_read_few_row_groups(spark, tmp_path):
    """A window of one hundredth of the area meets less than a twentieth of the row groups."""
    n = 40000
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.rand(3) * 360 - 180).alias("x"), (F.rand(4) * 180 - 90).alias("y"))
    df = rows.select("id", F.lit(None).cast("string").alias("geometry"), F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 0.01).alias("xmax"), (F.col("y") + 0.01).alias("ymax"), F.parse_json(F.lit("{}")).alias("doc"))
    frame = FeatureFrame(df)
    laid = catalog.optimize_layout(frame, [], str(tmp_path / "l"), files=8, by_space=True, rows=100)
    groups = [g for f in (tmp_path / "l").glob("*.parquet") for g in _stats(f)]
    assert len(groups) >= 400
    for k in range(5):
        x, y = -170 + 60 * k, -80 + 30 * k
        w = (x, y, x + 36, y + 18)
        met = [g for g in groups if g["xmin"][0] <= w[2] and g["xmax"][1] >= w[0] and g["ymin"][0] <= w[3] and g["ymax"][1] >= w[1]]
        assert len(met) < 0.05 * len(groups)
        ids = lambda f: {r.id for r in f.window(w).df.select("id").collect()}  # noqa: E731, B023
        assert ids(laid) == ids(frame) and len(ids(laid)) > 200
    assert "LessThanOrEqual(xmin" in plan(laid.window(w).df)


def _stats(path):
    m = pq.ParquetFile(path).metadata
    for k in range(m.num_row_groups):
        g = m.row_group(k)
        cols = {g.column(j).path_in_schema: g.column(j).statistics for j in range(g.num_columns)}
        yield {c: (cols[c].min, cols[c].max) for c in ("xmin", "ymin", "xmax", "ymax")}


def test_curve_without_geometries(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "id string").select("id", *[F.lit(None).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.parse_json(F.lit("{}")).alias("doc"))
    assert catalog.optimize_layout(FeatureFrame(df), [], str(tmp_path / "l"), by_space=True).df.count() == 2
    assert catalog.optimize_layout(FeatureFrame(df.limit(0)), [], str(tmp_path / "m"), by_space=True).df.count() == 0


def test_layouts_are_kept_through_writes(spark, tmp_path):
    catalog.create_collection(spark, "lasting", (0, 0, 9, 9), path=str(tmp_path / "c"), buckets=2)
    t = catalog.Table(spark, "lasting")
    t.insert(features(spark, [(f"n{k}", k) for k in range(40)]))
    catalog.put_layout(spark, "lasting", "by_v", [("properties.v", "number")], str(tmp_path / "l"))
    same = lambda p: {r.id for r in catalog.collection(spark, "lasting", "by_v").filter(p).df.select("id").collect()}
    plainly = lambda p: {r.id for r in catalog.collection(spark, "lasting").filter(p).df.select("id").collect()}
    changes = [
        lambda: None,
        lambda: t.insert(features(spark, [("new", 3), ("more", 50)])),
        lambda: t.upsert(features(spark, [("n1", 30), ("n39", 1), ("other", 2)])),
        lambda: t.upsert(features(spark, [("n1", 2), ("new", 39)])),
    ]
    for change in changes:
        change()
        laid = catalog.collection(spark, "lasting", "by_v")
        assert laid.ready
        for p in (V.lt(3), V.eq(2), ~V.gt(1), V.ne(30) & V.ge(29), V.between(1, 3)):
            assert same(p) == plainly(p)
        assert "LessThan(p_properties_v" in laid.filter(V.lt(3)).df._jdf.queryExecution().toString()
    t.delete(V.eq(5))
    assert not catalog.collection(spark, "lasting", "by_v").ready and same(V.lt(7)) == plainly(V.lt(7))
    catalog.drop_collection(spark, "lasting")


# Numbers.

numbers = st.decimals(allow_nan=False, allow_infinity=False) | st.decimals(min_value=-100, max_value=100, places=25) | st.integers(-(10**40), 10**40).map(Decimal)


@settings(max_examples=300, deadline=None)
@given(numbers, numbers)
def test_keys_sort_as_numbers(a, b):
    assert (key_of(a) < key_of(b)) == (a < b) and (key_of(a) == key_of(b)) == (a == b)


NUMBERS = [
    "0", "-0", "0.0", "00.10", "1", "1.0", "1e0", "-1", "1e-25", "-1e-25", "2e-25", "0.0000000000000000000000001", "12.00000000000000000000000001", "12", "12.0000000000000000004", "12.0000000000000000006",
    "123456789012345678901234567890", "123456789012345678901234567891", "-123456789012345678901234567890", "1e30", "1e300", "-1e300", "99999999999999999999.999999999999999999", "100000000000000000000", "1E+20", ".5", "5.", "0.1", "3.5e-19",
]


def test_keys_in_columns_equal_those_in_python(spark):
    rows = spark.createDataFrame([(n,) for n in [*NUMBERS, "", "x", "1e", "--1", ".", "1 2", "NaN", None]], "n string").select("n", number_key(F.col("n")).alias("k")).collect()
    assert [r.k for r in rows[: len(NUMBERS)]] == [key_of(Decimal(n)) for n in NUMBERS]
    assert {r.k for r in rows[len(NUMBERS) :]} == {None}


def test_comparisons_of_any_precision(spark, tmp_path):
    """Each number with each, as Python's Decimal compares them, in both modes and in a layout."""
    json_number = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?\Z")
    inside = [n for n in NUMBERS if json_number.match(n)]
    df = spark.createDataFrame([(n, json.dumps({"properties": {"t": n}})[:-2] + ', "v": %s}}' % n) for n in inside], "id string, j string")
    df = df.select("id", F.parse_json("j").alias("doc"))
    # VARIANT keeps 38 digits.
    value = {n: Decimal(n) for n in inside}
    frame = FeatureFrame(df)
    laid = catalog.optimize_layout(frame, [("properties.v", "number")], str(tmp_path / "l"))
    ops = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
    others = [Decimal(n) for n in ("0", "1", "1e-25", "-1e-25", "12", "12.0000000000000000005", "12.00000000000000000000000001", "123456789012345678901234567890", "1e20", "99999999999999999999.999999999999999999", "-1e300", "3.5e-19")] + [0.1, 12]
    text = FeatureFrame(df, mode="text")
    tests = {f"{name} {other}": (op, other, getattr(V, name)(other), getattr(prop("properties.t"), name)(other)) for name, op in ops.items() for other in others}
    for f in (frame, laid, text):
        got = f.df.select("id", *[p.column(f.binding).alias(k) for k, (_, _, p, _) in tests.items()]).collect()
        for r in got:
            for k, (op, other, _, _) in tests.items():
                assert r[k] == op(value[r.id], Decimal(str(other))), (r.id, k, f.mode, f.ready)
    got = text.df.select("id", *[p.column(text.binding).alias(k) for k, (_, _, _, p) in tests.items()]).collect()
    assert all(r[k] == op(value[r.id], Decimal(str(other))) for r in got for k, (op, other, _, _) in tests.items())
    low, high = Decimal("1e-25"), Decimal("12.0000000000000000005")
    want = {n for n, x in value.items() if low <= x <= high}
    assert {r.id for r in frame.filter(V.between(low, high)).df.collect()} == want
    some = [Decimal("1e-25"), Decimal("123456789012345678901234567891"), 1]
    assert {r.id for r in frame.filter(V.isin(*some)).df.collect()} == {n for n, x in value.items() if x in some}
    assert {r.id for r in frame.filter(prop("properties").contains({"v": 12})).df.collect()} == {n for n, x in value.items() if x == 12}


def test_two_properties_of_any_precision(spark):
    pairs = [(a, b) for a in ("1", "1.0000000000000000000000001", "1e30", "123456789012345678901234567891") for b in ("1", "1.0000000000000000000000002", "1e30", "123456789012345678901234567890")]
    df = spark.createDataFrame([(str(k), '{"properties":{"v":%s,"w":%s}}' % p) for k, p in enumerate(pairs)], "id string, j string").select("id", F.parse_json("j").alias("doc"))
    f, w = FeatureFrame(df), prop("properties.w")
    for name, op in (("lt", operator.lt), ("eq", operator.eq), ("ge", operator.ge)):
        assert {r.id for r in f.filter(getattr(V, name)(w)).df.collect()} == {str(k) for k, (a, b) in enumerate(pairs) if op(Decimal(a), Decimal(b))}


def test_keys_evaluate_their_text_once(spark):
    df = spark.createDataFrame([("12.50",), ("-0.001",), ("x",)], "t string").select(number_key(F.lower("t")).alias("k"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r.k for r in df.collect()] == [key_of(Decimal("12.5")), key_of(Decimal("-0.001")), None]


def test_constants_at_the_edge_of_the_decimal_type(spark, tmp_path):
    """38 digits aren't rounded to the 28 of Decimal's own arithmetic."""
    edge = "99999999999999999999.999999999999999999"
    values = [edge, f"-{edge}", "12"]
    df = spark.createDataFrame([(v, '{"properties": {"v": %s}}' % v) for v in values], "id string, j string").select("id", F.parse_json("j").alias("doc"))
    laid = catalog.optimize_layout(FeatureFrame(df), [("properties.v", "number")], str(tmp_path / "l"))
    others = [Decimal(f"{sign}{edge}{more}") for sign in ("", "-") for more in ("", "5")]
    tests = {f"{name} {o}": (getattr(operator, name), o) for name in ("eq", "ne", "lt", "le", "gt", "ge") for o in others}
    for r in laid.df.select("id", *[getattr(V, op.__name__)(o).column(laid.binding).alias(k) for k, (op, o) in tests.items()]).collect():
        assert {k: r[k] for k in tests} == {k: op(Decimal(r.id), o) for k, (op, o) in tests.items()}
