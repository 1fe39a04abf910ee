"""Insert, upsert, delete and update on versioned collections.

A collection's state is a list of parts: base parts, whose ids differ, and deltas, each with one row per id, of which the later hold over
the earlier and over the base. An insert adds a base part, an upsert a delta; a delete and an update write a new base. Parts are
tables bucketed by id, all into the same number of buckets, so looking for ids, merging when read and compacting join bucket with
bucket: what is already there is never shuffled.

A state is a numbered file in _states, created only if it is absent, so of two writers that read the same state one gets ConcurrentWrite,
whatever the two do; readers never see half of a change, and nothing is lost if a writer is. Every change carries the version that it read.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import envelope
from ..functions.predicates import Predicate
from .frame import FeatureFrame

#: Deltas, or base parts, from which on the small ones are put together.
MAX_PARTS = 8
#: All is put together once the deltas have this share of the base's rows.
SHARE = 0.25
#: Seconds for which vacuum() spares what no state needs, as a writer may be about to commit it.
SPARED = 24 * 3600
EMPTY = {"base": [], "deltas": [], "applied": {}, "rows": {}, "buckets": None}


class DuplicateIds(ValueError):
    pass


class ConcurrentWrite(RuntimeError):
    pass


@dataclass(frozen=True)
class Collection:
    """A versioned collection of features at a path that all executors share.

    buckets counts for a new one (by default Spark's number of shuffle partitions); its parts are tables of the catalog's database.
    """

    spark: SparkSession
    path: str
    buckets: int | None = None
    database: str | None = None

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    # States.

    def versions(self) -> list[int]:
        """The numbers of all states, those that are being written included."""
        fs, path = self._fs()
        folder = path(f"{self.path}/_states")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int | None:
        """The last state that is whole."""
        return next((v for v in reversed(self.versions()) if self._text(v).endswith("\n")), None)

    def _text(self, version: int) -> str:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/_states/{version}.json"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return EMPTY if version is None else json.loads(self._text(version))

    def _create(self, target: str, data: bytes) -> bool:
        """Writes a new file; False if there is one. Local folders have no exclusive create in Hadoop, but links are exclusive."""
        fs, path = self._fs()
        p = path(target)
        fs.mkdirs(p.getParent())
        if fs.getScheme() == "file":
            name = p.toUri().getPath()
            own = os.path.join(os.path.dirname(name), f".{uuid.uuid4().hex}")
            with open(own, "wb") as f:
                f.write(data)
            try:
                os.link(own, name)
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        stream.write(data)
        stream.close()
        return True

    def commit(self, after: int | None, state: dict) -> int:
        """The state becomes the one that follows version after, which the change has read. Its number."""
        number = (after or 0) + 1
        used = {*state["base"], *state["deltas"]}
        state = {**state, "rows": {k: n for k, n in state["rows"].items() if k in used}}
        if not self._create(f"{self.path}/_states/{number}.json", f"{json.dumps(state)}\n".encode()):
            raise ConcurrentWrite(f"{self.path} has a version {number} already")
        return number

    # Parts.

    def _table(self, name: str) -> str:
        """The catalog's name of a part; a session that doesn't know it yet is told where it is."""
        table = f"{f'{self.database}.' if self.database else ''}features_{name}"
        if not self.spark.catalog.tableExists(table):
            schema = self.spark.read.parquet(f"{self.path}/{name}").schema
            buckets = name.rpartition("_")[2]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return table

    def _write(self, df: DataFrame, state: dict) -> tuple[str, dict]:
        """Writes a part; its name, and the state with its rows counted."""
        buckets = state["buckets"] or self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"v_{uuid.uuid4().hex}_{buckets}"
        # Bucketed by the same number, rows that come from other parts stay where they are.
        df.repartition(buckets, "id").write.format("parquet").bucketBy(buckets, "id").sortBy("id").option("path", f"{self.path}/{name}").saveAsTable(f"{f'{self.database}.' if self.database else ''}features_{name}")
        return name, {**state, "buckets": buckets, "rows": {**state["rows"], name: self._part(name).count()}}

    def _part(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def _forget(self, *names: str) -> None:
        fs, path = self._fs()
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {f'{self.database}.' if self.database else ''}features_{name}")
            fs.delete(path(f"{self.path}/{name}"), True)

    def unlist(self) -> None:
        """Takes the parts' tables out of the catalog; their files stay, and who reads them lists them again."""
        fs, path = self._fs()
        for f in fs.listStatus(path(self.path)):
            if (name := f.getPath().getName()).startswith("v_"):
                self.spark.sql(f"DROP TABLE IF EXISTS {f'{self.database}.' if self.database else ''}features_{name}")

    def drop(self) -> None:
        """Deletes the collection with all its versions."""
        fs, path = self._fs()
        if fs.exists(path(self.path)):
            self._forget(*[n for f in fs.listStatus(path(self.path)) if (n := f.getPath().getName()).startswith("v_")])
            fs.delete(path(self.path), True)

    def vacuum(self, keep: int = 1, spared: float = SPARED) -> int:
        """Deletes the parts that none of the last keep states has, and older states. Returns how many parts went.

        What is younger than spared seconds stays, so spared must be longer than any change takes.
        """
        fs, path = self._fs()
        before = (time.time() - spared) * 1000
        versions = self.versions()
        last = self.version()
        whole = [v for v in versions if last is not None and v <= last]
        used = {n for v in whole[-keep:] for k in ("base", "deltas") for n in self.state(v)[k]}
        gone = [f.getPath().getName() for f in fs.listStatus(path(self.path)) if f.getModificationTime() <= before]
        gone = [n for n in gone if n.startswith("v_") and n not in used]
        self._forget(*gone)
        for v in [*whole[:-keep], *[v for v in versions if v not in whole]]:  # those after the last whole one were left by lost writers
            p = path(f"{self.path}/_states/{v}.json")
            if fs.getFileStatus(p).getModificationTime() <= before:
                fs.delete(p, False)
        return len(gone)

    # Reading.

    def sql(self, state: dict | None = None) -> str:
        """The state's rows as a query over the parts' tables."""
        state = self.state() if state is None else state
        every = [*state["base"], *state["deltas"]]
        if not every:
            raise FileNotFoundError(self.path)
        names = self._part(every[0]).columns
        columns = ", ".join(f"`{c}`" for c in names)
        if not state["deltas"]:
            return " UNION ALL ".join(f"SELECT {columns} FROM {self._table(n)}" for n in state["base"])
        new = " UNION ALL ".join(f"SELECT {columns}, {k} AS __no FROM {self._table(n)}" for k, n in enumerate(state["deltas"]))
        rest = ", ".join(f"`{c}`" for c in names if c != "id")
        ordered = ", ".join(f"id AS `{c}`" if c == "id" else f"__row.`{c}` AS `{c}`" for c in names)
        # Each base part is joined by itself, so that its buckets are seen.
        old = "".join(f"SELECT {columns} FROM {self._table(n)} LEFT ANTI JOIN __last USING (id) UNION ALL " for n in state["base"])
        return f"WITH __new AS ({new}), __last AS (SELECT id, max_by(struct({rest}), __no) AS __row FROM __new GROUP BY id) {old}SELECT {ordered} FROM __last"

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.state(version))

    def _rows(self, state: dict) -> DataFrame:
        return self.spark.sql(self.sql(state))

    def since(self, rows: DataFrame, covered: list[str], state: dict, more: dict[str, Column]) -> DataFrame | None:
        """The state's rows, where rows stand for the covered parts and all others get the columns more; None if some of the covered are gone."""
        if not set(covered) <= {*state["base"], *state["deltas"]}:
            return None
        rest = {**state, "base": [n for n in state["base"] if n not in covered], "deltas": [n for n in state["deltas"] if n not in covered]}
        if rest["deltas"]:
            changed = self._rows({**rest, "base": []}).select("id")
            rows = rows.join(changed, "id", "left_anti").select(*rows.columns)
        return rows.unionByName(self._rows(rest).withColumns(more)) if rest["base"] or rest["deltas"] else rows

    def frame(self, **options) -> FeatureFrame:
        return FeatureFrame(self.read(), **options)

    # The changes.

    def replace(self, df: DataFrame, after: int | None = None) -> int:
        """df, made from version after, becomes the collection's state."""
        state = self.state(after) if after is not None else EMPTY
        name, state = self._write(df, state)
        return self.commit(after, {**state, "base": [name], "deltas": []})

    def compact(self) -> None:
        """All parts become one."""
        version = self.version()
        self.replace(self._rows(self.state(version)), version)

    def _tidy(self, version: int) -> None:
        """After an append: puts small parts together, and all of them once the deltas are a good part of the base.

        What is put together has at least the rows of the largest of its parts once more, so a row is written anew a number
        of times that grows as the logarithm of the collection's size. If another writer comes in between, it is left for later.
        """
        state = self.state(version)
        rows, base, deltas = state["rows"], state["base"], state["deltas"]
        try:
            if len(deltas) >= MAX_PARTS or len(base) >= MAX_PARTS:
                if deltas and sum(rows[n] for n in deltas) >= SHARE * sum(rows[n] for n in base):
                    self.replace(self._rows(state), version)
                    return
            if len(deltas) >= MAX_PARTS:
                some = _tail(deltas, rows)
                name, new = self._write(self._rows({**state, "base": [], "deltas": some}), state)
                self.commit(version, {**new, "deltas": [*deltas[: -len(some)], name]})
            elif len(base) >= MAX_PARTS:
                some = _tail(sorted(base, key=lambda n: -rows[n]), rows)
                name, new = self._write(self._rows({**state, "base": some, "deltas": []}), state)
                self.commit(version, {**new, "base": [*[n for n in base if n not in some], name]})
        except ConcurrentWrite:
            pass

    def insert(self, new: DataFrame) -> int:
        """Adds features; none if an id repeats or is there already. Returns how many. What is there isn't written again."""
        version = self.version()
        name, state = self._write(new, self.state(version))
        part = self._part(name)
        try:
            _no_duplicates([self._part(n) for n in (*state["base"], *state["deltas"])], part)
        except DuplicateIds:
            self._forget(name)
            raise
        self._tidy(self.commit(version, {**state, "base": [*state["base"], name]}))
        return state["rows"][name]

    def upsert(self, new: DataFrame, order: str | None = None, source: str | None = None, number: int | None = None) -> int:
        """Adds features or replaces those of the same id; of a repeated id the last by order holds. Returns how many.

        A load that names its source and a number is applied once: a repetition of it changes nothing and returns 0.
        """
        version = self.version()
        state = self.state(version)
        if source is not None and number <= state["applied"].get(source, -1):
            return 0
        name, state = self._write(latest(new, order), state)
        applied = state["applied"] if source is None else {**state["applied"], source: number}
        self._tidy(self.commit(version, {**state, "deltas": [*state["deltas"], name], "applied": applied}))
        return state["rows"][name]

    def delete(self, predicate: Predicate, **options) -> int:
        version = self.version()
        before = self._rows(self.state(version))
        n = FeatureFrame(before, **options).filter(predicate).df.count()
        if n:
            self.replace(deleted(before, predicate, **options), version)
        return n

    def update(self, predicate: Predicate, feature: DataFrame, **options) -> int:
        version = self.version()
        before = self._rows(self.state(version))
        new = updated(before, predicate, feature, **options)
        n = FeatureFrame(before, **options).filter(predicate).df.count()
        if n:
            self.replace(new, version)
        return n


def _tail(parts: list[str], rows: dict[str, int]) -> list[str]:
    """The last parts, from the first that has no more rows than all after it."""
    for k in range(len(parts) - 1):
        if rows[parts[k]] <= sum(rows[n] for n in parts[k + 1 :]):
            return parts[k:]
    return parts[-2:]


def duplicates(target: DataFrame | list[DataFrame] | None, new: DataFrame) -> DataFrame:
    """The ids of new that repeat, or that target, one frame or several, has."""
    out = new.groupBy("id").count().filter("count > 1").select("id")
    for part in target if isinstance(target, list) else [] if target is None else [target]:
        out = out.unionByName(new.select("id").join(part.select("id"), "id", "left_semi"))
    return out


def _no_duplicates(target: DataFrame | list[DataFrame] | None, new: DataFrame) -> None:
    found = [r.id for r in duplicates(target, new).limit(5).collect()]
    if found:
        raise DuplicateIds(f"ids are there already or repeat: {', '.join(map(str, found))}")


def inserted(target: DataFrame | None, new: DataFrame) -> DataFrame:
    _no_duplicates(target, new)
    return new if target is None else target.unionByName(new)


def latest(new: DataFrame, order: str | None = None) -> DataFrame:
    """One feature per id: the last by the order column."""
    if order is None:
        return new.dropDuplicates(["id"])
    rest = [c for c in new.columns if c not in ("id", order)]
    # VARIANT has no order, but max_by needs none of what it returns.
    return new.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("__row")).select("id", *[F.col(f"__row.{c}").alias(c) for c in rest])


def upserted(target: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """target with new's features in place of those of the same id; of a repeated id the last holds."""
    last = latest(new, order)
    return target.join(last.select("id"), "id", "left_anti").unionByName(last.select(*target.columns))


def deleted(target: DataFrame, predicate: Predicate, **options) -> DataFrame:
    """target without the features for which the predicate is true; where it is null they stay."""
    f = FeatureFrame(target, **options)
    return target.filter(~F.coalesce(predicate.column(f.binding, f.bbox), F.lit(False)))


def updated(target: DataFrame, predicate: Predicate, feature: DataFrame, **options) -> DataFrame:
    """Document and geometry of every matching feature replaced by those of feature, which has one row; ids stay."""
    given = feature.limit(2).count()
    if given != 1:
        raise ValueError(f"an update takes one feature, not {'none' if not given else 'several'}")
    f = FeatureFrame(target, **options)
    new = feature.select(F.col("doc").alias("__doc"), F.col("geometry").alias("__geometry"))
    hit = F.coalesce(predicate.column(f.binding, f.bbox), F.lit(False))
    df = target.join(F.broadcast(new)).withColumn("__hit", hit)  # one row, as counted
    e = envelope(F.col("__geometry"))
    values = {"doc": F.col("__doc"), "geometry": F.col("__geometry"), **e}
    return df.select(*[F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])
