"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that count as white space in texts: space and 9 to 13.
WHITE = b" \t\n\x0b\x0c\r"
#: Arrow batches hold up to so many rows and bytes (Spark's default, this package's), unless the session sets limits of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(1 << 21))}
#: Bytes of text that a worker takes in hand at once; a longer text is taken alone.
PART = 1 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application; bound Arrow batches by their bytes."""
    for name, (default, value) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(), f"{root.name}.zip")
    path.write_bytes(packed.getvalue())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def give_back() -> None:
    """Freed memory goes back to the system; the C library would keep some 60 MB of it in each worker, which live on."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def thrifty(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on batches; freed memory is given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def parts(texts: pa.Array, limit: int = PART) -> Iterator[list[str]]:
    """The texts of an Arrow array in order, in lists of about limit bytes; nulls are empty."""
    out, held = [], 0
    for t in texts:
        out.append(t.as_py() or "")
        held += len(out[-1])
        if held >= limit:
            yield out
            out, held = [], 0
    if out:
        yield out


def per_text(spark: SparkSession, work: Callable[[list[str]], pa.Array], schema: str, text: Column) -> Column:
    """The column that work gives for texts, as an Arrow UDF: only the text goes through Python, in byte-bounded parts."""
    ship(spark)

    def run(texts: pa.Array) -> pa.Array:
        done = [work(part) for part in parts(texts)]
        out = pa.concat_arrays(done) if done else work([])
        del done
        give_back()
        return out

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Else a filter on what it gives, such as a join's, would be moved before it and run it twice.
    return F.arrow_udf(run, schema).asNondeterministic()(text)


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoint-")


def folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; only where that is unset (tests on one machine) in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or _local_folder()
    return f"{root}/lithosift-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and go on from there; drop() deletes it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lithosift_table = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_lithosift_table", None):
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: Up to this many rows (16 to 50 bytes each) are broadcast; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 1 << 18


def few(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id and text, of whatever docs has; a null text becomes empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def same(a: Column, b: Column) -> Column:
    """Equality for which null equals null."""
    return a.eqNullSafe(b)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
