"""Exact dedup with composable polynomial fingerprints.

A text, without its white space, is a byte string b. Its fingerprint is the pair of
values of the polynomial sum(b[i] * R**(n-1-i)) modulo two primes, with its length n.
Such hashes compose: hash(x + y) = hash(x) * R**len(y) + hash(y). So a document is hashed
chunk by chunk, and a huge document's chunks are hashed by different tasks: they
are dealt out as rows and their hashes are combined with the same shift in an aggregate.

Texts with equal fingerprints are then compared, chunk against chunk, in a join of the
group's members with one representative; no task holds a group, and the join
streams chunks, not documents. Texts that collide (same fingerprint, other bytes) are
grouped again by their bytes.

Defined results: a null text counts as empty; empty texts are equal to each other; ids may be
null and rows may repeat (of rows alike in all that ranks them, exactly one stays); an empty
table gives an empty result; other columns are neither read nor touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, drop, few, id_and_text, per_text, same

#: Moduli and multipliers of the two polynomials. Products of residues stay below 2**63.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525 * 401 + 1)
#: Bytes of a chunk. A sum of CHUNK products of a byte and a residue stays below 2**63.
CHUNK = 1 << 16
#: Documents over this many bytes are dealt out by chunk before they are hashed.
HUGE = 1 << 23

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int) -> np.ndarray:
    """base**(CHUNK-1), ..., base**0 modulo prime."""
    if (base, prime) not in _powers:
        out = np.ones(CHUNK, np.int64)
        n = 1
        while n < CHUNK:  # doubles the known powers each time
            step = pow(base, n, prime)
            out[n : 2 * n] = out[:n] * step % prime
            n *= 2
        _powers[base, prime] = out[::-1].copy()
    return _powers[base, prime]


def hash_chunk(data: bytes, base: int, prime: int) -> int:
    """The polynomial hash of at most CHUNK bytes."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    return int(np.dot(b, powers(base, prime)[CHUNK - len(b) :]) % prime)


def combine(left: int, right: int, n_right: int, base: int, prime: int) -> int:
    """The hash of x + y from the hashes of x and y and the length of y."""
    return (left * pow(base, n_right, prime) + right) % prime


def fingerprint(data: bytes, bases=BASES, primes=PRIMES) -> tuple[int, int]:
    """Both hashes of a whole byte string, chunk by chunk."""
    out = []
    for base, prime in zip(bases, primes, strict=True):
        h = 0
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            h = combine(h, hash_chunk(part, base, prime), len(part), base, prime)
        out.append(h)
    return out[0], out[1]


FP = [("n_points", pa.int64()), ("n_bytes", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sha", pa.string())]
FP_SCHEMA = "n_points bigint, n_bytes bigint, fp1 bigint, fp2 bigint, sha string"
PART = pa.list_(pa.struct([("no", pa.int32()), ("part", pa.binary())]))


def _of(text: str, primes) -> tuple[bytes, tuple]:
    data = text.encode().translate(None, WHITE)
    return data, (len(text), len(data), *fingerprint(data, primes=primes), hashlib.sha256(data).hexdigest())


def _structs(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Array:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], fields=[pa.field(n, k) for n, k in kinds])


def _fingerprints(primes, texts: list[str]) -> pa.Array:
    return _structs([_of(t, primes)[1] for t in texts], FP)


def _chunks(primes, texts: list[str]) -> pa.Array:
    """Fingerprints, and the text's chunks."""
    rows = []
    for t in texts:
        data, head = _of(t, primes)
        rows.append((*head, [{"no": at // CHUNK, "part": data[at : at + CHUNK]} for at in range(0, max(1, len(data)), CHUNK)]))
    return _structs(rows, [*FP, ("parts", PART)])


def _chunk_hashes(primes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of each chunk, moved left by the bytes that follow it: those of a text only have to be added."""
    for batch in batches:
        rest = [max(0, n - (no + 1) * CHUNK) for n, no in zip(batch.column("n_bytes").to_pylist(), batch.column("no").to_pylist(), strict=True)]
        hashes = [[hash_chunk(x, b, p) * pow(b, r, p) % p for x, r in zip(batch.column("part").to_pylist(), rest, strict=True)] for b, p in zip(BASES, primes, strict=True)]
        kept = [n for n in batch.schema.names if n != "part"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(h, pa.int64()) for h in hashes)], [*kept, "h1", "h2"])


def _huge_fingerprints(huge: DataFrame, primes) -> DataFrame:
    """The same columns for huge documents: their chunks are hashed wherever there is room."""
    kind = dict(huge.dtypes)["doc_id"]
    data = F.translate("text", WHITE.decode(), "").cast("binary")
    parts = (
        huge.select("doc_id", "uid", F.length("text").cast("long").alias("n_points"), data.alias("data"))
        .select("doc_id", "uid", "n_points", F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha"), "data", F.explode(F.expr(f"sequence(0, greatest(length(data) - 1, 0) div {CHUNK})")).alias("no"))
        .selectExpr("doc_id", "uid", "n_points", "n_bytes", "sha", "no", f"substring(data, no * {CHUNK} + 1, {CHUNK}) AS part")
        .repartition("uid", "no")
    )
    shifted = parts.mapInArrow(lambda b: _chunk_hashes(primes, b), f"doc_id {kind}, uid long, n_points long, n_bytes long, sha string, no long, h1 long, h2 long")
    return shifted.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_points").alias("n_points"), F.first("n_bytes").alias("n_bytes"), F.first("sha").alias("sha"),
        (F.sum("h1") % primes[0]).alias("fp1"), (F.sum("h2") % primes[1]).alias("fp2"),
    )


def fingerprints(docs: DataFrame, primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """A row per row of docs (columns doc_id, text): doc_id, uid, which numbers the rows, n_points, n_bytes, fp1, fp2 and sha."""
    spark = docs.sparkSession
    rows = docs.withColumn("uid", F.monotonically_increasing_id())
    made = per_text(spark, lambda texts: _fingerprints(primes, texts), FP_SCHEMA, F.col("text")).alias("f")
    plain = rows.filter(F.octet_length("text") <= huge).select("doc_id", "uid", made).select("doc_id", "uid", "f.*")
    return plain.unionByName(_huge_fingerprints(rows.filter(F.octet_length("text") > huge), primes))


def _members(docs: DataFrame, ids: DataFrame, primes) -> DataFrame:
    """(doc_id, fingerprints, no, part): the chunks of the documents whose ids are given."""
    ids = few(ids)
    hit = docs.join(ids, same(docs["doc_id"], ids["id"]), "left_semi")
    made = per_text(docs.sparkSession, lambda texts: _chunks(primes, texts), FP_SCHEMA + ", parts array<struct<no:int,part:binary>>", F.col("text")).alias("f")
    return hit.select("doc_id", made).select("doc_id", "f.fp1", "f.fp2", "f.n_bytes", "f.sha", F.explode("f.parts").alias("c")).select("doc_id", "fp1", "fp2", "n_bytes", "sha", "c.no", "c.part")


KEY = ["fp1", "fp2", "n_bytes"]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_points, n_bytes.

    Of equal texts the row with the most code points stays, then the smallest doc_id (null last).
    """
    docs = id_and_text(docs, id_col, text_col)
    fps = cut(fingerprints(docs, primes, huge))
    rank = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("uid").alias("d"))
    groups = cut(fps.groupBy(*KEY).agg(F.count("*").alias("group_size"), F.min(rank).alias("best"), F.min("sha").alias("sha_a"), F.max("sha").alias("sha_z")))
    # Equal fingerprints are candidates: one representative of each group, then all members chunk by chunk against it.
    several = groups.filter("group_size > 1").select(*KEY, F.col("best.c").alias("rep_id"))
    ids = fps.join(several, KEY, "left_semi").select(F.col("doc_id").alias("id")).distinct()
    reps = several.select(F.col("rep_id").alias("id")).distinct()
    parts = _members(docs, ids, primes)
    theirs = _members(docs, reps, primes).join(several, KEY).filter(same(F.col("doc_id"), F.col("rep_id")))
    # An id may repeat with other bytes of the same fingerprint: one of its texts represents.
    # Written once, so that Spark deals out both sides of the join itself and can split a hot group.
    theirs = cut(theirs.groupBy(*KEY, "no").agg(F.max_by("part", "sha").alias("rep_part")))
    unlike = parts.join(theirs, [*KEY, "no"]).filter(F.col("part") != F.col("rep_part"))
    collided = cut(unlike.select(*KEY).distinct())
    drop(theirs)
    out = fps.join(groups.drop("sha_a", "sha_z"), KEY)
    if not collided.isEmpty():
        out = _by_bytes(docs, fps, out, collided, rank)
    return out.select("doc_id", F.col("best.c").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.d")).alias("kept"), F.col("sha").alias("text_sha256"), "n_points", "n_bytes")


def _by_bytes(docs: DataFrame, fps: DataFrame, out: DataFrame, collided: DataFrame, rank) -> DataFrame:
    """As out, but the groups in collided are parted by their bytes. Few texts collide, if any."""
    bad = fps.join(collided, KEY, "left_semi")
    texts = docs.join(bad.select(F.col("doc_id").alias("id")).distinct(), F.expr("doc_id <=> id"), "left_semi")
    data = texts.select("doc_id", F.translate("text", WHITE.decode(), "").alias("data")).distinct()
    held = bad.alias("f").join(data.alias("d"), F.expr("f.doc_id <=> d.doc_id AND f.sha = sha2(d.data, 256)")).select("f.*", "data")
    own = held.groupBy("data").agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
    apart = held.join(own, "data").select(*fps.columns, "group_size", "best")
    return out.join(collided, KEY, "left_anti").select(*apart.columns).unionByName(apart)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns, without the rows that classes() drops."""
    made = cut(classes(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_points").alias("__n"), F.col("kept").alias("__kept")))
    # An id names one row, as a rule: then the ids that go are all there is to know.
    again = cut(made.groupBy("__id").count().filter("count > 1").select("__id"))
    gone = cut(made.filter("NOT __kept").select("__id").distinct())
    out = docs.join(few(gone), same(F.col(id_col), F.col("__id")), "left_anti")
    if again.isEmpty():
        return out
    # Rows that repeat an id are looked up by their text too, and one stays of those alike in both.
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(F.translate(text, WHITE.decode(), ""), 256)
    twice = docs.join(again, same(F.col(id_col), F.col("__id")), "left_semi")
    kept = made.filter("__kept")
    one = twice.join(kept, same(F.col(id_col), F.col("__id")) & (sha == F.col("__sha")) & (F.length(text) == F.col("__n")), "left_semi")
    alone = docs.join(gone, same(F.col(id_col), F.col("__id")), "left_anti").join(again, same(F.col(id_col), F.col("__id")), "left_anti")
    return alone.unionByName(one.dropDuplicates([id_col, text_col]))
