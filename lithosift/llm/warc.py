"""WARC archives: written by Spark's text sink, read back in parallel by boundary-chain verification.

Writing. A record is one text row, and the sink's line end is the record's last line break, so every part file is an archive. Of rows with
equal payloads (by SHA-256) of at least LEAST bytes the one with the smallest id is a response, the others are revisits that refer to it and
carry no payload.

Reading. Spark's text source deals out byte ranges and parts them at each line that begins like a record. Such a line may also stand inside a payload,
so each is a candidate only. A task gives every candidate the offset of its successor (from its head's Content-Length), and,
by pointer jumping within the task's range, the first successor beyond the range. A file's ranges are then linked by pointer jumping from offset 0
over a table with a few rows for each range: each round doubles the distance, so a file of B ranges takes log2(B) rounds. What isn't reached is payload.
The second scan knows where the chain enters each range, follows it and gives out the records; a payload that false beginnings cut across ranges
is put together from its pieces.

Both scans read whole ranges in order; between them go rows for candidates (two offsets) and ranges. Compressed files are read too, each as one range.

Defined results: null payloads are empty; null urls give no target; line breaks in urls are escaped; null ids are written as empty and are
never the response that others refer to; rows that repeat the smallest id are all responses; empty tables give no files and no rows; other
columns aren't read. A file whose chain breaks gives the records before the break, and chains() says that it isn't sound. A last record
that is cut short is given with complete = false.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, drop, ship, thrifty

#: Bytes of a payload from which on equal ones are written once.
LEAST = 100
DATE = "2000-01-01T00:00:00Z"
#: Copies of the other side for a join beyond a broadcast, so that no key is in one task.
SALTS = 32

# Fixed values of the format.
MAGIC = b"WARC/1."
LINE = b"\r\n"
BREAK = LINE + MAGIC
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http"


# Writing.


def _spread(left: DataFrame, right: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """left's rows with those of right, which has each key once: by a broadcast if right has few rows, else salted."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, "left")
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"], "left").drop("__salt")


def record_id(id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(id.cast("string")), F.lit("")), F.lit(">"))


def _head(*lines: tuple[str, Column]) -> Column:
    """The lines of a head whose values aren't null."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in lines], F.lit("\r\n"))


def rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """id, url, payload, digest, first: of a revisit, first is the id of the row that has its payload, else it is null."""
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 AND first IS NOT NULL")
    out = _spread(p, cut(first.select("digest", "first")), ["digest"], F.col("id"))
    return out.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = DATE) -> None:
    """A record per row of pages, in archives in the folder path."""
    r = rows(pages, id_col, url_col, payload_col, least)
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, "").otherwise(F.concat(http, "payload"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = _head(
        ("WARC-Type", F.when(again, "revisit").otherwise("response")),
        ("WARC-Record-ID", record_id(F.col("id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        ("WARC-Profile", F.when(again, F.lit(REVISIT))),
        ("WARC-Refers-To", F.when(again, record_id(F.col("first")))),
        ("Content-Type", F.when(~again, F.lit(f"{HTTP}; msgtype=response"))),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    # A record ends with two line breaks; the second is the sink's.
    record = F.concat(F.lit("WARC/1.1\r\n"), head, "block", F.lit("\r\n"))
    r.withColumn("block", block).select(record).write.option("lineSep", "\r\n").text(path)


# Reading.


def head(piece: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a record's head (names in lower case) and its length, of what follows MAGIC; None if it is no head."""
    end = piece.find(LINE + LINE)
    if end < 0 or piece[:3] not in (b"0" + LINE, b"1" + LINE):
        return None
    fields: dict[str, str] = {}
    name = None
    for line in piece[3:end].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in " \t" and name:  # a folded line
            fields[name] = f"{fields[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon:
            return None
        fields[name] = value.strip()
    length = fields.get("content-length", "")
    return (fields, end + 4) if length.isascii() and length.isdigit() else None


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (the range's begin), bytes: what stands between the beginnings of records, in order."""
    df = spark.read.option("lineSep", BREAK.decode()).text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("bytes"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, bytes]]:
    """(other columns, whether the piece is its range's first, the piece without MAGIC); a file's begin without MAGIC gives an empty piece."""
    last = None
    for b in batches:
        others = [b.column(n).to_pylist() for n in b.schema.names if n != "bytes"]
        for *row, piece in zip(*others, b.column("bytes"), strict=True):
            new = row[:2] != last
            last = row[:2]
            yield tuple(row), new, piece.as_py()


def successors(starts: list[int], nexts: list[int], end: int) -> np.ndarray:
    """For each candidate of a range the first offset on its chain that is end or more; -1 if the chain meets no candidate before."""
    at, to = np.array(starts, np.int64), np.array(nexts, np.int64)
    k = np.searchsorted(at, to)
    found = (k < len(at)) & (at[np.minimum(k, len(at) - 1)] == to)
    jump = np.where(found, k, np.arange(len(at)))
    while True:  # each round doubles the distance
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    out = to[jump]
    return np.where(out >= end, out, -1)


_RANGES = "file string, block bigint, size bigint, start array<bigint>, exit array<bigint>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per range: its size and its candidates. Offsets count from the range's first piece; the break before that is in front of it."""

    def done() -> pa.RecordBatch:
        # Where the last piece ends: a break, or the end of the file.
        exits = successors(starts, nexts, at - len(BREAK)) if starts else np.zeros(0, np.int64)
        cols = [[key[0]], [key[1]], [at], [starts], [exits.tolist()]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "block", "size", "start", "exit"])

    key, at, starts, nexts = None, 0, [], []
    for row, new, piece in _in_order(batches):
        if new:
            if key is not None:
                yield done()
            key, at, starts, nexts = row, 0, [], []
        first = new and row[1] == 0
        begin = 0 if first else at - len(MAGIC)
        got = head(piece.removeprefix(MAGIC) if first else piece) if not first or piece.startswith(MAGIC) else None
        if got:
            starts.append(begin)
            nexts.append(begin + len(MAGIC) + got[1] + int(got[0]["content-length"]) + len(LINE) * 2)
        at += len(piece) + len(BREAK)
    if key is not None:
        yield done()


def reached(candidates: DataFrame, ranges: int) -> DataFrame:
    """file, start of those candidates (file, start, exit) that a chain from 0 enters; ranges is the most that a file has."""
    here = candidates.filter("start = 0").select("file", "start")
    jump = candidates.select("file", "start", "exit")
    for _ in range(math.ceil(math.log2(ranges)) if ranges > 1 else 0):
        here = cut(here.unionByName(here.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))).distinct())
        to = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("beyond"))
        jump = cut(jump.join(to, ["file", "exit"]).select("file", "start", F.col("beyond").alias("exit")))
    return here


def chains(spark: SparkSession, path: str) -> DataFrame:
    """A row per range of the archives: file, block, base (its first piece's offset), size, entry (where the chain's first record in it begins, or
    null), open (where the record ends that is open at its begin), end (where the last range that the chain goes through leads to, 0 if it breaks in the first) and sound (whether that is the file's end)."""
    ship(spark)
    found = cut(_pieces(spark, path).mapInArrow(thrifty(_scan), _RANGES))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(found.select("file", "block", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")))
    most = base.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    pairs = found.join(base.select("file", "block", "base"), ["file", "block"]).select("file", "block", "base", F.explode(F.arrays_zip("start", "exit")).alias("c"))
    every = pairs.select("file", "block", (F.col("base") + F.col("c.start")).alias("start"), F.when(F.col("c.exit") >= 0, F.col("base") + F.col("c.exit")).alias("exit"))
    # Only where some range's chain leads to, or at offset 0, can a chain enter a range.
    targets = every.select("file", F.col("exit").alias("start")).filter("start IS NOT NULL").distinct()
    enters = cut(every.join(targets, ["file", "start"], "left_semi").unionByName(every.filter("start = 0")))
    entry = enters.join(reached(enters, most), ["file", "start"], "left_semi").select("file", "block", F.col("start").alias("entry"), "exit")
    whole = Window.partitionBy("file")
    out = base.join(entry, ["file", "block"], "left").withColumn("open", F.last("exit", True).over(before))
    out = out.withColumn("end", F.coalesce(F.max("exit").over(whole), F.lit(0))).withColumn("sound", F.col("end") == F.max(F.col("base") + F.col("size")).over(whole) - len(BREAK))
    out = cut(out.select("file", "block", "base", "size", "entry", "open", "end", "sound"))
    drop(found, base, enters)
    return out


_RECORD = [("file", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("complete", pa.bool_())]
RECORD = "file string, offset bigint, type string, record_id string, uri string, refers_to string, digest string, fields map<string,string>, payload binary, complete boolean"


def _record(file: str, offset: int, data: bytes) -> tuple:
    """The record whose bytes, without MAGIC, data begins with. The payload of an HTTP message is what follows its head."""
    fields, at = head(data)
    length = int(fields["content-length"])
    block = data[at : at + length]
    if fields.get("content-type", "").startswith(HTTP):
        body = block.find(LINE + LINE)
        payload = block[body + 4 :] if body >= 0 else b""
    else:
        payload = block
    named = (fields.get(n) for n in ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest"))
    return file, offset, *named, list(fields.items()), payload, len(block) == length


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), _RECORD, strict=True)], names=[n for n, _ in _RECORD])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, int, int | None, bytes, bool]]:
    """(file, begin, offset, next, bytes, last): records and pieces of records. begin is null for pieces of a record of an earlier range;
    last is true for all but a record that is still open where its range ends."""
    held: list | None = None  # file, begin, offset, next, list of bytes
    at, expect = 0, None
    for row, new, piece in _in_order(batches):
        file, block, base, entry, opened = row
        if new:
            if held:
                yield *held[:4], b"".join(held[4]), False
            at, expect = base, entry
            held = None
        first = new and block == 0
        begin = 0 if first else at - len(MAGIC)
        body = piece.removeprefix(MAGIC) if first else piece
        if begin == expect:
            if held:
                yield *held[:4], b"".join(held[4]), held[1] is not None
            fields, size = head(body)
            expect = begin + len(MAGIC) + size + int(fields["content-length"]) + 2 * len(LINE)
            held = [file, begin, begin, expect, [body]]
        elif held:
            held[4].append(BREAK + piece)
        elif opened is not None and at < opened:
            held = [file, None, at, opened, [BREAK + piece]]
        at += len(piece) + len(BREAK)
    if held:
        yield *held[:4], b"".join(held[4]), False


def _whole(next: int, begin: int, data: bytes) -> bool:
    """Whether data, without MAGIC, reaches to the end of the record's block."""
    return begin + len(MAGIC) + len(data) >= next - 2 * len(LINE)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for file, begin, _, next, data, last in _walk(batches):
        if begin is None or not (last or _whole(next, begin, data)):
            continue
        out.append(_record(file, begin, data))
        size += len(data)
        if size >= 1 << 21:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


_PART = "file string, begin bigint, offset bigint, next bigint, data binary"


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of records that go over several ranges, or that the file's end cuts short."""
    for file, begin, offset, next, data, last in _walk(batches):
        if begin is None or not (last or _whole(next, begin, data)):
            cols = [pa.array([file]), pa.array([begin], pa.int64()), pa.array([offset], pa.int64()), pa.array([next], pa.int64()), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "begin", "offset", "next", "data"])


def _joined(parts: pa.Table) -> pa.Table:
    """One record of its pieces; none if its begin is missing."""
    rows = sorted(parts.to_pylist(), key=lambda r: r["offset"])
    found = [_record(rows[0]["file"], rows[0]["begin"], b"".join(r["data"] for r in rows))] if rows[0]["begin"] is not None else []
    return pa.Table.from_batches([_batch(found)] if found else [], schema=pa.schema(_RECORD))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives at path: file, offset, type, record_id, uri, refers_to, digest, fields, payload, complete."""
    ranges = chains(spark, path)
    known = ranges.select("file", "block", "base", "entry", "open")

    def placed(pieces: DataFrame) -> DataFrame:
        """The pieces with their ranges' numbers, in order."""
        names = ["file", "block", "base", "entry", "open", "bytes"]
        if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            return pieces.join(F.broadcast(known), ["file", "block"]).select(*names)
        pieces = pieces.withColumn("seq", F.monotonically_increasing_id()).join(known, ["file", "block"])
        return pieces.repartition("file", "block").sortWithinPartitions("file", "block", "seq").select(*names)

    out = placed(_pieces(spark, path)).mapInArrow(thrifty(_records), RECORD)
    # A range that doesn't begin with the chain's next record begins inside one, and a chain may end before its file's end.
    torn = ranges.filter("(block > 0 AND NOT (entry <=> base - 7)) OR NOT sound").select("file").distinct()
    if not torn.isEmpty():
        pieces = _pieces(spark, path)
        some = torn.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        parts = placed(pieces.join(F.broadcast(torn) if some else torn, "file", "left_semi")).mapInArrow(thrifty(_open), _PART)
        out = out.unionByName(parts.groupBy("file", "next").applyInArrow(_joined, RECORD))
    return out


def page_id(record: Column, type: str) -> Column:
    """The id that record_id() wrote."""
    return F.url_decode(F.nullif(F.regexp_extract(record, "^<urn:page:(.*)>$", 1), F.lit(""))).cast(type)


def describe(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, of records that write() wrote; a revisit's payload is that of the response it refers to."""
    digest = F.sha2("payload", 256)
    seen = cut(records.select("record_id", "type", "refers_to", F.regexp_replace("digest", "^sha256:", "").alias("stated"), digest.alias("digest"), F.octet_length("payload").cast("bigint").alias("size")))
    responses, revisits = seen.filter("type = 'response'"), seen.filter("type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("record_id"), F.col("stated").alias("digest")).distinct()
    found = responses.join(wanted, ["record_id", "digest"], "left_semi").groupBy("record_id", "digest").agg(F.first("size").alias("size"))
    found = cut(found.select(F.col("record_id").alias("refers_to"), F.col("digest").alias("stated"), "size"))
    again = _spread(revisits.drop("size", "digest"), found, ["refers_to", "stated"], F.col("record_id")).select("record_id", "type", "refers_to", F.when(F.col("size").isNotNull(), F.col("stated")).alias("digest"), "size")
    every = responses.select("record_id", "type", "refers_to", "digest", "size").unionByName(again)
    return every.select(page_id(F.col("record_id"), id_type).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page_id(F.col("refers_to"), id_type).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY t) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
