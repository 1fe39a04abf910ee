"""Line dedup over content-defined chunks of lines. DataFrame functions only.

A text is split at line feeds, each line is hashed, and a hash rolls over the line hashes: its window holds two lines
that aren't empty and follow each other, with the empty lines between them. The first place of a rolling hash is
its smallest in the corpus (doc_id, null first, then place in the document).

dedup_runs() cuts texts into chunks where the rolling hash says so: a chunk is the longest run of lines whose rolling hashes have
their first places elsewhere, one after the other in one document; where the first places stop or jump, a chunk ends. So
boundaries depend on a passage alone and stay where they are, whatever stands before or after it, and a passage of two lines is
a chunk as one of a thousand is. A chunk is then compared with the lines at its first place, byte by byte, and goes if
they are equal. Of a chunk with equal hashes and other bytes, the windows are grouped by their bytes and go one by one. Chunks
also end at each BLOCK-th window of the first place, so that copies of all kinds of parts of one document share nearly all of what they
are compared with. A window that overlaps its own first place isn't a second one. Each line that goes has an equal one at an earlier
place, so all lines stay somewhere.

dedup_lines() is the plainer form that needs no counts of the corpus to find boundaries: a rolling polynomial over the hashes of WINDOW lines
gives a value at each line, and a chunk ends at each line whose value is below that of the lines before and after it; chunks have two
lines at least, three on average, and those of two or more lines that occur again go. It finds long passages without the
lines at their borders, and misses short ones.

Defined results: a null text counts as empty; texts of one line are never changed; rows that repeat both doc_id and
text are one document, so they are changed alike; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, id_and_text

WINDOW = 2
#: Chunks of dedup_runs end at each so many windows of their first place.
BLOCK = 64
PRIME = (1 << 31) - 1
BASE = 1000003
#: Lists of up to this many rows (some 50 bytes each), or with arrays of up to 8 times as many elements (4 bytes each), are broadcast; longer ones are shuffled.
BROADCAST_ROWS = 1 << 18


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunked(text: Column) -> Column:
    """struct(lines, hashes, starts, ends): the chunks are lines[starts[k]] to lines[ends[k]], counted from 0."""

    def with_lines(s: Column) -> Column:
        hashes, n = s["hashes"], F.size(s["hashes"])
        small = lambda i: F.pmod(F.coalesce(F.get(hashes, i), F.lit(0)), F.lit(PRIME))

        def roll(_: Column, i: Column) -> Column:
            out = small(i - (WINDOW - 1))
            for k in reversed(range(WINDOW - 1)):
                out = F.pmod(out * BASE + small(i - k), F.lit(PRIME))
            return out

        def with_rolls(r: Column) -> Column:
            low = lambda i: (i > 0) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1))
            ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | low(i))
            return let(ends, lambda e: F.struct(s["lines"].alias("lines"), hashes.alias("hashes"), F.transform(e, lambda _, k: F.coalesce(F.get(e, k - 1) + 1, F.lit(0))).alias("starts"), e.alias("ends")))

        return let(F.transform(hashes, roll), with_rolls)

    lines = F.split(text, "\n", -1)
    return let(lines, lambda x: let(F.struct(x.alias("lines"), F.transform(x, lambda y: F.xxhash64(y)).alias("hashes")), with_lines))


def chunk_hash(hashes: Column) -> Column:
    """The hash of a chunk, from its lines' hashes."""
    return F.xxhash64(hashes)


def _some(a: Column, start: Column, n: Column) -> Column:
    """n elements of a, n > 0; slice() would go over all of a."""
    return F.transform(F.sequence(start, start + n - 1), lambda i: F.get(a, i))


def _text(s: Column, start: Column, n: Column) -> Column:
    return F.array_join(_some(s["lines"], start, n), "\n")


def chunks(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row per chunk of two or more lines: hash, at (its place), and text if asked for. docs has the texts' hashes in th, else each row would hash its text anew."""

    def one(s: Column) -> Column:
        def chunk(start: Column, k: Column) -> Column:
            n = F.get(s["ends"], k) - start + 1
            more = [_text(s, start, n).alias("part")] if with_text else []
            return F.struct(k.alias("no"), start.alias("start"), n.alias("n"), chunk_hash(_some(s["hashes"], start, n)).alias("hash"), *more)

        return F.transform(s["starts"], chunk)

    rows = docs.select("doc_id", "th", F.explode(let(chunked(F.col("text")), one)).alias("c")).filter("c.n >= 2")
    return rows.select("c.hash", F.struct("doc_id", "th", F.col("c.no").alias("no"), F.col("c.start").alias("start"), F.col("c.n").alias("n")).alias("at"), *(["c.part"] if with_text else []))


def _few(df: DataFrame, array: str | None = None) -> DataFrame:
    """df, to be broadcast if it has few rows, or few elements in its array column."""
    if array is None:
        return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    held = df.agg(F.sum(F.size(array) + 8)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_ROWS * 8 else df


def windows(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row per place of the rolling hash: hash, at (doc_id, th, the window's number, its first line and number of lines), and part if asked for."""
    lines = F.split("text", "\n", -1)
    # Explodes first, so that hashing runs in generated code.
    full = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size(lines) - 1).alias("no"), lines.alias("line")), lambda x: x["line"] != "")
    rows = docs.select("doc_id", "th", full.alias("full")).filter(F.size("full") >= 2)
    pairs = F.arrays_zip(F.slice("full", F.lit(1), F.size("full") - 1).alias("a"), F.slice("full", F.lit(2), F.size("full") - 1).alias("b"))
    rows = rows.select("doc_id", "th", F.posexplode(pairs).alias("k", "w"))
    n = (F.col("w.b.no") - F.col("w.a.no") + 1).alias("n")
    part = [F.concat("w.a.line", F.repeat(F.lit("\n"), n - 1), "w.b.line").alias("part")] if with_text else []
    return rows.select(window_hash(F.col("w.a.line"), F.col("w.b.line"), n).alias("hash"), F.struct("doc_id", "th", "k", F.col("w.a.no").alias("no"), n).alias("at"), *part)


def window_hash(a: Column, b: Column, n: Column) -> Column:
    """The rolling hash: of the hashes of a window's two lines and the number of its lines."""
    return F.xxhash64(F.xxhash64(a), F.xxhash64(b), n)


def repeated_chunks(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The places that go (doc_id, th, no, start and n: its first line and number of lines), and the tables that they are read from."""
    places = chunks(docs)
    several = cut(places.groupBy("hash").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("NOT first <=> last").drop("last"))
    held = chunks(docs, with_text=True).join(_few(several), "hash")
    # Written once, so that Spark deals out both sides of the next join itself and can split a hot chunk.
    firsts = cut(held.filter("at <=> first").groupBy("hash").agg(F.min("part").alias("first_part")))
    rest = held.filter("NOT at <=> first").join(firsts, "hash").select("hash", "at", "part", (F.col("part") == F.col("first_part")).alias("equal"))
    unlike = cut(rest.filter("NOT equal").select("hash", "at", "part"))
    gone = rest.filter("equal").select("at")
    if not unlike.isEmpty():
        own = unlike.groupBy("hash", "part").agg(F.min("at").alias("own"))
        gone = gone.unionByName(unlike.join(own, ["hash", "part"]).filter("NOT at <=> own").select("at"))
    return gone.select("at.*"), [several, firsts, unlike]


#: A place that isn't the first, nor overlaps it.
SECOND = "NOT at <=> first AND NOT (at.doc_id <=> first.doc_id AND at.th = first.th AND at.no < first.no + first.n)"


def runs(places: DataFrame) -> DataFrame:
    """From windows with an earlier place (at, first) the chunks: doc_id, th, no and n (first line, number of lines), and f_id, f_th, f_no (where the first place begins)."""
    w = places.select("at.doc_id", "at.th", F.col("first.doc_id").alias("f_id"), F.col("first.th").alias("f_th"), (F.col("at.k") - F.col("first.k")).alias("ahead"), F.floor(F.col("first.k") / BLOCK).alias("block"), F.struct("at.k", "at.no", "at.n", F.col("first.no").alias("f_no")).alias("w"))
    w = w.groupBy("doc_id", "th", "f_id", "f_th", "ahead", "block").agg(F.array_sort(F.collect_set("w")).alias("ws"))

    def chunk(ws: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(ws) - 1)
        after = lambda i: F.coalesce(F.get(ws, i)["k"] == F.get(ws, i - 1)["k"] + 1, F.lit(False))
        ends = F.arrays_zip(F.filter(every, lambda i: ~after(i)).alias("a"), F.filter(every, lambda i: ~after(i + 1)).alias("b"))
        first, last = (lambda e: F.get(ws, e["a"])), (lambda e: F.get(ws, e["b"]))
        return F.transform(ends, lambda e: F.struct(first(e)["no"].alias("no"), (last(e)["no"] + last(e)["n"] - first(e)["no"]).alias("n"), first(e)["f_no"].alias("f_no")))

    return w.select("doc_id", "th", "f_id", "f_th", F.explode(chunk(F.col("ws"))).alias("c")).select("doc_id", "th", "f_id", "f_th", "c.*")


def _with_parts(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The elements of ranges' array c (whose fields no and n are lines of the text of doc_id and th), a row each, with their text as part."""
    d = docs.join(_few(ranges.withColumnsRenamed({"doc_id": "r_id", "th": "r_th"}), "c"), F.expr("doc_id <=> r_id AND th = r_th"))
    parts = lambda lines: F.transform("c", lambda c: F.struct(c.alias("c"), F.array_join(_some(lines, c["no"], c["n"]), "\n").alias("part")))
    return d.select("doc_id", "th", F.explode(let(F.split("text", "\n", -1), parts)).alias("x")).select("doc_id", "th", "x.c.*", "x.part")


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The chunks that go (doc_id, th, no, n), and the tables that they are read from."""
    # Counted by the hash alone first, so that few places are written.
    several = cut(windows(docs).groupBy("hash").count().filter("count > 1").select("hash"))
    held = cut(windows(docs).join(_few(several), "hash"))
    drop(several)
    firsts = cut(held.groupBy("hash").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("NOT first <=> last").drop("last"))
    found = cut(runs(held.join(_few(firsts), "hash").filter(SECOND)))
    drop(firsts)
    first_ranges = cut(found.groupBy(F.col("f_id").alias("doc_id"), F.col("f_th").alias("th")).agg(F.collect_set(F.struct(F.col("f_no").alias("no"), "n")).alias("c")))
    # Written once, so that Spark deals out both sides of the next join itself and can split a hot chunk.
    theirs = cut(_with_parts(docs, first_ranges).groupBy(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), F.col("no").alias("f_no"), "n").agg(F.min("part").alias("first_part")))
    ranges = cut(found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("no", "n", "f_id", "f_th", "f_no")).alias("c")))
    mine = _with_parts(docs, ranges).alias("m")
    here = F.expr("m.f_id <=> t.f_id AND m.f_th = t.f_th AND m.f_no = t.f_no AND m.n = t.n")
    compared = cut(mine.join(theirs.alias("t"), here).select("doc_id", "th", "no", "m.n", (F.col("part") == F.col("first_part")).alias("equal")))
    drop(found, first_ranges, theirs, ranges)
    gone, tables = compared.filter("equal").select("doc_id", "th", "no", "n"), [compared, held]
    unlike = compared.filter("NOT equal").select(F.col("doc_id").alias("u_id"), F.col("th").alias("u_th")).distinct()
    if not unlike.isEmpty():
        hashes = held.join(unlike, F.expr("at.doc_id <=> u_id AND at.th = u_th"), "left_semi").select("hash").distinct()
        again = cut(windows(docs, with_text=True).join(hashes, "hash"))
        own = again.groupBy("hash", "part").agg(F.min("at").alias("first"))
        gone = gone.unionByName(again.join(own, ["hash", "part"]).filter(SECOND).select("at.doc_id", "at.th", "at.no", "at.n"))
        tables.append(again)
    return gone, tables


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, text (what stays), n_lines, n_chunks, removed_chunks and removed_lines."""
    docs = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    places, tables = repeated_chunks(docs)
    gone = cut(places.groupBy(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).agg(F.collect_set("no").alias("gone")))
    drop(*tables)
    rows = docs.join(_few(gone, "gone"), F.expr("doc_id <=> gone_id AND th = gone_th"), "left")

    def kept(s: Column) -> Column:
        nos = F.array_except(F.sequence(F.lit(0), F.size(s["ends"]) - 1), F.coalesce(F.col("gone"), F.array().cast("array<int>")))
        parts = lambda x: F.transform(x, lambda k: _text(s, F.get(s["starts"], k), F.get(s["ends"], k) - F.get(s["starts"], k) + 1))
        n = lambda x: F.aggregate(x, F.lit(0), lambda a, k: a + F.get(s["ends"], k) - F.get(s["starts"], k) + 1)
        return let(nos, lambda x: F.struct(F.array_join(parts(x), "\n").alias("text"), F.size(s["lines"]).alias("n_lines"), F.size(s["ends"]).alias("n_chunks"), (F.size(s["ends"]) - F.size(x)).alias("removed_chunks"), (F.size(s["lines"]) - n(x)).alias("removed_lines")))

    return rows.select("doc_id", let(chunked(F.col("text")), kept).alias("k")).select("doc_id", "k.*")


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, text (what stays without repeated chunks), n_lines, removed_chunks and removed_lines."""
    docs = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    places, tables = repeated_runs(docs)
    lines = F.transform("runs", lambda x: F.sequence(x["no"], x["no"] + x["n"] - 1))
    gone = places.groupBy(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).agg(F.collect_set(F.struct("no", "n")).alias("runs"))
    gone = cut(gone.select("gone_id", "gone_th", F.array_distinct(F.flatten(lines)).alias("gone_lines"), F.size("runs").alias("gone_chunks")))
    drop(*tables)
    rows = docs.join(_few(gone, "gone_lines"), F.expr("doc_id <=> gone_id AND th = gone_th"), "left")
    rows = rows.select("doc_id", F.split("text", "\n", -1).alias("lines"), "gone_lines", F.coalesce("gone_chunks", F.lit(0)).alias("removed_chunks"))
    rows = rows.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone_lines", F.array().cast("array<int>"))))
    text = F.array_join(F.transform("stay", lambda k: F.get("lines", k)), "\n").alias("text")
    return rows.select("doc_id", text, F.size("lines").alias("n_lines"), "removed_chunks", (F.size("lines") - F.size("stay")).alias("removed_lines"))
