"""URL filters: longest-prefix rules, then exact blocklist membership by a Bloom filter cascade.
DataFrame functions only.

The universe is every distinct key of the corpus (a key is a page's host, or its address: host and path); the list holds the
blocked ones. Level 0 is a Bloom filter of the listed keys, level 1 of the unlisted keys that level 0 lets
pass by mistake, level 2 of the listed keys that level 1 lets pass by mistake, and so on until a level has no false
positive in the universe. A key is followed through the levels to the first that doesn't have it: it is
listed if that level's number is odd. For all keys of the universe the answer is exact.

Keys are dealt to shards by hash, about SHARD listed ones each, and every shard has levels of its own: arrays of 64-bit words, BITS
bits a key, added up by Spark's bit_or. Level 0 has so many bits a key that it lets pass by mistake about as many keys as are listed, so level 1
isn't larger than the list where most keys of the corpus are unlisted. So the filters are a small table, a row for each shard, built and held by
Spark whatever the length of the list; the driver reads counts only. A page meets its shard's row, never a key: in a broadcast of the
table where its filters, as counted, are below BROADCAST bytes, else by shard number. Both give the same answer.

Defined results: a null url, or one without ://, has empty host and path, fits no rule and isn't listed; null
and empty keys in the list are ignored, as are keys that no page has; repeated rows are judged alike; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, few

#: Bits a key (with HASHES probes about 2% false positives a level), and of level 0 at most (2 in a million).
BITS, MOST_BITS = 8, 64
HASHES = 5
#: Listed keys of a shard, about: filters of 64 kB.
SHARD = 1 << 16
#: Bytes of all filters up to which they are broadcast.
BROADCAST = 1 << 26

#: The rules of the query: (verdict, host and path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host(url: Column) -> Column:
    h = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    which = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # a longer one wraps the shorter ones
        name, slash, rest = text.partition("/")
        fits = ((h == name) | h.endswith(f".{name}")) & p.startswith(slash + rest)
        which = F.when(fits, F.lit(text)).otherwise(which)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return which, verdict


def address(h: Column, p: Column) -> Column:
    """The key of a page: its host and path; empty without a host."""
    return F.when(h == "", "").otherwise(F.concat(h, p))


def probes(key: Column, level: int, bits: Column) -> list[Column]:
    """HASHES bit positions of a key, by double hashing."""
    a = F.xxhash64(key, F.lit(level))
    b = F.xxhash64(F.lit(level), key, F.lit("step")).bitwiseOR(F.lit(1))
    return [F.pmod(F.shiftright(a, 1) + F.lit(k) * F.shiftright(b, 8), bits) for k in range(HASHES)]


def passes(key: Column, level: int, words: Column) -> Column:
    """Whether the level has the key, perhaps by mistake; null without words."""
    hit = words.isNotNull()
    for at in probes(key, level, F.size(words).cast("long") * 64):
        hit = hit & (F.getbit(F.get(words, (at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return hit


def first_bits(listed: int, others: int) -> int:
    """Bits a key with which level 0 lets pass as many of the other keys as are listed, about."""
    return next((b for b in range(BITS, MOST_BITS) if others * (1 - math.exp(-HASHES / b)) ** HASHES <= listed), MOST_BITS)


def level_words(keys: DataFrame, level: int, bits: int = BITS) -> tuple[DataFrame, int]:
    """(shard, words), the Bloom filters of keys' columns shard and key, and their bytes."""
    sizes = cut(keys.groupBy("shard").agg(F.ceil(F.count("*") * bits / 64).alias("n")))
    empty = sizes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("word"), F.lit(0).cast("long").alias("bits"))
    size = 8 * (sizes.agg(F.sum("n")).first()[0] or 0)
    at = keys.join(few(sizes), "shard")
    at = at.select("shard", F.explode(F.array(*probes(F.col("key"), level, F.col("n") * 64))).alias("at"))
    bits = at.select("shard", F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    words = empty.unionByName(bits).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    out = cut(words.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")))
    drop(sizes)
    return out, size


class Cascade:
    """The filters, a row for each shard with its levels; size is the number of levels."""

    def __init__(self, filters: DataFrame | None, size: int, shards: int, wide: bool):
        self.filters, self.size, self.shards, self.wide = filters, size, shards, wide

    def listed(self, df: DataFrame, key: Column) -> DataFrame:
        """df with a boolean column listed: whether its key, of the universe or empty, is in the list."""
        if self.filters is None:
            return df.withColumn("listed", F.lit(False))
        df = df.withColumn("__key", key).withColumn("__shard", shard(F.col("__key"), self.shards))
        held = self.filters.select(F.col("shard").alias("__shard"), F.col("levels").alias("__levels"))
        df = df.join(held if self.wide else F.broadcast(held), "__shard", "left")
        out = F.lit(self.size % 2 == 1)
        for level in reversed(range(self.size)):  # a shard without this level ends here too
            hit = F.coalesce(passes(F.col("__key"), level, F.get("__levels", F.lit(level))), F.lit(False))
            out = F.when(~hit, F.lit(level % 2 == 1)).otherwise(out)
        return df.withColumn("listed", (F.col("__key") != "") & out).drop("__key", "__shard", "__levels")


def shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int")


def cascade(universe: DataFrame, listed: DataFrame, per_shard: int = SHARD, most: int = BROADCAST) -> Cascade:
    """From two frames with a column key."""
    on = listed.select("key").filter("key <> ''").distinct().withColumn("on", F.lit(True))
    here = cut(universe.select("key").filter("key <> ''").distinct().join(on, "key", "left").select("key", F.coalesce("on", F.lit(False)).alias("on")))
    n, every = here.agg(F.count_if("on"), F.count("*")).first()
    shards = max(1, -(-n // per_shard))
    total = 0
    here = here.withColumn("shard", shard(F.col("key"), shards))
    levels: list[DataFrame] = []
    inside, outside = here.filter("on"), here.filter("NOT on")
    while not inside.isEmpty():
        words, size = level_words(inside, len(levels), BITS if levels else first_bits(n, every - n))
        total += size
        tried = outside.join(words if size > most else F.broadcast(words), "shard")
        wrong = cut(tried.filter(passes(F.col("key"), len(levels), F.col("words"))).select("key", "on", "shard"))
        levels.append(words)
        inside, outside = wrong, inside
    if not levels:
        return Cascade(None, 0, shards, False)
    rows = [w.select("shard", F.struct(F.lit(k).alias("no"), "words").alias("level")) for k, w in enumerate(levels)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    filters = cut(union.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list("level")), lambda x: x["words"]).alias("levels")))
    drop(*levels)
    return Cascade(filters, len(levels), shards, total > most)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", by: str = "host", per_shard: int = SHARD, most: int = BROADCAST) -> DataFrame:
    """A row per row of pages: page_id, host, path, rule, listed, verdict.

    listed has a column key with the blocked hosts, or addresses if by is address. A rule's verdict comes first, then the list's.
    """
    p = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    key = {"host": F.col("host"), "address": address(F.col("host"), F.col("path"))}[by]
    p = cascade(p.select(key.alias("key")), listed, per_shard, most).listed(p, key)
    which, verdict = rule(F.col("host"), F.col("path"), rules)
    return p.select("page_id", "host", "path", which.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


#: A host floods the corpus if it has at least so many times the pages of the mean host.
FLOOD = 3


def flooding_addresses(pages: DataFrame, url_col: str = "url", times: int = FLOOD) -> DataFrame:
    """The list that the query uses: the addresses of hosts that flood the corpus (link farms and mirrors), whatever its size."""
    p = pages.select(host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path")).filter("host <> ''")
    hosts = cut(p.groupBy("host").agg(F.count("*").alias("n")))
    mean = hosts.agg(F.sum("n").alias("total"), F.count("*").alias("hosts"))
    flood = hosts.join(F.broadcast(mean), F.col("n") * F.col("hosts") >= times * F.col("total")).select("host")
    return p.join(flood, "host").select(address(F.col("host"), F.col("path")).alias("key"))


SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', {len(t)})" for k, t in RULES)}) AS v(kind, text, name, start, n)),
m AS (
  SELECT page_id, p.host, p.path, max_by(text, n) AS rule, max_by(kind, n) AS kind
  FROM (SELECT *, row_number() OVER () AS k FROM p) p LEFT JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  GROUP BY page_id, p.host, p.path, k)
SELECT page_id, m.host, path, rule, f.host IS NOT NULL AS listed, coalesce(kind, CASE WHEN f.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN (
  SELECT host FROM (SELECT host, count(*) AS n FROM p WHERE host <> '' GROUP BY host)
  QUALIFY n * count(*) OVER () >= {FLOOD} * sum(n) OVER ()) f ON m.host = f.host
"""
