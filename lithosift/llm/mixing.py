"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Training runs over t in [0, 1]. Source i has a target of T_i words and a weight schedule
T_i * (START_i + 2 * (1 - START_i) * t); unless it is given otherwise, START is 1.5 for the sources of weight 1 (early), 1 for weight 2,
0.5 for weight 3 (late). Its integral is the cumulative demand D_i(t), with D_i(1) = T_i. The source's documents, in
the order of a hash, form a stream that is read up to 3 times; the word at c of that stream is consumed when
D_i(t) = c, so the training position of a copy of a document that starts at c is D_i inverted at c.
A copy is taken if its middle lies before T_i, so a source's taken words miss the target by half a document at most.

The hash is that of the id, or of the text where there is none. Running sums: rows are dealt by (source, first digits of the hash), added up within such a cell and
shifted by the sums of the cells before. A source is never one group: the cells have about equal numbers
of rows, whatever the sources' sizes.

Defined results: a null text has size 0; the null source is a source, the last; null ids and repeated rows are
documents of their own; documents of size 0 are never taken; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: No document is used more often, and no target exceeds so many times its source.
MOST = 3
#: First hex digits of the hash that make a cell: 4096 cells a source.
DIGITS = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def early(weight: Column) -> Column:
    """The schedule's start: sources of little weight come early, those of weight 3 late."""
    return (4 - weight) * 0.5


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text that is never null and sorts like the source, null last."""
    return F.when(source.isNull(), "2").otherwise(F.concat(F.lit("1"), source.cast("string")))


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with each source's place in the order of key, from 0: counted part by part of a range sort."""
    parts = cut(sizes.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row for each part
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return parts.join(F.broadcast(before), "part").withColumn("place", F.col("before") + within - 1).drop("part", "before")


def targets(sizes: DataFrame, weights: tuple | dict = WEIGHTS, start: Callable[[Column], Column] = early, most: int = MOST) -> DataFrame:
    """From (key, source_size), key being a source's source_key(): also weight, target and start.

    weights are given out in turn in the order of the sources, or by source (0 for those that aren't named). Water filling: targets are
    weight * level, at most most * source_size. The level is raised by what the limited sources leave until no more
    sources reach their limit; each time is one aggregate over the sources.
    """
    if isinstance(weights, dict):
        by = F.create_map(*[F.lit(x) for k, w in weights.items() for x in ("2" if k is None else f"1{k}", w)])
        s = sizes.withColumn("weight", F.coalesce(F.try_element_at(by, F.col("key")), F.lit(0)).cast("long"))
    else:
        s = ranked(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")).drop("place")
    s = cut(s)
    limit = most * F.col("source_size")
    total, all_w = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, rest_w, capped = total, all_w, F.lit(False)
    while rest_w:
        capped = limit.cast("decimal(38,0)") * rest_w <= F.lit(rest).cast("decimal(38,0)") * F.col("weight")
        full, full_w = s.filter(capped).agg(F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - full, all_w - full_w) == (rest, rest_w) or full_w == all_w:
            break
        rest, rest_w = total - full, all_w - full_w
    level = (F.col("weight") * rest).cast("double") / F.lit(float(rest_w or 1))
    return s.select("key", "source_size", "weight", F.when(capped, limit.cast("double")).otherwise(level).alias("target"), start(F.col("weight")).alias("start"))


def positions(c: Column, target: Column, start: Column) -> Column:
    """t at which the cumulative demand target * (start * t + (1 - start) * t * t) reaches c."""
    x = c / target
    a = F.lit(1.0) - start
    return F.when(start == 1, x).otherwise((F.sqrt(start * start + 4 * a * x) - start) / (2 * a))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = (), weights: tuple | dict = WEIGHTS, start: Callable[[Column], Column] = early) -> DataFrame:
    """A row per row of docs: doc_id, size, source_size, target, taken, copies, position (of each taken copy, an array), and keep's columns in a struct named row.

    weights and start are those of targets(); start gives a number from 0 (all late) to 2 (all early) for a weight.
    """
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    d = docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("key"), words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("h"), row.alias("row"))
    d = d.withColumn("cell", F.substring("h", 1, DIGITS))
    cells = cut(d.groupBy("key", "cell").agg(F.sum("size").alias("cell_size")))
    plan = targets(cells.groupBy("key").agg(F.sum("cell_size").alias("source_size")), weights, start)
    earlier = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0))).drop("cell_size").join(plan, "key")
    within = Window.partitionBy("key", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(within))
    # Dealt out by the same two columns as the window, so the rows stay where they are.
    d = d.join(cells, ["key", "cell"]).select("doc_id", "size", "row", "source_size", "target", "start", (F.col("base") + F.col("upto") - F.col("size")).alias("at"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda k: k.cast("long") * F.col("source_size") + F.col("at"))
    starts = F.filter(starts, lambda c: (2 * c + F.col("size")).cast("double") < 2 * F.col("target"))
    d = d.withColumn("starts", F.when(F.col("size") > 0, starts).otherwise(F.array().cast("array<bigint>")))
    return d.select("doc_id", "size", "source_size", "target", (F.size("starts") * F.col("size")).cast("long").alias("taken"), F.size("starts").alias("copies"), F.transform("starts", lambda c: positions(c.cast("double"), F.col("target"), F.col("start"))).alias("position"), "row")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple | dict = WEIGHTS, start: Callable[[Column], Column] = early) -> DataFrame:
    """docs' columns, a row per copy that training consumes, range-sorted by training position."""
    d = curriculum(docs, id_col, text_col, source_col, keep=docs.columns, weights=weights, start=start).filter("copies > 0")
    d = d.select(F.explode("position").alias("__position"), "row")
    return d.repartitionByRange("__position").sortWithinPartitions("__position").select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h FROM documents),
s AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
r AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_w,
    CAST(sum(3 * source_size) OVER w AS BIGINT) AS full_s, CAST(sum(weight) OVER w AS BIGINT) AS full_w
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, 3 * source_size * (all_w - full_w) <= (total - full_s) * weight AS capped FROM r),
k AS (
  SELECT *, CAST(sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS BIGINT) AS cap_sum,
    CAST(sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS BIGINT) AS cap_w FROM c),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(weight * (total - cap_sum) AS DOUBLE) / CAST(all_w - cap_w AS DOUBLE) END AS target FROM k),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start_at
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (
    CASE WHEN CAST(2 * start_at + size AS DOUBLE) < 2 * target THEN 1 ELSE 0 END
  + CASE WHEN CAST(2 * (start_at + source_size) + size AS DOUBLE) < 2 * target THEN 1 ELSE 0 END
  + CASE WHEN CAST(2 * (start_at + 2 * source_size) + size AS DOUBLE) < 2 * target THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
