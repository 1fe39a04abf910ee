"""The given tables as collections of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import line_of, multipoint_of, point_of, rectangle_of
from ..operators.frame import FeatureFrame, with_envelope
from .features import FEATURE, from_table


def _features(df: DataFrame, key: str, geometry: Column, json: Column) -> DataFrame:
    rows = df.select(F.col(key).cast("string").alias("id"), geometry.alias("geometry"), F.parse_json(json).alias("doc"))
    return with_envelope(rows).select(*FEATURE)


def _text(c: str) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


#: The property opt of an event: missing, null, text, number or array by the remainder of its id.
OPT = ("", ',"opt":null', ',"opt":"12"', ',"opt":12', ',"opt":[12,"a"]')


def events(spark: SparkSession, sf_dir: str, mode: str = "typed", spread: bool = False) -> FeatureFrame:
    """Points (user_id, value); properties event_type, user_id, value, day, props.k, tags, flag, opt.

    A row group is read by one task; spread deals the rows out first, for work that is dear and needs every row.
    """
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.repartition("event_id") if spread else df
    opt = F.element_at(F.array(*map(F.lit, OPT)), (F.col("event_id") % 5 + 1).cast("int"))
    json = F.concat(
        F.lit('{"type":"Feature","id":'), F.col("event_id").cast("string"), F.lit(',"properties":{"event_type":'), _text("event_type"), F.lit(',"user_id":'), F.col("user_id").cast("string"),
        F.lit(',"value":'), F.col("value").cast("string"), F.lit(',"day":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('","props":'), F.col("props"), F.lit(',"flag":'), (F.col("event_id") % 2 == 0).cast("string"),
        F.lit(',"tags":[{"n":'), (F.col("user_id") % 3).cast("string"), F.lit(',"t":'), _text("event_type"), F.lit('},{"n":'), (F.col("event_id") % 7).cast("string"), F.lit("}]"), opt, F.lit("}}"),
    )
    return FeatureFrame(_features(df, "event_id", point_of(F.col("user_id"), F.col("value")), json), mode=mode)


def suppliers(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Squares of side 4 around (s_nationkey, s_acctbal / 500)."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x, y = F.col("s_nationkey"), F.col("s_acctbal") / 500
    json = F.concat(F.lit('{"type":"Feature","properties":{"name":'), _text("s_name"), F.lit(',"nation":'), x.cast("string"), F.lit("}}"))
    return FeatureFrame(_features(df, "s_suppkey", rectangle_of(x - 2, y - 2, x + 2, y + 2), json))


def customers(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Lines from (c_nationkey, c_acctbal / 500), 3 to the right and 2 up."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x, y = F.col("c_nationkey"), F.col("c_acctbal") / 500
    json = F.concat(F.lit('{"type":"Feature","properties":{"segment":'), _text("c_mktsegment"), F.lit("}}"))
    return FeatureFrame(_features(df, "c_custkey", line_of((x, y), (x + 3, y + 2)), json))


def orders(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Two points each: (o_custkey % 100, o_orderkey % 100) and 5 further on both axes."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, y = F.col("o_custkey") % 100, F.col("o_orderkey") % 100
    json = F.concat(F.lit('{"type":"Feature","properties":{"status":'), _text("o_orderstatus"), F.lit(',"date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}}'))
    return FeatureFrame(_features(df, "o_orderkey", multipoint_of((x, y), (x + 5, y + 5)), json))


def parts(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """A table in plain mode: points (p_size, p_retailprice)."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    df = with_envelope(df.withColumn("geometry", point_of(F.col("p_size"), F.col("p_retailprice"))))
    return FeatureFrame(df, mode="plain", id="p_partkey")


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return from_table(df, "p_partkey", point_of(F.col("p_size"), F.col("p_retailprice")))


def items(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Orders without geometry, their line items as an array sorted by all its fields."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey")
    df = df.agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_quantity", "l_returnflag"))).alias("items"))
    return FeatureFrame(df.select(F.col("l_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("geometry"), F.to_variant_object(F.struct(F.col("l_orderkey").cast("string").alias("id"), F.lit("Feature").alias("type"), F.struct(F.transform("items", lambda i: F.struct(i["l_partkey"].alias("partkey"), i["l_quantity"].alias("quantity"), F.struct(i["l_returnflag"].alias("flag")).alias("more"))).alias("items")).alias("properties"))).alias("doc")))
