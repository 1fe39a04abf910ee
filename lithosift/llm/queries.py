"""One query per operator of this subpackage, over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, lexical, line_dedup, mixing, near_dedup, ogg, packing, pii, token_counts, toxicity, url_filter, warc
from .common import documents, folder


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_runs(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "removed_lines", "removed_chunks", F.sha2("text", 256).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.describe_media(ogg.to_media(documents(spark, sf_dir))).drop("error")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.number(packing.digest(packing.pieces(documents(spark, sf_dir))))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, sf_dir), arrays=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"), "words_within")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(documents(spark, sf_dir)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, url_filter.flooding_addresses(pages), by="address")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum(documents(spark, sf_dir))
    # Documents that aren't taken have no position; the id parts them.
    order = [F.get("position", F.lit(0)), "doc_id"]
    plan = plan.repartitionByRange(*order).sortWithinPartitions(*order)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = folder(spark)
    warc.write(pages, path)
    return warc.describe(warc.read(spark, path), pages.schema["page_id"].dataType.simpleString())


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_exact_dedup, op3_media_columns, op4_packing, op5_token_counts, op6_pii, op7_url_filter, op8_near_dedup, op9_mixing, op10_toxicity, op11_collocations, op12_warc, op13_lexical_search)}


#: Texts are equal without their white space; the longest stays, then the smallest id.
EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT_SQL, "op7_url_filter": url_filter.SQL, "op9_mixing": mixing.SQL, "op11_collocations": collocations.SQL, "op12_warc": warc.SQL, "op13_lexical_search": lexical.SQL}
