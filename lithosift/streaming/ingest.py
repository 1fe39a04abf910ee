"""Continuous ingest of GeoJSON lines into a versioned collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.writes import Collection
from ..sources.features import parse


def ingest(spark: SparkSession, source: str, target: Collection, checkpoint: str, id_type: str = "text", rejects: str | None = None, once: bool = False, max_files: int = 128) -> StreamingQuery:
    """Upserts the lines of new files in a folder, batch by batch.

    Within a batch the last line of an id holds: the later file by name, then the later line. Across batches the later batch. A batch
    is written as a delta, so its cost is that of its own lines; now and then the collection compacts. A batch that is run again after a failure
    is known by its number and the checkpoint folder and applied once. Rejects are written with their batch's number.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(source)
    lines = lines.withColumn("file", F.col("_metadata.file_name")).withColumn("block", F.col("_metadata.file_block_start"))

    def apply(batch: DataFrame, number: int) -> None:
        # monotonically_increasing_id grows along a file's block.
        got = parse(batch.withColumn("line_no", F.monotonically_increasing_id()), id_type=id_type, keep=("file", "block", "line_no"))
        rows = got.features.withColumn("order", F.struct("file", "block", "line_no")).drop("file", "block", "line_no")
        target.upsert(rows, order="order", source=checkpoint, number=number)
        if rejects:
            got.rejects.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    writer = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
