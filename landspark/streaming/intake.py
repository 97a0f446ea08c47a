"""Continuous intake of landed court documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rows import last_per_key
from ..plans.cases import normalize_cases
from ..sources.files import CASE_SCHEMA


def stream_cases(spark: SparkSession, in_dir: str, store: str, checkpoint: str, gazetteer: DataFrame,
                 court: str, max_files: int = 1000) -> StreamingQuery:
    """Read new files, normalise the cases and add them to the folder ``store``.

    Every micro-batch is folded to one row per id, the first in file and line order, and written to a
    folder of its own below ``store``. Nothing that was written is touched again, so a batch costs
    what it brings, and a failure loses nothing: the stream repeats the batch under the same number
    and overwrites its own half-written folder only. Several courts may share a store, each with a
    checkpoint of its own.
    """
    raw = (spark.readStream.schema(CASE_SCHEMA).option("maxFilesPerTrigger", max_files).json(in_dir)
           .withColumn("tribunal_source", F.lit(court))
           .withColumn("_at", F.col("_metadata.file_modification_time"))
           .withColumn("_file", F.col("_metadata.file_path")))

    def put(batch: DataFrame, epoch: int) -> None:
        line = F.monotonically_increasing_id().alias("line")
        ordered = batch.withColumn("seq", F.struct("_at", "_file", line)).drop("_at", "_file")
        normalize_cases(ordered, gazetteer).write.mode("overwrite").parquet(f"{store}/court={court}/epoch={epoch}")

    return (raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def streamed_cases(spark: SparkSession, store: str) -> DataFrame:
    """The cases of a store: of each court and id the row of the last batch."""
    rows = spark.read.parquet(store)
    return last_per_key(rows, ["court", "id"], ["epoch"]).drop("court", "epoch")
