"""Continuous page intake: new files in a folder become pages and OCR replies. Routing, translation and a block sink are not composed here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import is_page_image
from ..operators.ranking import last_wins
from ..plugins import run_ocr
from ..schema import BINARY_FILE
from ..sources.files import file_name


def page_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New page images: page_id, name, content."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
             .option("maxFilesPerTrigger", max_files).load(path))
    named = files.withColumn("name", file_name(F.col("path"))).where(is_page_image(F.col("name")))
    return named.select(F.col("path").alias("page_id"), "name", "content")


def start_intake(pages: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    """Run `work(batch, batch_id)` on every micro-batch.

    `work` isolates failures per page by writing an error column. Stop the
    query to pause and start it again with the same checkpoint to go on; a
    batch that was cut short is repeated under the same id, which the
    versioned sinks take as the same write.
    """
    writer = pages.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def ocr_to_table(engine: Callable[[], Callable[[bytes], list[dict]]], path: str) -> Callable[[DataFrame, int], None]:
    """Work for `start_intake`: append OCR replies and errors per page to a Parquet table.

    The batch id is the version, so a repeated batch is recognised; see
    `latest_replies`.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        replies = run_ocr(batch, engine).withColumn("version", F.lit(batch_id).cast("long"))
        replies.write.mode("append").parquet(path)

    return work


def latest_replies(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, reply, error of its newest batch."""
    return last_wins(spark.read.parquet(path), ["page_id"], ["version"]).drop("version")
