"""Intake of an upload folder as a stream: each new file once, described and saved by batch. An addition to the classic front end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import described, expanded


def uploads(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of path, filename, content, received of the files that come to a folder.

    `received` is when the stream meets a file, not the file's own time stamp, which may be of any age: by that a watermark would take
    an old file for a late one and leave it out.
    """
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.current_timestamp().alias("received"))


def run(spark: SparkSession, folder: str, to: str, checkpoint: str, *, keep: str = "7 days", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Describes new files, those with a content seen within `keep` left out, and appends them to Parquet at `to`.

    The state that drops repeats is bounded by the watermark on the time of receipt. A batch that is run again overwrites its own
    folder, so each file is there once. Processes what is there and stops.
    """
    rows = uploads(spark, folder).withColumn("sha256", F.sha2("content", 256)).withWatermark("received", keep).dropDuplicatesWithinWatermark(["sha256"])

    def save(batch: DataFrame, n: int) -> None:
        out = described(expanded(batch.select("path", "filename", "content")), "stream")
        out.write.mode("overwrite").parquet(f"{to.rstrip('/')}/batch={n}")
        if each is not None:
            each(out, n)

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
