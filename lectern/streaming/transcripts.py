"""Transcripts as they arrive: an addition to the batch operators, for folders that are still being filled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions import text as X
from lectern.sources.readers import TRANSCRIPT


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New transcript files of a folder, with their number; outputs beside them are left out."""
    rows = spark.readStream.schema(TRANSCRIPT).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "chunk_*.json").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_name")).where(~F.col("file").rlike("aligned|_error"))
    return rows.withColumn("chunk_no", X.chunk_number(F.col("file")))


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator over each batch of new rows and write what it gives under the batch's number, so that a
    batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def words_per_window(stream: DataFrame, time: str, text: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Recognised words per window of arrival, for watching a running transcription; rows later than ``late`` are
    dropped from the state."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(X.english_tokens(F.col(text)))).alias("words")).select("w.start", "w.end", "n", "words")
