"""Structured Streaming forms of the time windows, for feeds that arrive as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeglass.session import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder`` (a file or a folder of part files) as a stream of files."""
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def window_counts(stream: DataFrame, at: str, key: str, value: str, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling or sliding windows per key, with ``late`` allowed before a window is closed."""
    w = F.window(at, size, slide) if slide else F.window(at, size)  # of the watermarked column itself, else no window is ever closed
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return s.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions per key that end after a pause of ``gap``."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return s.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def run_available(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run the stream over what there is now and return the result as a table in the shared folder.

    Each batch of a ``complete`` result replaces the last one, so a batch that is run again changes nothing.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(store).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(f"{root}/out")
