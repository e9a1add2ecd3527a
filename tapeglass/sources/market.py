"""Scans and sinks of the panel: vendor CSV, stamped tables, day partitions, resume, audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeglass.functions.timeline import MINUTE, floor_div, local_date

CSV = T.StructType([T.StructField(n, t) for n, t in (("ticker", T.StringType()), ("volume", T.DoubleType()), ("open", T.DoubleType()), ("close", T.DoubleType()), ("high", T.DoubleType()), ("low", T.DoubleType()), ("window_start", T.LongType()), ("transactions", T.LongType()))])


def read_minute_csv(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars of (gz) CSV files with a header, by the declared schema; ``window_start`` is epoch nanoseconds."""
    c = spark.read.schema(CSV).csv(path, header=True)
    return c.select(F.col("ticker").alias("display_symbol"), F.timestamp_micros(F.floor(F.col("window_start") / 1000).cast("bigint")).alias("t"), "open", "high", "low", "close", "volume", "transactions")


def convert(bars: DataFrame, ids: DataFrame | None, path: str) -> None:
    """CSV bars to day partitions sorted by symbol and time, with ``security_id`` looked up (null if unknown).

    ``ids``: display_symbol, security_id, one row per symbol.  Writing the same days again replaces them.
    """
    b = bars if ids is None else bars.join(ids, "display_symbol", "left")
    b = b.withColumn("day", local_date(F.col("t")))
    b = b.repartition("day", F.pmod(F.xxhash64("display_symbol"), F.lit(8))).sortWithinPartitions("day", "display_symbol", "t")
    write_days(b, path)


def write_days(df: DataFrame, path: str, stamps: dict[str, str] | None = None) -> None:
    """``df`` by its ``day`` column; the days it has replace those there, others stay.  ``stamps`` go beside the table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)
    if stamps is not None:
        write_stamps(df.sparkSession, path, stamps)


def write_stamps(spark: SparkSession, path: str, stamps: dict[str, str]) -> None:
    spark.createDataFrame(sorted(stamps.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}.stamps")


def read_stamped(spark: SparkSession, path: str, need: dict[str, str | None]) -> DataFrame:
    """The table, after its stamps were checked: each key of ``need`` must be there, with the value given unless that is None."""
    have = {r.key: r.value for r in spark.read.parquet(f"{path}.stamps").where(F.col("key").isin(list(need))).collect()}  # those asked for
    for k, v in need.items():
        if k not in have or v is not None and have[k] != v:
            raise ValueError(f"{path}: stamp {k} is {have.get(k)!r}, not {v!r}")
    return spark.read.parquet(path)


def trading_days(bars: DataFrame) -> DataFrame:
    """day, day_idx: the calendar that the bars themselves make (a row per day)."""
    from pyspark.sql import Window

    return bars.select("day").distinct().withColumn("day_idx", (F.row_number().over(Window.orderBy("day")) - 1).cast("bigint"))


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A table of day partitions, or the days from ``first`` to ``last`` of it: other days' folders aren't opened."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("day") >= F.lit(first).cast("date"))
    return df if last is None else df.where(F.col("day") <= F.lit(last).cast("date"))


class MissingBars(LookupError):
    """There are no bars of what was asked for."""


def session_bars(spark: SparkSession, path: str, security_id: str, day: str) -> DataFrame:
    """Bars of one security on one day, from that day's partition alone; raises ``MissingBars`` if there are none."""
    df = read_days(spark, path, day, day).where(F.col("security_id") == security_id).orderBy("t")
    if df.isEmpty():
        raise MissingBars(f"{security_id} on {day}")
    return df


def write_table(df: DataFrame, path: str, schema: T.StructType, stamps: dict[str, str] | None = None) -> None:
    """``df`` by the declared columns and types and in their order, with its stamps beside it; a missing column is an error, further ones are left out."""
    lost = [f.name for f in schema.fields if f.name not in df.columns]
    if lost:
        raise ValueError(f"{path}: no column {', '.join(lost)}")
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite").option("compression", "zstd").parquet(path)
    if stamps is not None:
        write_stamps(df.sparkSession, path, stamps)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """file, bytes: the files under a folder that end in ``suffix``, on any file system Hadoop knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    it, rows = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString()
        if name.endswith(suffix):
            rows.append((name, f.getLen()))
    return spark.createDataFrame(rows, "file string, bytes bigint")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, row_groups, columns of each parquet file under ``path``, from the footers alone, read in the tasks."""
    import pyarrow as pa

    def read(batches):
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                fs, at = FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
                with fs.open_input_file(at) as f:
                    m = pq.ParquetFile(f)
                    out.append((name, m.metadata.num_rows, m.metadata.num_row_groups, ",".join(f"{x.name}:{x.type}" for x in m.schema_arrow)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "rows", "row_groups", "columns"])

    files = list_files(spark, path, ".parquet").select("file")
    return files.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(read, "file string, rows bigint, row_groups int, columns string")


def convert_all(spark: SparkSession, staging: str, ids: DataFrame | None, path: str, cursor: "DayCursor") -> int:
    """Convert every gz CSV under ``staging`` that isn't finished yet, as one job; returns how many files.  Files count by their names, one for each day."""
    files = list_files(spark, staging, ".csv.gz").where(F.col("bytes") > 0)
    named = files.withColumn("day", F.to_date(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})\.csv\.gz$", 1)))
    todo = cursor.remaining(named.where(F.col("day").isNotNull()), "bars").collect()  # a row per file to do
    if todo:
        csv = spark.read.schema(CSV).csv([r.file for r in todo], header=True)
        bars = csv.select(F.col("ticker").alias("display_symbol"), F.timestamp_micros(F.floor(F.col("window_start") / 1000).cast("bigint")).alias("t"), "open", "high", "low", "close", "volume", "transactions")
        convert(bars, ids, path)
        cursor.mark("bars", sorted({r.day for r in todo}))
    return len(todo)


class DayCursor:
    """Which (table, day) pairs are finished: an appended parquet log, marked only after the day's files are closed.

    The latest mark of a pair counts; of two at one instant the finished one.
    """

    SCHEMA = "table_name string, day date, done boolean, at timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _log(self) -> DataFrame:
        if not exists(self.spark, self.folder):  # any other fault is raised
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def finished(self) -> DataFrame:
        return self._log().groupBy("table_name", "day").agg(F.max(F.struct("at", "done")).alias("r")).where("r.done").select("table_name", "day")

    def remaining(self, days: DataFrame, table_name: str) -> DataFrame:
        return days.join(self.finished().where(F.col("table_name") == table_name).select("day"), "day", "left_anti")

    def is_done(self, table_name: str, day: dt.date) -> bool:
        return not self.finished().where((F.col("table_name") == table_name) & (F.col("day") == F.lit(day))).isEmpty()

    def mark(self, table_name: str, days: list[dt.date], done: bool = True) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        self.spark.createDataFrame([(table_name, x, done, now) for x in days], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def clear(self, table_name: str, days: list[dt.date]) -> None:
        self.mark(table_name, days, done=False)


def audit(df: DataFrame) -> DataFrame:
    """Per symbol and New York day: rows, volume, first and last bar, bars out of a minute's start, rows for a minute already there."""
    m = floor_div(F.unix_micros("t"), MINUTE)
    return df.groupBy("display_symbol", local_date(F.col("t")).alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if(F.unix_micros("t") % MINUTE != 0).alias("inside_minute"), (F.count(F.lit(1)) - F.countDistinct(m)).alias("repeats"))
