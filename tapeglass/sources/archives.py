"""Sources that come as archives, pages or files with marks for missing values."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def zip_members(spark: SparkSession, path: str, suffix: str, encoding: str = "utf-8", most_bytes: int = 64 << 20) -> DataFrame:
    """archive, member, text: the members of all zip files under ``path`` that end in ``suffix``, unpacked in the tasks.

    A member above ``most_bytes`` raises rather than being cut.  Bytes that ``encoding`` doesn't have are replaced.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if m.filename.endswith(suffix):
                            if m.file_size > most_bytes:
                                raise ValueError(f"{name}: {m.filename} has {m.file_size} bytes")
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.filename]), pa.array([z.read(m).decode(encoding, "replace")])], names=["archive", "member", "text"])

    return files.mapInArrow(unpack, "archive string, member string, text string")


def write_zips(df: DataFrame, name: str, text: str, folder: str) -> int:
    """One zip per task with a member ``name`` for each row; the opposite of ``zip_members``.  Returns the number of zips."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            n = 0
            for b in batches:
                for member, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    z.writestr(member, body)
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()], pa.binary())], names=["content"])

    spark = df.sparkSession
    made = df.select(name, text).mapInArrow(pack, "content binary")
    made.write.mode("overwrite").parquet(f"{folder}.packed")
    k = 0
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in spark.read.parquet(f"{folder}.packed").toLocalIterator():  # an archive at a time
        out = fs.create(fs_path(f"{folder}/part-{k:05d}.zip"), True)
        out.write(bytearray(r.content))
        out.close()
        k += 1
    fs.delete(fs_path(f"{folder}.packed"), True)
    return k


def _at(folder: str, name: str):
    from pyarrow.fs import FileSystem

    uri = f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return FileSystem.from_uri(f"{uri}/{name}")


def write_files(df: DataFrame, name: Column, text: Column, folder: str) -> None:
    """A file per row, written in the tasks; a task that runs again writes the same files again."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = _at(folder, key)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(at) as f:
                    f.write(body.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    df.select(name.alias("n"), text.alias("t")).mapInArrow(put, "files bigint").agg(F.sum("files")).collect()  # one number


def read_file(folder: str, name: str) -> str:
    fs, at = _at(folder, name)
    with fs.open_input_stream(at) as f:
        return f.read().decode()


def tsv(members: DataFrame, member: str, columns: list[str]) -> DataFrame:
    """The rows of the members called ``member``, a file of tab-separated values with a header, as text columns."""
    lines = members.where(F.col("member").endswith(member)).select("archive", F.posexplode(F.split("text", "\r?\n")).alias("_n", "_line"))
    header = F.split(F.first("_line").over(_by_archive()), "\t")
    rows = lines.withColumn("_head", header).where((F.col("_n") > 0) & (F.col("_line") != "")).withColumn("_cells", F.split("_line", "\t"))
    at = lambda c: F.try_element_at("_cells", F.array_position("_head", c).cast("int"))
    return rows.select("archive", *[F.when(F.array_position("_head", c) > 0, at(c)).alias(c) for c in columns])


def _by_archive():
    from pyspark.sql import Window

    return Window.partitionBy("archive").orderBy("_n")  # a member's lines


def parallel_arrays(text: str, fields: list[str]):
    """Rows of a JSON object whose fields are arrays of one length."""
    schema = "struct<" + ", ".join(f"{f}: array<string>" for f in fields) + ">"
    return F.arrays_zip(*[F.from_json(F.col(text), schema)[f].alias(f) for f in fields])


def series_with_marks(spark: SparkSession, path: str, date: str, value: str, mark: str = ".") -> DataFrame:
    """day, value of a CSV series in which ``mark`` stands for no value; rows without a value are left out."""
    c = spark.read.csv(path, header=True)
    return c.where(F.col(value) != mark).select(F.to_date(date).alias("day"), F.col(value).try_cast("double").alias("value")).where(F.col("value").isNotNull() & F.col("day").isNotNull())


def pages(spark: SparkSession, starts: DataFrame, fetch: Callable[[str], str], most_pages: int = 1000, attempts: int = 4, parallel: int = 10) -> DataFrame:
    """start, page, body: the chains of pages that begin at the urls ``start``, each followed by its ``next_url``.

    A chain is followed in one task, ``parallel`` chains at a time.  A fetch that fails is tried again
    with growing pauses; after ``attempts`` the error is raised.  A chain longer than ``most_pages`` raises as well.
    ``fetch`` gives the body (JSON) of a url and has to be picklable.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import random
        import time

        for b in batches:
            for start in b.column(0).to_pylist():
                url, page = start, 0
                while url:
                    for k in range(attempts):
                        try:
                            body = fetch(url)
                            break
                        except OSError:
                            if k + 1 == attempts:
                                raise
                            time.sleep(0.05 * 2**k * (1 + random.random()))
                    if page == most_pages:
                        raise ValueError(f"{start}: more than {most_pages} pages")
                    yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([page], pa.int32()), pa.array([body])], names=["start", "page", "body"])
                    url, page = json.loads(body).get("next_url"), page + 1

    return starts.select("start").repartition(parallel).mapInArrow(follow, "start string, page int, body string")
