"""Files read as byte streams by tasks: digests of whole files and header lines.

No file is ever one cell, so its size does not matter, and the driver opens none.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
HEAD_BYTES = 1 << 20
# Tasks that read the files of a folder, at most.
MAX_TASKS = 10_000
# Stores that Python workers can stream from, by the scheme of a path.
STREAMED = ("file", "hdfs", "s3", "s3a", "gs", "gcs")


def split_header(line: str) -> tuple[str, list[str]]:
    """(separator, columns) of a header line; the separator that splits it most."""
    sep = max((",", ";", "\t"), key=line.count)
    return sep, [c.strip().strip('"') for c in line.split(sep)]


def open_stream(path: str):
    """Binary stream of a file, at its start."""
    scheme, found, rest = path.partition(":")
    if not found or scheme == "file":
        return open("/" + (rest if found else path).lstrip("/"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
    return store.open_input_stream(inner)


def digest(path: str, chunk: int = CHUNK_BYTES) -> str:
    """SHA-256 of a file, a chunk at a time."""
    state = hashlib.sha256()
    with open_stream(path) as stream:
        while block := stream.read(chunk):
            state.update(block)
    return state.hexdigest()


def first_line(path: str) -> str:
    """First line of a text file, of the first ``HEAD_BYTES`` at most, without a byte order mark."""
    with open_stream(path) as stream:
        head = stream.read(HEAD_BYTES)
    return head.split(b"\n", 1)[0].decode("utf-8", "replace").lstrip("﻿").rstrip("\r")


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, size_bytes) of the files in a folder, empty ones too, on any store that Spark reads.

    The driver lists the folder, as it does for any scan; it opens nothing.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    rows = [(s.getPath().toString(), s.getPath().getName(), s.getLen()) for s in found if s.isFile()]
    return spark.createDataFrame(rows, "path string, filename string, size_bytes bigint")


def streams(spark: SparkSession, folder: str) -> bool:
    """Whether tasks can open the folder's files themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() in STREAMED


def by_file(files: DataFrame, columns: str, read: Callable[[str], tuple]) -> DataFrame:
    """``files`` with what ``read`` gives for each path; ``columns`` are its names and types. Files are dealt over tasks."""
    tasks = max(1, min(files.count(), MAX_TASKS))
    names = [f.split()[0] for f in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, path in enumerate(b.column(0).to_pylist()):
                found = [pa.array([v]) for v in read(path)]
                yield pa.RecordBatch.from_arrays([*b.slice(n, 1).columns, *found], names=[*b.schema.names, *names])

    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.repartition(tasks, "path").mapInArrow(run, f"{given}, {columns}")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, size_bytes, sha256) of the files in a folder.

    In a store that only Spark itself can read a file is digested as one cell, and must be below 2 GB there.
    """
    if streams(spark, folder):
        return by_file(list_folder(spark, folder), "sha256 string", lambda path: (digest(path),))
    files = spark.read.format("binaryFile").load(folder).withColumn("sha256", F.sha2("content", 256))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), "sha256")


def file_headers(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, filename, size_bytes, sep, columns) of the delimited files in a folder."""
    files = list_folder(spark, folder).where(F.lower("filename").endswith(suffix))
    if streams(spark, folder):
        return by_file(files, "sep string, columns array<string>", lambda path: split_header(first_line(path)))
    # One pass over the texts: a line knows the file and block that it is read from.
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_block_start").alias("_b"))
    first = lines.where("_b = 0").withColumn("_id", F.monotonically_increasing_id()).groupBy("filename").agg(F.min_by("value", "_id").alias("_h"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [split_header((h or "").lstrip("﻿")) for h in b.column(3).to_pylist()]
            found = [pa.array([s for s, _ in heads]), pa.array([c for _, c in heads], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *found], names=[*b.schema.names[:3], "sep", "columns"])

    return files.join(first, "filename", "left").select("path", "filename", "size_bytes", "_h").mapInArrow(
        split, "path string, filename string, size_bytes bigint, sep string, columns array<string>"
    )
