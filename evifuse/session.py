"""Session settings and the one way this library cuts lineage."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "evifuse", master: str | None = None, partitions: int | None = None, **conf
) -> SparkSession:
    """Session with the settings the operators count on.

    ``partitions`` is the number of shuffle partitions to start with. Adaptive execution
    merges small ones but cannot divide even ones, so a large run should start with
    about its largest shuffle divided by 128 MB.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a machine-local folder: on a cluster that would lose the table with
    its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    base = tempfile.mkdtemp(prefix="evifuse-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def work_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/evifuse/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Loops use this instead of growing one plan. The table survives lost
    executors, and its size is known to the optimizer afterwards. ``by`` names a
    low-cardinality column to partition on, so that filters on it skip files.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def drop_cuts(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_once(*jobs: Callable):
    """Results of several independent jobs, submitted side by side so that one's tail does
    not leave the executors idle."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def cut_all(*frames: DataFrame) -> list[DataFrame]:
    """``cut`` for several frames at once."""
    return at_once(*[lambda d=d: cut(d) for d in frames])
