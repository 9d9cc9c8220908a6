"""Provenance tables: file manifest, tamper check, artifact registry, decision trace."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.sources.files import file_digests

# Kinds of artifact the registry accepts.
ARTIFACT_KINDS = ("forensic_report", "str_report", "evidence")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, size_bytes, sha256) of the files in a folder, streamed by tasks."""
    return file_digests(spark, folder).select("filename", "size_bytes", "sha256").where("filename <> 'ground_truth.json'")


def file_manifest(digests: DataFrame, stats: DataFrame) -> DataFrame:
    """Digest and parse record of every file; ``stats`` (filename, status, total_rows, ...)."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return digests.join(stats, "filename", "left").withColumn("extension", ext).withColumn(
        "status", F.coalesce("status", F.when(ext == "json", "REFERENCE").otherwise("NOT INGESTED"))
    )


def tamper_check(at_ingest: DataFrame, now: DataFrame) -> DataFrame:
    """Each current file with its digest at ingest and whether it changed since."""
    before = at_ingest.select("filename", F.col("sha256").alias("sha256_at_ingest"))
    return now.join(before, "filename", "left").select(
        "filename", "sha256", "sha256_at_ingest",
        F.coalesce(F.col("sha256") != F.col("sha256_at_ingest"), F.lit(False)).alias("modified_since_ingest"),
    )


def upsert_artifacts(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry with one row per storage_path, the latest; unknown kinds are not accepted.

    Latest-wins is an aggregation, so re-writing one path very often stays cheap.
    """
    good = incoming.where(F.col("kind").isin(*ARTIFACT_KINDS) & F.col("storage_path").isNotNull())
    rows = registry.unionByName(good)
    rest = [c for c in rows.columns if c != "storage_path"]
    order = F.struct("created_at", "sha256")
    return (
        rows.groupBy("storage_path")
        .agg(F.max_by(F.struct(*rest), order).alias("r"))
        .select("storage_path", "r.*")
    )


def artifacts_by(registry: DataFrame, case_id: str | None = None, entity_id: str | None = None, sha256: str | None = None) -> DataFrame:
    d = registry
    for name, value in (("case_id", case_id), ("entity_id", entity_id), ("sha256", sha256)):
        if value is not None:
            d = d.where(F.col(name) == value)
    return d.orderBy(F.desc("created_at"), "storage_path")


def write_trace(firings: DataFrame, evidence: DataFrame, path: str) -> None:
    """Decision trace of a run: JSON lines under ``firings`` and ``evidence``, a folder per rule."""
    stamped = firings.withColumn("timestamp", F.current_timestamp())
    stamped.write.mode("overwrite").partitionBy("rule_id").json(f"{path}/firings")
    evidence.write.mode("overwrite").partitionBy("rule_id").json(f"{path}/evidence")


TRACE_SCHEMA = "entity_id string, severity string, explanation string, timestamp timestamp, rule_id string"


def read_trace(spark: SparkSession, path: str, entity_id: str | None = None) -> DataFrame:
    d = spark.read.schema(TRACE_SCHEMA).json(f"{path}/firings")
    return d if entity_id is None else d.where(F.col("entity_id") == entity_id)


EVIDENCE_SCHEMA = "entity_id string, ord_us bigint, ord_ref bigint, pos int, token string, rule_id string"


def read_evidence(spark: SparkSession, path: str, entity_id: str | None = None) -> DataFrame:
    """Evidence rows of a written trace, row references included."""
    d = spark.read.schema(EVIDENCE_SCHEMA).json(f"{path}/evidence")
    return d if entity_id is None else d.where(F.col("entity_id") == entity_id)
