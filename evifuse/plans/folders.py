"""Registered queries over evidence folders: given tables written as delimited files, then ingested and digested.

The SQL says what each file and row must become; file names and row numbers follow from the keys.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.plans import casework as cw
from evifuse.plans.queries import query, r4
from evifuse.session import work_dir
from evifuse.sources import audit, statements

_folders: dict[tuple, str] = {}


def write_files(rows: DataFrame, folder: str, name: str, order: str, sep: str | None) -> None:
    """One file for each value of the column ``name``, rows by ``order``; delimited by ``sep``, or plain lines if None."""
    spark = rows.sparkSession
    staged = f"{folder}-{uuid.uuid4().hex}"
    dealt = rows.repartition(name).sortWithinPartitions(name, order).drop(order)
    writer = dealt.write.partitionBy(name)
    if sep is None:
        writer.text(staged)
    else:
        writer.option("header", True).option("sep", sep).csv(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for part in fs.globStatus(path(f"{staged}/{name}=*/part-*")):  # a rename per file
        title = part.getPath().getParent().getName().split("=", 1)[1]
        fs.rename(part.getPath(), path(f"{folder}/{title}"))


def statement_folder(spark: SparkSession, sf: str) -> str:
    """Orders as bank statements, events as call and session records, regions as notes: 27 files in one folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _folders:
        return _folders[key]
    folder = f"{work_dir(spark)}/case-{uuid.uuid4().hex}"
    bank = cw.statement_rows(spark, sf).withColumn("_k", F.col("raw_row_ref"))
    bank = bank.withColumn("_f", F.concat(F.regexp_replace("source_file", ".csv$", "_"), F.col("_k") % 4, F.lit(".csv")))
    write_files(bank.drop("raw_row_ref", "source_file"), folder, "_f", "_k", ",")
    e = cw.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    cdr = e.where("event_type in ('click', 'error')").select(
        F.concat(F.lit("P"), "user_id").alias("A_PARTY"), F.concat(F.lit("Q"), "k").alias("B_PARTY"),
        F.expr("if(event_type = 'error', 'sms', 'moc')").alias("CALL_TYPE"), F.date_format("ts", "dd-MM-yyyy").alias("DATE"),
        F.date_format("ts", "HH:mm:ss").alias("TIME"), F.col("k").alias("DURATION_SEC"),
        F.col("event_id").alias("_k"), F.concat(F.lit("cdr_"), F.col("user_id") % 3, F.lit(".csv")).alias("_f"),
    )
    write_files(cdr, folder, "_f", "_k", ";")
    ipdr = e.where("event_type = 'view'").select(
        F.expr("concat('103.', 21 + k % 8, '.1.', user_id % 250)").alias("PUBLIC_IP"), F.expr("concat('P', user_id)").alias("MSISDN"),
        F.expr("concat('10.0.0.', k)").alias("DEST_IP"), F.lit("10.1.1.1").alias("PRIVATE_IP"),
        F.expr("if(event_id % 10 = 0, 'unknown', date_format(ts, 'yyyy-MM-dd HH:mm:ss'))").alias("SESSION_START"),
        F.col("event_id").alias("_k"), F.concat(F.lit("ipdr_"), F.col("user_id") % 3, F.lit(".csv")).alias("_f"),
    )
    write_files(ipdr, folder, "_f", "_k", "\t")
    notes = cw.table(spark, sf, "region").select(F.col("r_name").alias("colour"), F.lit("round").alias("shape"), F.col("r_regionkey").alias("_k"), F.lit("notes.csv").alias("_f"))
    write_files(notes, folder, "_f", "_k", ",")
    _folders[key] = folder
    return folder


# Every row that the folder's statement files hold, before any is rejected. The names of the cities.
_BANK = (
    "SELECT replace(source_file, '.csv', '_' || (o_orderkey % 4) || '.csv') AS source_file, "
    "row_number() OVER (PARTITION BY source_file, o_orderkey % 4 ORDER BY o_orderkey) - 1 AS raw_row_ref, "
    "entity_ref, 'transaction' AS event_type, us, amount, counterparty, reject_reason FROM stmr"
)
_CDR = (
    "SELECT 'cdr_' || (u % 3) || '.csv', row_number() OVER (PARTITION BY u % 3 ORDER BY event_id) - 1, 'P' || u, "
    "CASE WHEN et = 'error' THEN 'sms' ELSE 'call' END, (us // 1000000) * 1000000, NULL, 'Q' || k, NULL FROM ev0 WHERE et IN ('click','error')"
)
_IPDR = (
    "SELECT 'ipdr_' || (u % 3) || '.csv', row_number() OVER (PARTITION BY u % 3 ORDER BY event_id) - 1, 'P' || u, 'ip_session', "
    "CASE WHEN event_id % 10 > 0 THEN (us // 1000000) * 1000000 END, NULL, '10.0.0.' || k, CASE WHEN event_id % 10 = 0 THEN 'unparseable_date' END FROM ev0 WHERE et = 'view'"
)
_ROWS = f"({_BANK} UNION ALL {_CDR} UNION ALL {_IPDR})"


@query(f"SELECT source_file, raw_row_ref, entity_ref, event_type, us, round(amount, 4) AS amount, counterparty FROM {_ROWS} WHERE reject_reason IS NULL")
def folder_events(spark, sf):
    """Three kinds of files, three separators, one event table with the place of every row."""
    got = statements.ingest_folder(spark, statement_folder(spark, sf)).events
    return got.select("source_file", "raw_row_ref", "entity_ref", "event_type", "us", r4("amount"), "counterparty")


@query(f"SELECT source_file, raw_row_ref, reject_reason FROM {_ROWS} WHERE reject_reason IS NOT NULL")
def folder_rejects(spark, sf):
    return statements.ingest_folder(spark, statement_folder(spark, sf)).rejects.select("source_file", "raw_row_ref", "reject_reason")


@query(
    "SELECT source_file AS filename, CASE WHEN starts_with(source_file, 'cdr') THEN 'cdr' WHEN starts_with(source_file, 'ipdr') THEN 'ipdr' ELSE 'bank' END AS detected_type, "
    "CASE WHEN starts_with(source_file, 'cdr') THEN 0.6 ELSE 0.8 END AS confidence, 'PARSED' AS status, count(*) AS total_rows, "
    "count(*) FILTER (reject_reason IS NULL) AS parsed_rows, count(reject_reason) AS skipped_rows, count(*) FILTER (reject_reason = 'unparseable_date') AS unparseable_date, "
    f"count(*) FILTER (reject_reason = 'missing_or_zero_amount') AS missing_or_zero_amount FROM {_ROWS} GROUP BY 1 "
    "UNION ALL SELECT 'notes.csv', 'unknown', 0.0, 'UNRECOGNISED', NULL, NULL, NULL, NULL, NULL"
)
def folder_manifest(spark, sf):
    """Type, status and row counts of every file; its digest is compared by ``folder_digests``."""
    folder = statement_folder(spark, sf)
    got = statements.ingest_manifest(statements.ingest_folder(spark, folder), audit.read_digests(spark, folder))
    return got.select(
        "filename", "detected_type", F.round("confidence", 4).alias("confidence"), "status", "total_rows", "parsed_rows", "skipped_rows",
        "unparseable_date", "missing_or_zero_amount",
    )


# ---------------------------------------------------------------------- digests of files


def _lines(spark: SparkSession, sf: str, changed: bool) -> str:
    """Orders as text files, sixteen of them; every fifth file has another last line if ``changed``."""
    folder = f"{work_dir(spark)}/lines-{uuid.uuid4().hex}"
    last = F.expr("if(f % 5 = 0, 'x', '')") if changed else F.lit("")
    rows = cw.table(spark, sf, "orders").withColumn("f", F.col("o_orderkey") % 16).select(
        F.concat_ws("|", "o_orderkey", "o_custkey", F.concat("o_orderpriority", last)).alias("value"),
        F.concat(F.lit("part_"), "f", F.lit(".txt")).alias("_f"), F.col("o_orderkey").alias("_k"),
    )
    write_files(rows, folder, "_f", "_k", None)
    return folder


def _sha(extra: str) -> str:
    return (
        "SELECT 'part_' || (o_orderkey % 16) || '.txt' AS filename, "
        f"string_agg(o_orderkey || '|' || o_custkey || '|' || o_orderpriority || {extra}, chr(10) ORDER BY o_orderkey) || chr(10) AS t FROM orders GROUP BY o_orderkey % 16"
    )


_CHANGED = _sha("CASE WHEN o_orderkey % 16 % 5 = 0 THEN 'x' ELSE '' END")


@query(f"SELECT filename, CAST(strlen(t) AS BIGINT) AS size_bytes, sha256(t) AS sha256 FROM ({_sha(chr(39) * 2)})")
def folder_digests(spark, sf):
    """Files of a folder, each streamed through SHA-256 by a task."""
    return audit.read_digests(spark, _lines(spark, sf, False))


@query(
    f"SELECT a.filename, sha256(b.t) AS sha256, sha256(a.t) AS sha256_at_ingest, a.t <> b.t AS modified_since_ingest FROM ({_sha(chr(39) * 2)}) a JOIN ({_CHANGED}) b ON a.filename = b.filename"
)
def folder_tamper_check(spark, sf):
    before = audit.read_digests(spark, _lines(spark, sf, False))
    return audit.tamper_check(before, audit.read_digests(spark, _lines(spark, sf, True)))
