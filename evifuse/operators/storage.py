"""Result tables laid out for access by entity, documents written as sorted lines, and the artifact registry on disk."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.session import cut
from evifuse.sources.audit import upsert_artifacts

BUCKETS = 64


def entity_bucket(entity: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def write_by_entity(rows: DataFrame, path: str, order: list[str], buckets: int = BUCKETS) -> None:
    """``rows`` as a table in which an entity's rows lie in one bucket, together and by ``order``.

    Rows are dealt by range of bucket, entity and order, so an entity with very many rows fills several files.
    """
    keys = ["entity_bucket", "entity_id", *order]
    dealt = rows.withColumn("entity_bucket", entity_bucket(F.col("entity_id"), buckets))
    dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("entity_bucket").parquet(path)


def read_by_entity(spark: SparkSession, path: str, entity_id: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A table of ``write_by_entity``, whole or of one entity: then one bucket's files are read. Files hold an entity's rows in order."""
    d = spark.read.parquet(path)
    if entity_id is not None:
        d = d.where((F.col("entity_bucket") == entity_bucket(F.lit(entity_id), buckets)) & (F.col("entity_id") == entity_id))
    return d.drop("entity_bucket")


SECTIONS = ("entity", "finding", "evidence", "counterparty", "event")


def bundle_lines(scored: DataFrame, entities: DataFrame, firings: DataFrame, evidence: DataFrame, parties: DataFrame, events: DataFrame) -> DataFrame:
    """Bundles of the HIGH and CRITICAL entities as lines: (risk_tier, entity_id, section, a, b, c, line).

    A document is an entity's lines in the order of section, a, b and c: its header, findings, evidence, counterparties and
    events, all of them, each a JSON object. No list is ever gathered, so a document may have any number of lines.
    """
    who = scored.where(F.col("risk_tier").isin("HIGH", "CRITICAL")).select("entity_id", "risk_tier")

    def section(n: int, rows: DataFrame, a: Column, b: Column, c: Column) -> DataFrame:
        body = F.to_json(F.struct(F.lit(SECTIONS[n]).alias("section"), *[x for x in rows.columns if x != "_x"]))
        lines = rows.select("entity_id", F.lit(n).alias("section"), a.cast("string").alias("a"), b.cast("bigint").alias("b"), c.cast("string").alias("c"), body.alias("line"))
        return lines.join(who, "entity_id").select("risk_tier", "entity_id", "section", "a", "b", "c", "line")

    none = F.lit(None)
    head = entities.drop("risk_tier").join(scored.select("entity_id", "risk_tier", "n_rules", "rules_fired"), "entity_id")
    parts = [
        section(0, head, none, none, none),
        section(1, firings, F.col("rule_id"), none, none),
        section(2, evidence, F.col("rule_id"), F.col("ord_us"), F.concat_ws(" ", F.lpad(F.coalesce("ord_ref", F.lit(0)).cast("string"), 19, "0"), "pos", "token")),
        section(3, parties, none, F.col("rank"), none),
        section(4, events, none, F.col("us"), F.lpad(F.col("raw_row_ref").cast("string"), 19, "0")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_bundle_lines(lines: DataFrame, path: str) -> None:
    """JSON lines, a folder per tier; documents follow each other in order, and a long one goes on in the next file."""
    keys = ["risk_tier", "entity_id", "section", "a", "b", "c"]
    lines = cut(lines, "lines")  # ranges are sampled first, which would make every line twice
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("risk_tier", "line").write.mode("overwrite").partitionBy("risk_tier").text(path)


REGISTRY_SCHEMA = "storage_path string, case_id string, kind string, entity_id string, sha256 string, created_at bigint, part int"


def upsert_registry(incoming: DataFrame, path: str, parts: int = BUCKETS) -> None:
    """Put ``incoming`` artifacts into the registry at ``path``, the latest of a storage path wins.

    Paths are dealt to ``parts`` folders by hash; only folders that ``incoming`` touches are read and written again.
    """
    spark = incoming.sparkSession
    names = [f.split()[0] for f in REGISTRY_SCHEMA.split(", ")]
    rows = cut(incoming.withColumn("part", F.pmod(F.xxhash64("storage_path"), F.lit(parts)).cast("int")).select(*names), "incoming")
    # At most ``parts`` numbers.
    touched = rows.where("storage_path is not null").agg(F.collect_set("part")).first()[0]
    if not touched:
        return
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = rows.limit(0)
    if home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
        known = spark.read.schema(REGISTRY_SCHEMA).parquet(path).where(F.col("part").isin(*touched)).select(*names)
    merged = cut(upsert_artifacts(known, rows).select(*names), "registry")
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path).drop("part")
