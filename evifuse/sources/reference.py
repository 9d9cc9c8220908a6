"""Reference inputs: ownership maps, tower lists and labelled truth."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.functions.fields import present
from evifuse.functions.geo import TOWERS, event_place
from evifuse.operators.resolution import kyc_from_flat
from evifuse.sources.statements import header_line, list_files, header_fields, split_header  # noqa: F401

OWNED = "struct<name:string,phones:array<string>,accounts:array<string>,vpas:array<string>,imeis:array<string>,ips:array<string>>"
LISTS = (("phone", "phones"), ("account", "accounts"), ("vpa", "vpas"), ("imei", "imeis"), ("ip", "ips"))


def find_kyc_file(spark: SparkSession, folder: str) -> str | None:
    found = [p for p in list_files(spark, folder, ".json") if "kyc" in p.rsplit("/", 1)[-1].lower()]
    return found[0] if found else None


def read_kyc(spark: SparkSession, path: str) -> DataFrame:
    """Ownership map file, structured or flat, as long (entry, name, id_type, identifier) rows."""
    text = spark.read.text(path, wholetext=True)
    return kyc_rows(text.select("value"))


def kyc_rows(text: DataFrame) -> DataFrame:
    """Long rows of JSON texts {key: record} or {identifier: name} in column value."""
    as_text = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    record = F.from_json("v", OWNED)
    boxed = F.col("v").startswith("{")

    def tagged(one: str, many: str) -> Column:
        held = F.coalesce(record[many], F.array().cast("array<string>"))
        return F.transform(held, lambda x: F.struct(F.lit(one).alias("id_type"), x.alias("identifier")))

    lists = F.concat(*[tagged(one, many) for one, many in LISTS])
    structured = (
        as_text.where(boxed)
        .select(F.col("key").alias("entry"), record["name"].alias("name"), F.explode(lists).alias("x"))
        .select("entry", "name", "x.id_type", present(F.col("x.identifier")).alias("identifier"))
        .where("identifier is not null")
    )
    flat = kyc_from_flat(as_text.where(~boxed).select(F.col("key").alias("identifier"), F.col("v").alias("name")))
    return structured.unionByName(flat)


def builtin_towers(spark: SparkSession) -> DataFrame:
    rows = [(t[0].upper(), t[1], t[2], f"{t[3]}, {t[4]}", t[4]) for t in TOWERS]
    return spark.createDataFrame(rows, "key string, lat double, lon double, label string, city string")


def tower_master(spark: SparkSession, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Tower places by upper-cased tower or cell id; rows of the file override the built-in ones. A list in several
    files with the header of ``path`` is read from ``folder``."""
    base = builtin_towers(spark).withColumn("_rank", F.lit(1))
    if path is None:
        return base.drop("_rank")
    sep, columns = split_header(header_line(spark, path))
    by = {c.lower().strip(): c for c in columns}

    def col(*names: str) -> Column:
        hit = next((by[n] for n in names if n in by), None)
        return F.lit(None).cast("string") if hit is None else present(F.col(f"`{hit}`"))

    raw = spark.read.option("header", True).option("sep", sep).csv(folder or path)
    place = raw.select(
        col("latitude", "lat").try_cast("double").alias("lat"),
        col("longitude", "lon", "long").try_cast("double").alias("lon"),
        F.coalesce(col("address", "area", "city"), F.lit("")).alias("label"),
        F.explode(
            F.array(
                F.upper(col("tower id", "tower_id", "tower")),
                F.upper(F.regexp_replace(col("cell id", "cell_id", "cell"), r"\.0$", "")),
            )
        ).alias("key"),
    ).where("key is not null and lat is not null and lon is not null")
    own = place.withColumn("city", F.lit(None).cast("string")).withColumn("_rank", F.lit(0))
    cols = ["lat", "lon", "label", "city"]
    return (
        own.select("key", *cols, "_rank")
        .unionByName(base)
        .groupBy("key")
        .agg(F.min_by(F.struct(*cols), "_rank").alias("r"))
        .select("key", "r.*")
    )


def place_events(events: DataFrame, towers: DataFrame | None = None, whole_octets: bool = True) -> DataFrame:
    """Events with ``place`` struct<lat, lon, label>; a given tower list is asked first.

    The tower list may be any size, so Spark chooses how to join it.
    """
    fixed = event_place(F.col("location"), F.col("_public_ip"), whole_octets)
    if towers is None:
        return events.withColumn("place", fixed)
    t = towers.select(
        F.col("key").alias("_key"),
        F.struct("lat", "lon", F.when(F.col("label") != "", F.col("label")).alias("label")).alias("_t"),
    )
    # Rows without a key get one that fits no tower, so that they spread over the join's tasks.
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("us", "raw_row_ref"), F.lit(4096)).cast("string"))
    whole = F.coalesce(F.upper("location"), spread)
    short = F.coalesce(F.when(F.col("location").contains("."), F.split("location", r"\.")[0]), spread)
    t2 = t.withColumnRenamed("_t", "_t2")
    by_id = events.withColumn("_key", whole).join(t, "_key", "left").drop("_key")
    both = by_id.withColumn("_key", short).join(t2, "_key", "left").drop("_key")
    own = F.coalesce("_t", "_t2")
    named = F.when(
        own.isNotNull(),
        F.struct(own["lat"].alias("lat"), own["lon"].alias("lon"), F.coalesce(own["label"], F.col("location")).alias("label")),
    )
    return both.withColumn("place", F.coalesce(named, fixed)).drop("_t", "_t2")


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(truth, truth_ids, expected_rows) of a labelled-truth document."""
    schema = (
        "normal_entities bigint, total_entities bigint, guilty_entity_ids array<string>, "
        "entities array<struct<entity_id:string,typology:string,name:string,raw_identifiers:"
        "struct<phones:array<string>,accounts:array<string>,imeis:array<string>,vpas:array<string>,ips:array<string>>,"
        "expected_flagged_rows:array<string>>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    e = doc.select("normal_entities", F.posexplode("entities").alias("seq", "e"))
    truth = e.select(F.col("e.entity_id").alias("truth_id"), F.col("seq").cast("bigint").alias("seq"), "e.typology", "e.name", "normal_entities")
    r = "e.raw_identifiers"
    none = F.array().cast("array<string>")
    ids = e.select(
        F.col("e.entity_id").alias("truth_id"),
        F.explode(F.concat(*[F.coalesce(F.col(f"{r}.{c}"), none) for c in ("phones", "accounts", "imeis", "vpas")])).alias("identifier"),
    )
    rows = e.select(F.col("e.entity_id").alias("truth_id"), F.explode("e.expected_flagged_rows").alias("token"))
    return truth, ids, rows
