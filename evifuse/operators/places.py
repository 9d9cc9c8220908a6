"""Activity by tower and city."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.functions.geo import map_city, map_tower
from evifuse.operators.scoring import TIERS
from evifuse.operators.temporal import CALL_TYPES


def _with_tier(events: DataFrame, scored: DataFrame) -> DataFrame:
    return events.join(scored.select("entity_id", "risk_tier"), "entity_id", "left").withColumn(
        "risk_tier", F.coalesce("risk_tier", F.lit("LOW"))
    )


def _activity(per: DataFrame, key: str) -> DataFrame:
    """Counts and the worst tier per place.

    Rows are first reduced to one per (place, entity): an entity has one tier, so the
    distinct count of entities is then a plain count.
    """
    t = F.col("risk_tier")
    worst = F.min(F.when(t == TIERS[0], 0).when(t == TIERS[1], 1).when(t == TIERS[2], 2).otherwise(3))
    names = F.array(*[F.lit(x) for x in TIERS])
    return per.groupBy(key).agg(
        F.sum("n").alias("events"),
        F.count(F.lit(1)).alias("entities"),
        *[F.coalesce(F.sum(F.when(t == x, F.col("n"))), F.lit(0)).cast("bigint").alias(x.lower()) for x in TIERS],
        F.element_at(names, worst + 1).alias("highest_tier"),
    )


def tower_activity(events: DataFrame, scored: DataFrame) -> DataFrame:
    at = events.where("location is not null").select("entity_id", map_tower(F.col("location")).alias("tower"))
    per = at.where("tower is not null").groupBy("tower", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return _activity(_with_tier(per, scored), "tower")


def city_activity(events: DataFrame, scored: DataFrame) -> DataFrame:
    at = events.where("location is not null").select("entity_id", map_city(F.col("location")).alias("city"))
    per = at.where("city is not null").groupBy("city", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return _activity(_with_tier(per, scored), "city").select("city", "events", "entities", "highest_tier")


def call_paths(events: DataFrame, phones: DataFrame) -> DataFrame:
    """Distinct tower pairs: where a call was made, and the called entity's first known place.

    Callers are reduced to (tower, called number) before the number is looked up.
    """
    first = (
        events.where("location is not null")
        .groupBy("entity_id")
        .agg(F.min_by("location", "raw_row_ref").alias("_loc"))
        .select("entity_id", map_tower(F.col("_loc")).alias("to_tower"))
        .where("to_tower is not null")
    )
    made = (
        events.where(F.col("event_type").isin(*CALL_TYPES) & F.col("location").isNotNull() & F.col("counterparty").isNotNull())
        .select(map_tower(F.col("location")).alias("from_tower"), F.col("counterparty").alias("identifier"))
        .where("from_tower is not null")
        .distinct()
    )
    return (
        made.join(phones.select("identifier", "entity_id"), "identifier")
        .select("from_tower", "entity_id")
        .distinct()
        .join(first, "entity_id")
        .where("from_tower <> to_tower")
        .select("from_tower", "to_tower")
        .distinct()
    )
