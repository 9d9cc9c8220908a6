"""Scorecard of detections against labelled truth."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.operators.keyed import latest, top_per_key
from evifuse.session import cut

# Readable name of each planted pattern.
TYPOLOGIES = (
    ("STR-1", "Structuring / Smurfing"),
    ("LAY-1", "Layering / Circular Flow"),
    ("MUL-1", "Mule Account Signature"),
    ("IDR-1", "Identity Fan-out / SIM Swap"),
    ("LOC-1", "Geo-Improbable Location"),
)
# Entries and their sharing pairs that choose in one task.
SLICE_ROWS = 50_000


def overlap_pairs(truth_ids: DataFrame, members: DataFrame) -> DataFrame:
    """(truth_id, entity_id, overlap): identifiers shared by a truth entry and an entity."""
    kinds = ("phone", "account", "imei", "vpa")
    have = members.where(F.col("id_type").isin(*kinds)).select("identifier", "entity_id").distinct()
    return (
        truth_ids.select("truth_id", "identifier")
        .distinct()
        .join(have, "identifier")
        .groupBy("truth_id", "entity_id")
        .agg(F.count(F.lit(1)).alias("overlap"))
    )


def match_truth(
    truth: DataFrame, truth_ids: DataFrame, members: DataFrame, scored: DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """(truth_id, entity_id): each truth entry with its detected entity, none used twice.

    Entries choose in order of ``truth.seq``: the entity with the largest overlap, or, when
    no sharing entity is left, the one with the expected rule and the most rules.
    What an entry may choose depends on all earlier ones, so ranges of entries, dealt by ``seq`` into slices of about
    ``slice_rows`` entries and sharing pairs, choose one after the other (``_choose``). A slice of n entries sees what earlier
    slices left: its own pairs and the best n of each rule, as an entry can lose at most one entity to each other entry.
    """
    t = truth.select("truth_id", "seq", F.col("typology").alias("rule_id"))
    shared = overlap_pairs(truth_ids, members).join(t, "truth_id").select(
        *t.columns, F.lit(0).alias("stage"), (-F.col("overlap")).cast("bigint").alias("pref"), "entity_id"
    )
    last = t.select("*", F.lit(1).alias("stage"), F.lit(None).cast("bigint").alias("pref"), F.lit(None).cast("string").alias("entity_id"))
    choices = cut(shared.unionByName(last), "pairs")
    slices = -(-choices.count() // slice_rows)
    if slices > 1:  # ranges of seq: all rows of an entry share a slice
        choices = cut(choices.repartitionByRange(slices, "seq").withColumn("_slice", F.spark_partition_id()), "pairs")
    else:
        choices = choices.withColumn("_slice", F.lit(0))
    sizes = dict(choices.where("stage = 1").groupBy("_slice").agg(F.count(F.lit(1))).collect())
    by_rule = scored.select("entity_id", (-F.col("n_rules")).alias("_n"), F.explode("rules_fired").alias("rule_id"))
    by_rule = by_rule.join(t.select("rule_id").distinct(), "rule_id", "left_semi")
    ranked = latest(by_rule, ["rule_id"], ["_n", "entity_id"], counts={"pref": F.lit(1)})
    ranked = cut(ranked.select("rule_id", "entity_id", "pref"), "ranked")
    picks = cut(choices.limit(0).select("truth_id", "entity_id"), "picks")
    settled = 0
    for n in sorted(sizes):
        gone = picks.select("entity_id")
        # Of a rule's first ``settled`` + size, earlier slices took at most ``settled``.
        free = ranked.where(F.col("pref") <= settled + sizes[n]).join(gone, "entity_id", "left_anti")
        free = top_per_key(free, ["rule_id"], [F.asc("pref")], sizes[n], "_k").drop("_k")
        mine = choices.where(F.col("_slice") == n).drop("_slice").join(gone, "entity_id", "left_anti")
        rows = mine.unionByName(free, allowMissingColumns=True).select("seq", "truth_id", "stage", "pref", "rule_id", "entity_id")
        rows = rows.repartition(1).sortWithinPartitions(F.asc_nulls_first("seq"), "truth_id", "stage", "pref", "entity_id")
        found = cut(rows.select("truth_id", "rule_id", "entity_id").mapInArrow(_choose, picks.schema), "proposals")
        picks = cut(picks.unionByName(found), "picks") if settled else found
        settled += sizes[n]
    return picks


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(truth_id, entity_id) of a slice whose rows come in order: first, without ``truth_id``, the free entities of each
    rule; then each entry's sharing entities, and last its row without ``entity_id``, where it turns to its rule."""
    free: dict[str, list[str]] = {}
    begun: dict[str, int] = {}
    taken: set[str] = set()
    settled = None
    for b in batches:
        picks: list[tuple[str, str]] = []
        for entry, rule, entity in zip(*(c.to_pylist() for c in b.columns)):
            if entry is None:
                free.setdefault(rule, []).append(entity)
                continue
            if entry == settled:
                continue
            if entity is None:
                options, at = free.get(rule, []), begun.get(rule, 0)
                while at < len(options) and options[at] in taken:
                    at += 1
                begun[rule] = at
                entity = options[at] if at < len(options) else None
            if entity is not None and entity not in taken:
                taken.add(entity)
                picks.append((entry, entity))
                settled = entry
        names = ["truth_id", "entity_id"]
        yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in picks], pa.string()) for c in range(2)], names=names)


def truth_status(truth: DataFrame, matches: DataFrame, scored: DataFrame) -> DataFrame:
    """DETECTED when the matched entity is HIGH or worse, else why it was missed."""
    s = scored.select("entity_id", "risk_tier", "n_rules", "rules_fired")
    d = truth.join(matches, "truth_id", "left").join(s, "entity_id", "left")
    found = F.coalesce(F.col("risk_tier").isin("HIGH", "CRITICAL"), F.lit(False))
    return d.select(
        "truth_id", "typology", F.col("entity_id").alias("detected_as"),
        F.when(F.col("entity_id").isNull(), "N/A").otherwise(F.coalesce("risk_tier", F.lit("LOW"))).alias("detected_tier"),
        F.when(found, "DETECTED")
        .when(F.coalesce("n_rules", F.lit(0)) > 0, "MISSED (below HIGH)")
        .otherwise("MISSED")
        .alias("status"),
    )


def false_positives(status: DataFrame, scored: DataFrame) -> DataFrame:
    """Flagged entities that no detected truth entry explains."""
    hit = status.where("status = 'DETECTED'").select(F.col("detected_as").alias("entity_id"))
    return scored.where(F.col("risk_tier").isin("HIGH", "CRITICAL")).join(hit, "entity_id", "left_anti")


def false_positive_notes(fps: DataFrame, chains: DataFrame) -> DataFrame:
    """Why each false positive was flagged; ``chains`` has path arrays."""
    on_chain = chains.select(F.explode("path").alias("entity_id")).distinct().withColumn("_c", F.lit(True))
    rules = F.when(F.size("rules_fired") > 0, F.array_join("rules_fired", ", ")).otherwise("no rules")
    return fps.join(on_chain, "entity_id", "left").select(
        "entity_id",
        F.when(F.col("_c").isNotNull(), "sits on a detected layering chain")
        .otherwise(F.concat(F.lit("flagged on "), rules, F.lit(" with no ground-truth match")))
        .alias("note"),
    )


def detection_scores(status: DataFrame, fps: DataFrame, clean_total: int) -> DataFrame:
    """Counts and ratios; specificity is over the planted clean cohort. One row."""
    marks = status.select(F.lit(1).alias("t"), (F.col("status") == "DETECTED").cast("int").alias("d"), F.lit(0).alias("f"))
    marks = marks.unionByName(fps.select(F.lit(0).alias("t"), F.lit(0).alias("d"), F.lit(1).alias("f")))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    s = marks.agg(n("t").alias("truth_entities"), n("d").alias("true_positives"), n("f").alias("false_positives"))
    tp, fp = F.col("true_positives"), F.col("false_positives")
    s = s.withColumn("false_negatives", F.col("truth_entities") - tp)
    s = s.withColumn("recall", tp / F.greatest(F.col("truth_entities"), F.lit(1)))
    s = s.withColumn("precision", tp / F.greatest(tp + fp, F.lit(1)))
    p, r = F.col("precision"), F.col("recall")
    s = s.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(0.0001)))
    clean = F.lit(clean_total).cast("bigint")
    return s.withColumn(
        "specificity", F.when(clean > 0, (clean - F.least(fp, clean)) / clean)
    )


def typology_scores(status: DataFrame) -> DataFrame:
    """Planted, detected, missed and recall per pattern."""
    label = F.col("typology")
    for rule, name in TYPOLOGIES:
        label = F.when(F.col("typology") == rule, name).otherwise(label)
    return (
        status.groupBy("typology")
        .agg(F.count(F.lit(1)).alias("planted"), F.count_if(F.col("status") == "DETECTED").alias("detected"))
        .select(
            "typology", label.alias("label"), "planted", "detected",
            (F.col("planted") - F.col("detected")).alias("missed"), (F.col("detected") / F.col("planted")).alias("recall"),
        )
        .orderBy("typology")
    )
