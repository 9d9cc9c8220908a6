"""Reports as tables: suspect lists, evidence tables, filing schedules, dossiers, digests."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.functions.fields import institution
from evifuse.operators.graph import direct_counterparties, largest_transfers, money_flow_totals, value_in_out
from evifuse.operators.keyed import top_per_key
from evifuse.operators.scoring import TIERS, tier_rank

FLAGGED = ("CRITICAL", "HIGH", "MEDIUM")

# Filing category and grounds of each rule.
FILING_CATEGORIES = (
    ("STR-1", "Structuring / Smurfing",
     "Multiple transactions structured just below the statutory cash/transfer reporting threshold, "
     "apparently to evade reporting requirements."),
    ("MUL-1", "Mule Account / Layering of Proceeds",
     "Dormant account activated by a sudden large credit followed by rapid, near-total outflow, "
     "consistent with use as a money-mule conduit."),
    ("LAY-1", "Layering & Circular Fund Movement",
     "Funds passed through a rapid chain of intermediary accounts with decreasing amounts "
     "(commission-skim pattern), consistent with layering to obscure the audit trail."),
    ("IDR-1", "Identity Fraud / SIM Swap",
     "Concurrent or closely-timed change of device (IMEI) and/or SIM (IMSI) identifiers on the subject's "
     "mobile number, indicative of identity takeover facilitating unauthorized transactions."),
    ("TCS-1", "Suspicious Transaction Timing",
     "Transaction executed while the subject held simultaneous active phone call and internet session "
     "presence, indicating coordinated real-time facilitation of the transaction."),
    ("TCS-2", "Suspicious Transaction Timing",
     "A phone call to a co-suspect immediately preceded a fund transfer, suggesting coordination of the "
     "transaction by voice communication."),
    ("LOC-1", "Geographically Improbable Activity",
     "Subject's registered KYC location is inconsistent with the cell tower / IP-derived location active at "
     "the time of the transaction, at a rate implying physically impossible travel."),
)
OTHER_CATEGORY = (
    "Other Suspicious Activity",
    "Activity flagged by the deterministic rule engine warranting manual review by the reporting officer.",
)


def suspect_list(scored: DataFrame) -> DataFrame:
    """Entities by tier, then id."""
    return scored.orderBy(tier_rank(F.col("risk_tier")), "entity_id")


def ranked_flagged(scored: DataFrame, k: int = 40) -> DataFrame:
    """The k flagged entities to describe first."""
    flagged = scored.where(F.col("risk_tier").isin(*FLAGGED))
    return flagged.orderBy(tier_rank(F.col("risk_tier")), F.desc("n_rules"), "entity_id").limit(k)


def omitted_flagged(scored: DataFrame, k: int = 40) -> DataFrame:
    """How many flagged entities the list of k leaves out."""
    return scored.agg(
        F.greatest(F.count_if(F.col("risk_tier").isin(*FLAGGED)) - k, F.lit(0)).cast("bigint").alias("omitted")
    )


def only_anomalous(scored: DataFrame) -> DataFrame:
    """All entities with the anomaly flag and no rule, by id."""
    return scored.where("ml_anomaly and n_rules = 0").select("entity_id").orderBy("entity_id")


def evidence_table(events: DataFrame, flagged: DataFrame, k: int = 50) -> DataFrame:
    """The first k events of each entity in ``flagged`` (entity_id), as shown in a report."""
    mine = events.join(flagged.select("entity_id").distinct(), "entity_id", "left_semi").where("us is not null")
    top = top_per_key(mine, ["entity_id"], [F.asc("us"), F.asc("raw_row_ref")], k, "line")
    return top.select(
        "entity_id", "line", "us", "event_type",
        F.round("amount", 0).alias("amount"),
        F.substring("counterparty", 1, 30).alias("counterparty"), "source_file", "raw_row_ref",
    )


def filing_schedule(events: DataFrame, flagged: DataFrame, k: int = 100) -> DataFrame:
    """The first k transactions of each flagged entity with serial number and direction."""
    mine = events.where("event_type = 'transaction' and us is not null").join(
        flagged.select("entity_id").distinct(), "entity_id", "left_semi"
    )
    top = top_per_key(mine, ["entity_id"], [F.asc("us"), F.asc("raw_row_ref")], k, "serial")
    return top.select(
        "entity_id", "serial", "us",
        F.when(F.col("amount") > 0, "Credit (IN)").otherwise("Debit (OUT)").alias("direction"),
        F.abs("amount").alias("amount"), F.substring("counterparty", 1, 30).alias("counterparty"),
        "source_file", "raw_row_ref",
    )


def filing_totals(events: DataFrame, flagged: DataFrame) -> DataFrame:
    """Total value and number of transactions per flagged entity."""
    return (
        events.where("event_type = 'transaction'")
        .groupBy("entity_id")
        .agg(
            (F.sum(F.round(F.abs("amount") * 10_000).cast("bigint")) / 10_000).alias("total_value"),
            F.count(F.lit(1)).alias("transactions"),
        )
        .join(flagged.select("entity_id").distinct(), "entity_id", "left_semi")
    )


def filing_categories(firings: DataFrame) -> DataFrame:
    """Category and grounds of every firing, from the fixed table."""
    category, grounds = F.lit(OTHER_CATEGORY[0]), F.lit(OTHER_CATEGORY[1])
    for rule, c, g in FILING_CATEGORIES:
        hit = F.col("rule_id") == rule
        category, grounds = F.when(hit, c).otherwise(category), F.when(hit, g).otherwise(grounds)
    return firings.select("entity_id", "rule_id", category.alias("category"), grounds.alias("grounds"))


def first_tokens(evidence: DataFrame, k: int = 25) -> DataFrame:
    """The first k evidence tokens of each (entity, rule), as a list."""
    order = [F.asc_nulls_last("ord_us"), F.asc_nulls_last("ord_ref"), F.asc("pos"), F.asc("token")]
    top = top_per_key(evidence, ["entity_id", "rule_id"], order, k, "_k")
    return (
        top.groupBy("entity_id", "rule_id")
        .agg(F.array_sort(F.collect_list(F.struct("_k", "token"))).alias("_l"))
        .select("entity_id", "rule_id", F.col("_l.token").alias("tokens"))
    )


def dossiers(
    scored: DataFrame,
    entities: DataFrame,
    edges: DataFrame,
    events: DataFrame,
    firings: DataFrame,
    evidence: DataFrame,
    max_events: int = 60,
    max_parties: int = 15,
    max_tokens: int = 25,
) -> DataFrame:
    """One nested row per entity: score, identifiers, flows, counterparties, events, evidence.

    ``entities`` is the entity table with its identifiers; all its columns come back. Lists of
    events, counterparties and tokens have a fixed length by the report's own limits, and totals say what
    more there is; explanations are whole.
    """
    direction = F.when(F.col("event_type") == "transaction", F.when(F.col("amount") < 0, "out").otherwise("in"))
    ev = top_per_key(events.where("us is not null"), ["entity_id"], [F.asc("us"), F.asc("raw_row_ref")], max_events, "pos")
    channel = F.col("channel") if "channel" in events.columns else F.lit(None).cast("string")
    shown = ev.groupBy("entity_id").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "us", "event_type", direction.alias("direction"), "amount", channel.alias("channel"), "counterparty", "location", "source_file", "raw_row_ref"))
        ).alias("events")
    )
    total = events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total_events"))
    parties = (
        direct_counterparties(edges, scored, max_parties)
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "other", "direction", "edge_type", "amount", "tier"))).alias("counterparties"))
    )
    why = (
        firings.join(first_tokens(evidence, max_tokens), ["entity_id", "rule_id"], "left")
        .groupBy("entity_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("rule_id", "severity", "explanation", "tokens"))
            ).alias("findings")
        )
    )
    d = entities.join(scored, "entity_id", "left")
    for part in (value_in_out(edges), total, shown, parties, why):
        d = d.join(part, "entity_id", "left")
    return (
        d.withColumn("risk_tier", F.coalesce("risk_tier", F.lit("LOW")))
        .withColumn("value_in", F.coalesce("value_in", F.lit(0.0)))
        .withColumn("value_out", F.coalesce("value_out", F.lit(0.0)))
        .withColumn("total_events", F.coalesce("total_events", F.lit(0)))
        .withColumn("events_truncated", F.col("total_events") > max_events)
    )


def write_bundles(bundles: DataFrame, path: str) -> None:
    """Evidence bundles of the HIGH and CRITICAL entities, a folder per tier."""
    worst = bundles.where(F.col("risk_tier").isin("HIGH", "CRITICAL"))
    worst.write.mode("overwrite").partitionBy("risk_tier").json(path)


def filing_package(events: DataFrame, scored: DataFrame, firings: DataFrame, k: int = 100) -> DataFrame:
    """One filing per HIGH or CRITICAL entity: grounds per rule, first k transactions, totals."""
    who = scored.where(F.col("risk_tier").isin("HIGH", "CRITICAL")).select("entity_id", "risk_tier")
    grounds = (
        filing_categories(firings)
        .join(firings.select("entity_id", "rule_id", "explanation"), ["entity_id", "rule_id"])
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_list(F.struct("rule_id", "category", "grounds", "explanation"))).alias("grounds"))
    )
    schedule = (
        filing_schedule(events, who, k)
        .groupBy("entity_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("serial", "us", "direction", "amount", "counterparty", "source_file", "raw_row_ref"))
            ).alias("schedule")
        )
    )
    out = who
    for part in (grounds, schedule, filing_totals(events, who)):
        out = out.join(part, "entity_id", "left")
    return out.na.fill({"total_value": 0.0, "transactions": 0})


def trace_bundle(scored, entities, firings, evidence, events) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, findings, raw rows) of every entity; filter on entity_id for one.

    ``entities`` is the entity table; the header carries its identifiers.
    """
    raw = events.select(
        "entity_id", F.coalesce("source_file", F.lit("unknown")).alias("source_file"), "raw_row_ref", "us", "event_type",
        F.coalesce("amount", F.lit(0.0)).alias("amount"), F.coalesce("counterparty", F.lit("")).alias("counterparty"),
        F.coalesce("location", F.lit("")).alias("location"),
    )
    # Evidence is the large side: a right join keeps it where adaptive execution can split it.
    findings = evidence.join(firings, ["entity_id", "rule_id"], "right")
    return entities.join(scored, "entity_id", "left"), findings, raw


def cited_rows(evidence: DataFrame) -> DataFrame:
    """Evidence tokens that cite a source row: (entity_id, rule_id, kind, raw_row_ref, token)."""
    kind = F.regexp_extract("token", r"^(?:(bank|cdr|ipdr)_)?row_([0-9]+)$", 1)
    ref = F.regexp_extract("token", r"^(?:(bank|cdr|ipdr)_)?row_([0-9]+)$", 2)
    return (
        evidence.withColumn("kind", F.when(kind != "", kind))
        .withColumn("raw_row_ref", F.when(ref != "", ref).cast("bigint"))
        .select("entity_id", "rule_id", "kind", "raw_row_ref", "token")
    )


def event_kind(event_type):
    return F.when(event_type == "transaction", "bank").when(event_type == "ip_session", "ipdr").otherwise("cdr")


def evidence_rows(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Each citing token with the event it cites, or marked as not among the entity's rows."""
    cited = cited_rows(evidence).where("raw_row_ref is not null")
    rows = events.select(
        "entity_id", "raw_row_ref", event_kind(F.col("event_type")).alias("_kind"), "event_type", "us", "amount", "source_file"
    )
    hit = cited.join(rows, ["entity_id", "raw_row_ref"], "left").where(
        "kind is null or _kind is null or kind = _kind"
    ).drop("_kind")
    missing = cited.join(hit.select("entity_id", "rule_id", "token").distinct(), ["entity_id", "rule_id", "token"], "left_anti")
    return hit.unionByName(missing, allowMissingColumns=True).withColumn("in_entity_rows", F.col("event_type").isNotNull())


def run_metrics(scored: DataFrame, events: DataFrame, entities: DataFrame, firings: DataFrame) -> DataFrame:
    """Headline numbers of a run as (metric, value) rows."""

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in df.columns])).alias("x")).select("x.*")

    tier = F.col("risk_tier")
    tiers = scored.agg(
        *[F.count_if(tier == t).alias(f"{t.lower()}_count") for t in TIERS],
        F.count_if(tier.isin(*FLAGGED)).alias("flagged_suspects"),
        F.count_if("ml_anomaly").alias("ml_anomalies"),
    )
    held = sum((F.col(f"n_{t}s") for t in ("phone", "account", "imei", "vpa")), F.lit(0))
    ents = entities.agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.count_if(held > 1).alias("kyc_anchored_entities"),
        F.count_if(held <= 1).alias("unmapped_passthrough_entities"),
    )
    fired = firings.agg(F.count(F.lit(1)).alias("total_rule_firings"), F.count_distinct("rule_id").alias("rules_fired_count"))
    total = events.agg(F.count(F.lit(1)).alias("total_events"))
    return long(tiers).unionByName(long(ents)).unionByName(long(fired)).unionByName(long(total))


def event_span(events: DataFrame) -> DataFrame:
    """Count, first and last time per event type and over all."""
    a = [F.count(F.lit(1)).alias("events"), F.min("us").alias("first_us"), F.max("us").alias("last_us")]
    return events.groupBy("event_type").agg(*a).unionByName(events.agg(F.lit("ALL").alias("event_type"), *a))


def institution_matrix(events: DataFrame, scored: DataFrame, firings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(institution x tier, institution x rule) counts of entities."""
    own = (
        events.where("source_file is not null")
        .select("entity_id", institution(F.col("source_file")).alias("institution"))
        .distinct()
    )
    mine = scored.select("entity_id", "risk_tier").join(own, "entity_id", "left").withColumn(
        "institution", F.coalesce("institution", F.lit("Other Institution"))
    )
    by_tier = mine.groupBy("institution").pivot("risk_tier", list(TIERS)).agg(F.count(F.lit(1))).na.fill(0)
    rules = ["STR-1", "LAY-1", "MUL-1", "IDR-1", "LOC-1", "TCS-1", "TCS-2"]
    by_rule = (
        mine.join(firings.select("entity_id", "rule_id"), "entity_id", "left")
        .groupBy("institution")
        .pivot("rule_id", rules)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )
    return by_tier, by_rule


def institution_flagged(events: DataFrame, scored: DataFrame) -> DataFrame:
    own = (
        events.where("source_file is not null")
        .select("entity_id", institution(F.col("source_file")).alias("institution"))
        .distinct()
    )
    return (
        scored.where(F.col("risk_tier").isin(*FLAGGED))
        .join(own, "entity_id", "left")
        .select(F.coalesce("institution", F.lit("Other Institution")).alias("institution"), "entity_id", "risk_tier", "rules_fired")
    )


def run_digest(scored, events, entities, firings, edges, chains) -> dict[str, DataFrame]:
    """All tables of a run digest by name."""
    return {
        "metrics": run_metrics(scored, events, entities, firings),
        "event_span": event_span(events),
        "rule_firings": firings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("firings")),
        "entities": ranked_flagged(scored).join(entities, "entity_id", "left").join(value_in_out(edges), "entity_id", "left"),
        "entity_findings": firings,
        "top_transfers": largest_transfers(edges, scored),
        "entities_omitted": omitted_flagged(scored),
        "ml_only": only_anomalous(scored),
        "layering_chains": chains,
        "money_flow": money_flow_totals(edges),
    }
