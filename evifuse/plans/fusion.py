"""A full run: events in, written result tables out."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from evifuse.operators import graph, resolution, rules, scoring, temporal
from evifuse.session import cut, cut_all
from evifuse.sources.reference import find_kyc_file, place_events, read_kyc, tower_master
from evifuse.sources.audit import read_digests
from evifuse.sources.statements import ingest_folder, ingest_manifest, list_files


@dataclass
class Run:
    """Result tables of one run; each is written once and can be read on its own."""

    events: DataFrame
    members: DataFrame
    enriched: DataFrame
    firings: DataFrame
    evidence: DataFrame
    scored: DataFrame
    edges: DataFrame
    extra: dict = field(default_factory=dict)


def fuse(
    events: DataFrame,
    members: DataFrame,
    id_map: DataFrame | None = None,
    towers: DataFrame | None = None,
    window_minutes: float = 10,
    rule_window_minutes: float = 15,
    limits: dict[str, dict] | None = None,
    anomalies: bool = True,
    edges: bool = True,
) -> Run:
    """Correlate, run the rules, score and build the graph for resolved events."""
    index = id_map if id_map is not None else resolution.identifier_index(members)
    phones = members.where("id_type = 'phone'").select("identifier", "entity_id").distinct()
    enriched = cut(temporal.enrich_transactions(events, window_minutes), "enriched")
    found = rules.run_rules(
        events, members, enriched, place_events(events, towers), index, rule_window_minutes, limits
    )
    firings, evidence = cut_all(found.firings, found.evidence)
    flags = scoring.isolation_flags(scoring.entity_features(events)) if anomalies else None
    scored = cut(scoring.combine_scores(firings, flags, members), "scored")
    links = cut(graph.build_edges(events, index, phones), "edges") if edges else None
    return Run(events, members, enriched, firings, evidence, scored, links)


def fuse_folder(spark: SparkSession, folder: str, **options) -> Run:
    """Ingest a folder of statements, resolve identities, then fuse; ``extra`` has the manifest of the files."""
    got = ingest_folder(spark, folder)
    if got.events is None:
        raise ValueError(f"no usable statement in {folder}")
    raw = cut(got.events, "events", by="event_type")
    bank = raw.where("event_type = 'transaction'")
    cdr = raw.where("event_type in ('call', 'sms')")
    ipdr = raw.where("event_type = 'ip_session'")
    path = find_kyc_file(spark, folder)
    kyc = read_kyc(spark, path) if path else resolution.kyc_from_events(bank, cdr, ipdr)
    kyc = cut(kyc, "kyc")
    nodes = resolution.identity_nodes(kyc, raw)
    members = resolution.assign_entities(nodes, resolution.ownership_edges(kyc))
    members = cut(resolution.validate_entities(members, kyc), "members")
    id_map = members.select("identifier", "entity_id")
    events = cut(resolution.apply_mapping(raw, id_map), "resolved", by="event_type")
    lists = [p for p in list_files(spark, folder, ".csv") if p.rsplit("/", 1)[-1].lower() == "tower_master.csv"]
    towers = tower_master(spark, lists[0]) if lists else None
    run = fuse(events, members, id_map=id_map, towers=towers, **options)
    manifest = cut(ingest_manifest(got, read_digests(spark, folder)), "manifest")
    run.extra.update(files=got.files, manifest=manifest, rejects=got.rejects, kyc=kyc)
    return run
