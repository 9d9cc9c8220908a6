"""Headline timings: the stages of a run, and single operators. Prints one JSON line.

The ingestion stage normalises the given tables; it reads no statement files. ``small_run`` is the same full
run over a tenth of the data, if it lies beside, for the growth.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evifuse.operators import graph, resolution, rules, scoring, temporal  # noqa: E402
from evifuse.plans import casework as cw  # noqa: E402
from evifuse.plans.queries import QUERIES  # noqa: E402
from evifuse.session import at_once, build_session, cut, cut_all, drop_cuts  # noqa: E402
from evifuse.sources.reference import place_events  # noqa: E402

SINGLE = (
    "asof_nearest_call", "session_overlap", "call_before_transfer", "structuring", "mule", "geo_speed",
    "idr_swap", "layering_chains", "layering_best", "merged_edges", "components", "mention_links", "bank_normalise",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(spark, sf: str, took: dict[str, float]) -> None:
    """One run over the whole event table, timed per stage."""

    def timed(name, job):
        t0 = time.perf_counter()
        out = job()
        took[f"stage_{name}"] = round(time.perf_counter() - t0, 3)
        return out

    def ingest():
        kinds = ("bank_normalise", "cdr_normalise", "ipdr_normalise")
        at_once(*[lambda q=q: run(QUERIES[q](spark, sf)) for q in kinds])
        return [cut(cw.events(spark, sf), by="event_type"), *cut_all(cw.members(spark, sf), cw.id_map(spark, sf))]

    e, ids, owners = timed("ingestion", ingest)

    def resolve():
        by = lambda *t: e.where(e.event_type.isin(*t))
        kyc = cut(resolution.kyc_from_events(by("transaction"), by("call", "sms"), by("ip_session")), "kyc")
        who = resolution.assign_entities(resolution.identity_nodes(kyc, e), resolution.ownership_edges(kyc))
        who = cut(resolution.validate_entities(cut(who), kyc))
        run(resolution.apply_mapping(e, who.select("identifier", "entity_id")))

    timed("entity_resolution", resolve)
    enriched = timed("temporal_correlation", lambda: cut(temporal.enrich_transactions(e, cw.WINDOW)))

    def engine():
        found = rules.run_rules(e, ids, enriched, place_events(e), owners, limits=cw.LIMITS)
        return cut_all(found.firings, found.evidence)

    firings, _ = timed("rule_engine", engine)
    timed(
        "risk_scoring",
        lambda: cut(scoring.combine_scores(firings, scoring.isolation_flags(scoring.entity_features(e)), ids)),
    )
    phones = ids.where("id_type = 'phone'").select("identifier", "entity_id")
    timed("network_graph", lambda: cut(graph.build_edges(e, owners, phones)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up (class loading, first compile, Python workers) is not part of any query.
    run(cw.enriched(spark, sf))
    run(resolution.local_links(spark.range(64).repartition(int(cpus)).selectExpr("id as u", "id + 1 as v")))
    took: dict[str, float] = {}
    t0 = time.perf_counter()
    stages(spark, sf, took)
    took["full_run"] = round(time.perf_counter() - t0, 3)
    small = sf.rstrip("/").replace("sf0.1", "sf0.01") if sf.rstrip("/").endswith("sf0.1") else None
    if small and os.path.isdir(small):
        t0 = time.perf_counter()
        stages(spark, small, {})
        took["small_run"] = round(time.perf_counter() - t0, 3)
    for name in SINGLE:
        cw.forget()
        t1 = time.perf_counter()
        run(QUERIES[name](spark, sf))
        took[name] = round(time.perf_counter() - t1, 3)
    print(json.dumps({"metric": "full_run_seconds", "value": took["full_run"], "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    drop_cuts(spark)
    spark.stop()


if __name__ == "__main__":
    main()
