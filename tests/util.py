"""Hand-written event rows."""
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evifuse.sources.schema import EVENT, conform

T0 = datetime(2025, 6, 1, 12, 0, 0)


def at(hours=0.0, minutes=0.0, days=0.0):
    return T0 + timedelta(hours=hours, minutes=minutes, days=days)


def events(spark, rows):
    """Rows are dicts; raw_row_ref defaults to the position."""
    names = [f.name for f in EVENT.fields]
    full = []
    for n, r in enumerate(rows):
        r = {"raw_row_ref": n, "source_file": "bank.csv", **r}
        r.setdefault("entity_ref", r.get("entity_id"))
        full.append(tuple(r.get(c) for c in names))
    return conform(spark.createDataFrame(full, EVENT))


def txn(entity, amount, when, to=None, **more):
    return {"entity_id": entity, "event_type": "transaction", "amount": float(amount), "timestamp": when, "counterparty": to, **more}


def call(entity, when, to=None, **more):
    return {"entity_id": entity, "event_type": "call", "timestamp": when, "counterparty": to, **more}


def session(entity, when, to="1.2.3.4", **more):
    return {"entity_id": entity, "event_type": "ip_session", "timestamp": when, "counterparty": to, **more}


def id_map(spark, pairs):
    return spark.createDataFrame(pairs or [("none", "none")], "identifier string, entity_id string").where(
        F.lit(bool(pairs))
    )


def members(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, id_type string, identifier string").select(
        "entity_id", "identifier", "id_type"
    )


def fired(found):
    return {r["entity_id"]: r for r in found.firings.collect()}


def tokens(found, entity):
    rows = found.evidence.where(F.col("entity_id") == entity).collect()
    return [r["token"] for r in sorted(rows, key=lambda r: (r["ord_us"] or 0, r["ord_ref"] or 0, r["pos"]))]
