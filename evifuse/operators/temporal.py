"""Joins in time between transactions, calls and address sessions."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.operators.keyed import HOT_ROWS, MINUTE, SLICE_ROWS, latest, split_hot, top_per_key
from evifuse.session import cut

CALL_TYPES = ("call", "sms")


def nearest_within(
    left: DataFrame,
    rights: dict[str, DataFrame],
    by: list[str],
    us: str,
    ref: str,
    tolerance_us: int,
    min_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """For each left row the nearest row of every right side, same ``by`` key.

    Each right frame has ``by``, ``us``, ``ref`` and payload columns; its match comes
    back as a struct column named by its dict key, null beyond the (inclusive)
    tolerance. Equal distance prefers the earlier row; among equal right times the
    highest ``ref`` is taken looking back and the lowest looking forward.

    All sides share one shuffle: they are stacked, right rows before left ones of the same time, and the last right
    row up to each row and the first one from it on are running values. No row is copied, whatever the tolerance.
    """
    stacked = left.withColumn("_side", F.lit(1))
    for name, right in rights.items():
        pay = F.struct(F.col(us).alias("us"), *[c for c in right.columns if c not in by and c != us])
        rows = right.where(F.col(us).isNotNull()).select(*by, us, ref, pay.alias(name), F.lit(0).alias("_side"))
        stacked = stacked.unionByName(rows, allowMissingColumns=True)
    # A right row of the same time lies before, so looking back finds it at distance 0, which wins.
    out = latest(
        stacked, by, [us, "_side", ref], {f"_b_{n}": F.col(n) for n in rights}, {f"_f_{n}": F.col(n) for n in rights},
        min_rows=min_rows, slice_rows=slice_rows,
    ).where("_side = 1")
    picks = []
    for n in rights:
        b, f = F.col(f"_b_{n}"), F.col(f"_f_{n}")
        gap_b = F.when(b.isNotNull(), F.col(us) - b["us"])
        gap_f = F.when(f.isNotNull(), f["us"] - F.col(us))
        best = F.when(f.isNull() | (gap_b <= gap_f), b).otherwise(f)
        gap = F.when(f.isNull() | (gap_b <= gap_f), gap_b).otherwise(gap_f)
        picks.append(F.when(gap <= tolerance_us, best).alias(n))
    return out.select(*left.columns, *picks)


def enrich_transactions(
    events: DataFrame, window_minutes: float = 10, session_match: str = "nearest"
) -> DataFrame:
    """Each transaction with its nearest call and address session of the same entity.

    ``session_match="overlap"`` asks for a session active inside the window instead of
    one whose start is nearest.
    """
    w = int(window_minutes * MINUTE)
    txns = events.where("event_type = 'transaction'")
    calls = events.where(F.col("event_type").isin(*CALL_TYPES)).select(
        "entity_id", "us", "raw_row_ref", "counterparty", "location", "imei"
    )
    sessions = events.where("event_type = 'ip_session'").select(
        "entity_id", "us", "raw_row_ref", "counterparty", "location"
    )
    sides = {"_call": calls}
    if session_match == "nearest":
        sides["_session"] = sessions
    out = nearest_within(txns, sides, ["entity_id"], "us", "raw_row_ref", w)
    if session_match != "nearest":
        out = overlapping_session(out, events, w)
    return (
        out.withColumn("call_counterparty", F.col("_call.counterparty"))
        .withColumn("call_location", F.col("_call.location"))
        .withColumn("call_imei", F.col("_call.imei"))
        .withColumn("call_row_ref", F.col("_call.raw_row_ref"))
        .withColumn("session_dest_ip", F.col("_session.counterparty"))
        .withColumn("session_location", F.col("_session.location"))
        .withColumn("session_row_ref", F.col("_session.raw_row_ref"))
        # A match is a matched row, whether or not its text fields are filled.
        .withColumn("has_call_correlation", F.col("_call").isNotNull())
        .withColumn("has_session_correlation", F.col("_session").isNotNull())
        .withColumn(
            "has_both_correlation", F.col("has_call_correlation") & F.col("has_session_correlation")
        )
        .drop("_call", "_session")
    )


def overlapping_session(
    txns: DataFrame, events: DataFrame, margin_us: int = 0, slice_us: int = 24 * 60 * MINUTE
) -> DataFrame:
    """Each transaction with an address session active within ``margin_us`` of it.

    Among the sessions started by t + margin, the one that ends last is active iff any
    is, so one running maximum decides. It runs within slices of time, and what earlier slices leave
    behind, one row per slice, is carried forward; no session is copied, however long it lasts.
    """
    us, end = F.col("us"), F.greatest(F.coalesce(F.col("end_us"), F.col("us")), F.col("us"))
    sessions = events.where("event_type = 'ip_session'").select(
        "entity_id",
        (us - margin_us).alias("_at"),
        F.struct(end.alias("end_us"), "raw_row_ref", "us", "counterparty", "location").alias("_s"),
    )
    probes = txns.withColumn("_at", F.col("us"))
    stacked = probes.withColumn("_side", F.lit(1)).unionByName(
        sessions.withColumn("_side", F.lit(0)), allowMissingColumns=True
    ).withColumn("_slice", F.floor(F.col("_at") / slice_us))
    back = Window.partitionBy("entity_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = stacked.groupBy("entity_id", "_slice").agg(F.max("_s").alias("_e"))
    carry = ends.select(F.col("entity_id").alias("_ce"), F.col("_slice").alias("_cs"), F.max("_e").over(back).alias("_c"))
    w = (
        Window.partitionBy("entity_id", "_slice")
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = stacked.withColumn("_m", F.max("_s").over(w)).where("_side = 1")
    out = out.join(carry, F.col("entity_id").eqNullSafe(F.col("_ce")) & F.col("_slice").eqNullSafe(F.col("_cs")), "left")
    out = out.withColumn("_m", F.greatest("_m", "_c"))
    return out.withColumn(
        "_session", F.when(F.col("_m.end_us") >= F.col("us") - margin_us, F.col("_m"))
    ).select(*txns.columns, "_session")


class Linked(NamedTuple):
    transfers: DataFrame
    calls: DataFrame


def linked_calls_before(
    links: DataFrame, calls: DataFrame, window_us: int, least_us: int, min_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS
) -> Linked:
    """For each (transfer, called party) link, the calls in [t - window, t - least].

    ``links`` and ``calls`` share entity_id and party. ``transfers`` has the links with such calls, with their
    number and the first and last of them; ``calls`` has every call that a link follows in that time, once
    per entity and party. Both come from running values, so no pair is built and no call copied. A pair of entity and
    party with more than ``min_rows`` rows is answered in slices.
    """
    key = ["entity_id", "party"]
    heard = calls.select(*key, "us", F.struct("us", F.col("raw_row_ref").alias("ref")).alias("_c"))
    stacked = links.withColumn("_side", F.lit(1)).unionByName(heard.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    stacked = cut(stacked, "links")  # read twice
    cold, hot = split_hot(stacked, key, ["us"], min_rows, slice_rows)
    base = Window.partitionBy(*key)
    up = base.orderBy(F.asc("us"))
    down = base.orderBy(F.desc("us"))
    # Only frames that grow with the row: each is one running aggregate.
    by_latest = up.rangeBetween(Window.unboundedPreceding, -least_us)
    too_old = up.rangeBetween(Window.unboundedPreceding, -(window_us + 1))
    not_old = down.rangeBetween(Window.unboundedPreceding, window_us)
    by_last = up.rangeBetween(Window.unboundedPreceding, window_us)
    too_soon = up.rangeBetween(Window.unboundedPreceding, least_us - 1)
    link = F.when(F.col("_side") == 1, 1)
    found = cold.select(
        "*",
        (F.count("_c").over(by_latest) - F.count("_c").over(too_old)).alias("n_calls"),
        (F.count(link).over(by_last) - F.count(link).over(too_soon)).alias("_n_links"),
        F.max("_c").over(by_latest).alias("_last"),
        F.min("_c").over(not_old).alias("_first"),
    ).where("(_side = 1 and n_calls > 0) or (_side = 0 and _n_links > 0)")
    if hot is not None:
        found = found.unionByName(_linked_in_slices(hot, key, window_us, least_us, slice_rows), allowMissingColumns=True)
    out = cut(found, "linked")
    transfers = out.where("_side = 1").select(
        *links.columns,
        "n_calls",
        F.col("_first.us").alias("first_call_us"),
        F.col("_first.ref").alias("first_call_ref"),
        F.col("_last.us").alias("last_call_us"),
        F.col("_last.ref").alias("last_call_ref"),
    )
    heard = out.where("_side = 0").select("entity_id", "party", "us", F.col("_c.ref").alias("raw_row_ref")).distinct()
    return Linked(transfers, heard)


def _linked_in_slices(rows: DataFrame, key: list[str], window_us: int, least_us: int, slice_rows: int) -> DataFrame:
    """What ``linked_calls_before`` finds for hot keys, from running values at shifted times.

    A link asks at its earliest time, before the calls of that time, for the first call from there on and the number
    before, and at its latest time, after the calls of that time, for the last call and the number so far. A call asks
    for the first link from its earliest time on.
    """
    rows = cut(rows.drop("_slice").withColumn("_id", F.monotonically_increasing_id()), "hot-links")
    calls = rows.where("_side = 0").select(*key, F.col("us").alias("_at"), F.lit(0).alias("_turn"), "_c", F.col("_c.ref").alias("_ref"))
    ask = rows.where("_side = 1")
    first = ask.select(*key, (F.col("us") - window_us).alias("_at"), F.lit(-1).alias("_turn"), "_id")
    last = ask.select(*key, (F.col("us") - least_us).alias("_at"), F.lit(1).alias("_turn"), "_id")
    told = latest(
        calls.unionByName(first, allowMissingColumns=True).unionByName(last, allowMissingColumns=True), key, ["_at", "_turn", "_ref"],
        {"_last": F.col("_c")}, {"_first": F.col("_c")}, {"_so_far": F.col("_c")}, min_rows=0, slice_rows=slice_rows,
    ).where("_turn <> 0")
    asked_last = F.col("_turn") == 1
    told = told.groupBy("_id").agg(
        F.sum(F.when(asked_last, F.col("_so_far")).otherwise(-F.col("_so_far"))).alias("n_calls"),
        F.max(F.when(asked_last, F.col("_last"))).alias("_last"), F.max(F.when(~asked_last, F.col("_first"))).alias("_first"),
    ).where("n_calls > 0")
    times = ask.select(*key, F.col("us").alias("_at"), F.lit(0).alias("_turn"), F.col("us").alias("_us"))
    asks = rows.where("_side = 0").select(*key, (F.col("us") + least_us).alias("_at"), F.lit(-1).alias("_turn"), "_id", F.col("us").alias("_call_us"))
    followed = latest(
        times.unionByName(asks, allowMissingColumns=True), key, ["_at", "_turn", "_id"], ahead={"_next": F.col("_us")},
        min_rows=0, slice_rows=slice_rows,
    ).where(F.col("_next") <= F.col("_call_us") + window_us).select("_id")
    return ask.join(told, "_id").drop("_id").unionByName(rows.join(followed, "_id", "left_semi").drop("_id"), allowMissingColumns=True)


def unified_timeline(events: DataFrame, entity_id: str | None = None) -> DataFrame:
    """Events on one time axis; the filter on entity is below the sort."""
    d = events if entity_id is None else events.where(F.col("entity_id") == entity_id)
    return d.where("us is not null").orderBy("us", "raw_row_ref")


def lane(event_type: Column) -> Column:
    return (
        F.when(event_type == "transaction", "transaction")
        .when(event_type.isin(*CALL_TYPES), "call")
        .when(event_type == "ip_session", "ip_session")
    )


def timeline_rows(events: DataFrame, cited: DataFrame, max_events: int = 1500) -> DataFrame:
    """The first ``max_events`` events of every entity, in lanes, with cited rows marked.

    ``cited`` has (entity_id, raw_row_ref). The cap belongs to the view; totals come from
    ``timeline_totals``.
    """
    shown = top_per_key(
        events.where("us is not null"), ["entity_id"], [F.asc("us"), F.asc("raw_row_ref")], max_events, "pos"
    ).withColumn("lane", lane(F.col("event_type")))
    shown = shown.where("lane is not null")
    marks = cited.select("entity_id", "raw_row_ref").distinct().withColumn("_cited", F.lit(True))
    credit = F.col("amount") >= 0
    money = (F.col("lane") == "transaction") & F.col("amount").isNotNull()
    return shown.join(marks, ["entity_id", "raw_row_ref"], "left").select(
        "entity_id",
        "pos",
        "lane",
        "event_type",
        "us",
        "end_us",
        F.abs("amount").alias("amount"),
        F.when(money, F.when(credit, "credit").otherwise("debit")).alias("direction"),
        "counterparty",
        "location",
        "source_file",
        "raw_row_ref",
        F.when(
            money,
            F.concat(F.when(credit, "+").otherwise("-"), F.lit("₹"), F.format_number(F.abs("amount"), 0)),
        )
        .when(F.col("lane") == "call", F.upper("event_type"))
        .otherwise("SESSION")
        .alias("label"),
        F.coalesce("_cited", F.lit(False)).alias("cited"),
    )


def timeline_totals(events: DataFrame, max_events: int = 1500) -> DataFrame:
    """Lane counts, span and truncation of every entity's timeline."""
    return (
        events.where("us is not null")
        .groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_if(F.col("event_type") == "transaction").alias("transactions"),
            F.count_if(F.col("event_type").isin(*CALL_TYPES)).alias("calls"),
            F.count_if(F.col("event_type") == "ip_session").alias("sessions"),
            F.min("us").alias("start_us"),
            F.max("us").alias("end_us"),
        )
        .withColumn("truncated", F.col("total_events") > max_events)
    )


def correlation_bands(enriched: DataFrame, window_minutes: float) -> DataFrame:
    """[t - W, t + W] around every transaction that has a call or a session."""
    w = int(window_minutes * MINUTE)
    call, session = F.col("has_call_correlation"), F.col("has_session_correlation")
    return enriched.where(call | session).select(
        "entity_id",
        F.when(call & session, "tcs1").when(call, "call").otherwise("session").alias("kind"),
        (F.col("us") - w).alias("start_us"),
        (F.col("us") + w).alias("end_us"),
        F.col("us").alias("centre_us"),
        F.abs("amount").alias("amount"),
        "raw_row_ref",
        "call_row_ref",
        "session_row_ref",
    )


def focus_bands(bands: DataFrame) -> DataFrame:
    """The band of each entity worth showing: a double match first, then the amount."""
    rank = F.struct(
        (F.col("kind") == "tcs1").cast("int").alias("t"),
        F.coalesce("amount", F.lit(0.0)).alias("a"),
        (-F.col("centre_us")).alias("u"),
        (-F.col("raw_row_ref")).alias("r"),
    )
    cols = [c for c in bands.columns if c != "entity_id"]
    return (
        bands.groupBy("entity_id")
        .agg(F.max_by(F.struct(*cols), rank).alias("b"))
        .select("entity_id", *[f"b.{c}" for c in cols])
    )


def what_if(
    events: DataFrame, entity_id: str | None, window_minutes: float, run_minutes: float | None = None
) -> DataFrame:
    """The join of one entity (or of all) redone at another window, clamped to 1 minute .. 1 day.

    ``run_minutes`` is the window of the run; the result is a preview unless it is the same.
    """
    w = min(max(window_minutes, 1), 1440)
    mine = events if entity_id is None else events.where(F.col("entity_id") == entity_id)
    return enrich_transactions(mine, w).withColumn("is_preview", F.lit(run_minutes is None or w != run_minutes))
