"""The seven named detection rules, each one job over all entities.

A rule writes its hits once (lineage is cut there) and returns two frames read from them:

* firings  (entity_id, rule_id, severity, explanation), one row per entity;
* evidence (entity_id, rule_id, ord_us, ord_ref, pos, token), one row per token, so the
  evidence of a very busy entity is never gathered into one cell. Texts quote the
  first few items, as reports do; the evidence frame is whole.
"""
from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.functions.fields import digits, row_token
from evifuse.functions.geo import distance_km
from evifuse.operators.keyed import (
    HOT_ROWS,
    HOUR,
    MINUTE,
    first_per_key,
    into_slices,
    last_before,
    top_per_key,
)
from evifuse.operators.temporal import CALL_TYPES, linked_calls_before, nearest_within
from evifuse.session import at_once, cut, cut_all

RULES = ("IDR-1", "TCS-1", "TCS-2", "STR-1", "LAY-1", "MUL-1", "LOC-1")
DAY = 24 * HOUR


class Found(NamedTuple):
    firings: DataFrame
    evidence: DataFrame


def _firing(df: DataFrame, rule: str, severity, explanation: Column) -> DataFrame:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(
        "entity_id", F.lit(rule).alias("rule_id"), sev.alias("severity"), explanation.alias("explanation")
    )


def _tokens(df: DataFrame, rule: str, us: Column, ref: Column, tokens: list[Column]) -> DataFrame:
    """Long evidence rows from a list of token columns; null tokens are left out."""
    return df.select(
        "entity_id",
        F.lit(rule).alias("rule_id"),
        us.cast("bigint").alias("ord_us"),
        ref.cast("bigint").alias("ord_ref"),
        F.posexplode(F.array(*tokens)).alias("pos", "token"),
    ).where("token is not null")


def _whole(c: Column) -> Column:
    return F.format_string("%.0f", c)


def _stamp(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")


def _first_texts(df: DataFrame, order: list[Column], text: Column, k: int = 3) -> DataFrame:
    """The first k detail texts of each entity, joined, plus the count of all."""
    total = df.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    few = (
        top_per_key(df.withColumn("_t", text), ["entity_id"], order, k, "_k")
        .groupBy("entity_id")
        .agg(F.sort_array(F.collect_list(F.struct("_k", "_t"))).alias("_l"))
        .select("entity_id", F.array_join(F.col("_l._t"), "; ").alias("details"))
    )
    return total.join(few, "entity_id")


# --------------------------------------------------------------------------- IDR-1


def device_fanout(events: DataFrame, min_numbers: int = 2) -> DataFrame:
    """Handsets that worked several numbers inside one entity.

    Distinct (entity, imei, number) triples are formed first, so a busy handset is
    reduced before anything is counted.
    """
    triples = (
        events.where("imei is not null and entity_ref is not null")
        .groupBy("entity_id", "imei", "entity_ref")
        .agg(F.min(F.struct("us", "raw_row_ref")).alias("first_row"))
    )
    per = triples.groupBy("entity_id", "imei").agg(F.count(F.lit(1)).alias("msisdn_count"))
    return triples.join(per.where(F.col("msisdn_count") >= min_numbers), ["entity_id", "imei"]).select(
        "entity_id",
        "imei",
        F.col("entity_ref").alias("msisdn"),
        F.col("first_row.raw_row_ref").alias("first_row_ref"),
        "msisdn_count",
    )


def identifier_fanout(identifiers: DataFrame, id_type: str, least: int) -> DataFrame:
    """Entities that hold at least ``least`` distinct identifiers of one type."""
    return (
        identifiers.where(F.col("id_type") == id_type)
        .select("entity_id", "identifier")
        .distinct()
        .groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )


def identifier_swaps(
    events: DataFrame, window_minutes: float = 60, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every change of the device or SIM behind a number, graded.

    The last known device, SIM and row before each event come from running windows
    per number; whether a transaction was near is one nearest-row join.
    """
    d = events.where("us is not null").withColumn("_number", F.concat_ws("\x1f", "entity_id", "entity_ref"))
    d = d.select("_number", "entity_id", "entity_ref", "us", "raw_row_ref", "imei", "imsi")
    prev = last_before(
        d,
        "_number",
        ["us", "raw_row_ref"],
        {
            "old_imei": F.col("imei"),
            "old_imsi": F.col("imsi"),
            "prev": F.struct("us", "raw_row_ref"),
        },
        min_rows=hot_rows,
    )
    dev = F.coalesce(F.col("imei") != F.col("old_imei"), F.lit(False))
    sim = F.coalesce(F.col("imsi") != F.col("old_imsi"), F.lit(False))
    swaps = prev.withColumn("device_changed", dev).withColumn("sim_changed", sim).where(
        "device_changed or sim_changed"
    )
    txns = events.where("event_type = 'transaction'").select("entity_id", "us", "raw_row_ref")
    near = nearest_within(
        swaps, {"_txn": txns}, ["entity_id"], "us", "raw_row_ref", int(window_minutes * MINUTE)
    )
    return near.select(
        "entity_id",
        F.col("entity_ref").alias("number"),
        "us",
        "raw_row_ref",
        F.col("prev.us").alias("prev_us"),
        F.col("prev.raw_row_ref").alias("prev_row_ref"),
        "old_imei",
        F.col("imei").alias("new_imei"),
        "old_imsi",
        F.col("imsi").alias("new_imsi"),
        "device_changed",
        "sim_changed",
        F.col("_txn").isNotNull().alias("nearby_txn"),
        F.when(F.col("device_changed") & F.col("sim_changed"), "HIGH")
        .when(F.col("_txn").isNotNull(), "MEDIUM")
        .otherwise("LOW")
        .alias("severity"),
    )


def first_swaps(swaps: DataFrame) -> DataFrame:
    """The swap an entity is reported with: first number, earliest swap."""
    return first_per_key(swaps, "entity_id", ["number", "us", "raw_row_ref"])


def idr_limbs(
    events: DataFrame,
    identifiers: DataFrame,
    window_minutes: float = 60,
    min_accounts: int = 3,
    min_imeis: int = 2,
    min_numbers: int = 2,
    hot_rows: int = HOT_ROWS,
) -> Found:
    """All limbs of the identity rule: (entity_id, limb, grade, description) and evidence."""
    def holders(id_type: str, least: int) -> DataFrame:
        return (
            identifiers.where(F.col("id_type") == id_type)
            .select("entity_id", "identifier")
            .distinct()
            .join(identifier_fanout(identifiers, id_type, least), "entity_id", "left_semi")
        )

    fan, own_accounts, own_imeis, swap = cut_all(
        device_fanout(events, min_numbers),
        holders("account", min_accounts),
        holders("imei", min_imeis),
        first_swaps(identifier_swaps(events, window_minutes, hot_rows)),
    )
    per_device = fan.groupBy("entity_id", "imei").agg(F.max("msisdn_count").alias("n"))
    devices = fan.groupBy("entity_id", "imei").agg(
        F.max("msisdn_count").alias("n"), F.array_sort(F.collect_set("msisdn")).alias("numbers")
    )
    limb1 = devices.select(
        "entity_id",
        F.lit(1).alias("limb"),
        F.lit(2).alias("grade"),
        F.col("imei").alias("item"),
        F.concat(
            F.lit("Device "), "imei", F.lit(" carried "), F.col("n").cast("string"), F.lit(" numbers ("),
            F.array_join("numbers", ", "), F.lit(")."),
        ).alias("description"),
    )
    ev1 = _tokens(
        fan, "IDR-1", F.lit(1), F.col("first_row_ref"),
        [
            row_token("row_", F.col("first_row_ref")),
            F.concat(F.lit("imei:"), "imei"),
            F.concat(F.lit("msisdn:"), "msisdn"),
            F.lit("limb:device_fanout"),
        ],
    ).unionByName(
        _tokens(per_device, "IDR-1", F.lit(1), F.lit(None),
                [F.concat(F.lit("msisdn_count:"), F.col("n").cast("string"))])
    )

    def held(own: DataFrame, id_type: str, least: int, limb: int, name: str, noun: str, label: str) -> Found:
        many = own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
        rows = own.groupBy("entity_id").agg(
            F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("identifier")).alias("all")
        ).select(
            "entity_id", F.lit(limb).alias("limb"), F.lit(1).alias("grade"), F.lit("").alias("item"),
            F.concat(
                F.lit(f"{name}: owns "), F.col("n").cast("string"), F.lit(f" {noun}, {least} or more are notable ("),
                F.array_join("all", ", "), F.lit(")."),
            ).alias("description"),
        )
        tokens = _tokens(
            own, "IDR-1", F.lit(limb), F.lit(None), [F.concat(F.lit(f"{id_type}:"), "identifier")]
        ).unionByName(
            _tokens(many, "IDR-1", F.lit(limb), F.lit(None),
                    [F.concat(F.lit(f"{id_type}_count:"), F.col("n").cast("string")), F.lit(f"limb:{label}")])
        )
        return Found(rows, tokens)

    accounts = held(own_accounts, "account", min_accounts, 2, "Many accounts", "accounts", "account_fanout")
    imeis = held(own_imeis, "imei", min_imeis, 3, "Many devices", "devices", "device_multiplicity")

    mins = (F.col("us") - F.col("prev_us")) / MINUTE
    gap = F.when(mins < 120, F.format_string("%.1f mins", mins)).otherwise(F.format_string("%.1f hours", mins / 60.0))
    none = F.lit("unknown")
    kind = (
        F.when(F.col("severity") == "HIGH", "SIM and device replaced together")
        .when(F.col("severity") == "MEDIUM", "SIM or device replaced close to a payment")
        .otherwise("SIM or device replaced, no payment near")
    )
    limb4 = swap.select(
        "entity_id", F.lit(4).alias("limb"),
        F.when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "MEDIUM", 1).otherwise(0).alias("grade"),
        F.lit("").alias("item"),
        F.concat(
            kind, F.lit(": number "), "number", F.lit(", device "), F.coalesce("old_imei", none), F.lit(" to "),
            F.coalesce("new_imei", none), F.lit(", SIM "), F.coalesce("old_imsi", none), F.lit(" to "),
            F.coalesce("new_imsi", none), F.lit(", "), gap, F.lit(" after its last record."),
        ).alias("description"),
    )
    dev, sim = F.col("device_changed"), F.col("sim_changed")
    ev4 = _tokens(
        swap, "IDR-1", F.lit(4), F.col("raw_row_ref"),
        [
            row_token("row_", F.col("prev_row_ref")),
            row_token("row_", F.col("raw_row_ref")),
            F.concat(F.lit("phone:"), "number"),
            F.concat(F.lit("severity:"), "severity"),
            F.concat(F.lit("change:"), kind),
            F.concat(F.lit("time_gap:"), gap),
            F.concat(F.lit("nearby_txn:"), F.when(F.col("nearby_txn"), "yes").otherwise("no")),
            F.when(dev, F.concat(F.lit("old_imei:"), "old_imei")),
            F.when(dev, F.concat(F.lit("new_imei:"), "new_imei")),
            F.when(sim, F.concat(F.lit("old_imsi:"), "old_imsi")),
            F.when(sim, F.concat(F.lit("new_imsi:"), "new_imsi")),
            F.lit("limb:identifier_swap"),
        ],
    )
    limbs = limb1.unionByName(accounts.firings).unionByName(imeis.firings).unionByName(limb4)
    tokens = ev1.unionByName(accounts.evidence).unionByName(imeis.evidence).unionByName(ev4)
    return Found(limbs, tokens)


def idr1(events: DataFrame, identifiers: DataFrame, **limits) -> Found:
    """Identity fan-out: the limbs combined; two limbs lift MEDIUM to HIGH."""
    limbs, tokens = idr_limbs(events, identifiers, **limits)
    limbs = cut(limbs, "limbs")
    best = F.max("grade")
    graded = limbs.groupBy("entity_id").agg(
        F.when((best == 2) | ((best == 1) & (F.count(F.lit(1)) > 1)), "HIGH")
        .when(best == 1, "MEDIUM")
        .otherwise("LOW")
        .alias("severity"),
        F.count(F.lit(1)).alias("limbs"),
    )
    # Worst limb first; every limb is quoted.
    parts = limbs.groupBy("entity_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("grade")).alias("g"), "limb", "item", "description"))).alias("_d")
    )
    rows = graded.join(parts, "entity_id")
    text = F.concat(
        "severity", F.lit(" identity finding for "), "entity_id", F.lit(". "), F.array_join(F.col("_d.description"), " "),
        F.when(
            F.col("limbs") > 1,
            F.concat(F.lit(" Graded on "), F.col("limbs").cast("string"), F.lit(" independent findings.")),
        ).otherwise(""),
    )
    head = _tokens(
        graded, "IDR-1", F.lit(0), F.lit(None),
        [F.concat(F.lit("severity:"), "severity"), F.concat(F.lit("limbs:"), F.col("limbs").cast("string"))],
    )
    return Found(_firing(rows, "IDR-1", F.col("severity"), text), head.unionByName(tokens))


# ------------------------------------------------------------------------- TCS-1/2


def tcs1(enriched: DataFrame) -> Found:
    """Temporal coincidence: a call and a session inside the window of a transaction."""
    both = cut(
        enriched.where("has_both_correlation").select(
            "entity_id", "us", "raw_row_ref", "amount", "call_row_ref", "session_row_ref"
        ),
        "tcs1",
    )
    texts = _first_texts(
        both, [F.asc("us"), F.asc("raw_row_ref")],
        F.concat(_whole(F.abs("amount")), F.lit(" on "), _stamp(F.col("us"))),
    )
    text = F.concat(
        "entity_id", F.lit(" was on a call and online around "), F.col("n").cast("string"), F.lit(" payment(s): "),
        "details", F.lit("."),
    )
    tokens = _tokens(
        both, "TCS-1", F.col("us"), F.col("raw_row_ref"),
        [
            row_token("bank_row_", F.col("raw_row_ref")),
            row_token("cdr_row_", F.col("call_row_ref")),
            row_token("ipdr_row_", F.col("session_row_ref")),
        ],
    )
    return Found(_firing(texts, "TCS-1", "MEDIUM", text), tokens)


def call_payee_links(events: DataFrame, id_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, calls): which called parties each transfer's payee belongs to.

    ``resolved``: party and payee map to one entity. ``embedded``: the payee's digits
    contain the party's number of ten digits or more; the payee's digit runs are
    exploded so that containment becomes an equality join.
    """
    lookup = id_map.select(F.col("identifier").alias("counterparty"), F.col("entity_id").alias("_owner"))
    calls = events.where(F.col("event_type").isin(*CALL_TYPES) & F.col("counterparty").isNotNull()).select(
        "entity_id", "counterparty", "us", "raw_row_ref"
    )
    txns = (
        events.where("event_type = 'transaction' and counterparty is not null")
        .select("entity_id", "us", "raw_row_ref", "amount", "counterparty")
        .join(lookup.withColumnRenamed("_owner", "payee_entity"), "counterparty", "left")
        .withColumnRenamed("counterparty", "payee")
    )
    parties = (
        calls.select("entity_id", "counterparty")
        .distinct()
        .join(lookup.withColumnRenamed("_owner", "callee_entity"), "counterparty", "left")
        .withColumnRenamed("counterparty", "party")
        .withColumn("number", digits(F.col("party")))
    )
    resolved = txns.where("payee_entity is not null").join(
        parties.where("callee_entity is not null").select(
            "entity_id", "party", "callee_entity", F.col("callee_entity").alias("payee_entity")
        ),
        ["entity_id", "payee_entity"],
    )
    runs = F.filter(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length("_pd") - 9, F.lit(1))),
                lambda i: F.transform(
                    F.sequence(F.lit(10), F.greatest(F.length("_pd") - i + 1, F.lit(10))),
                    lambda n: F.substring(F.col("_pd"), i, n),
                ),
            )
        ),
        lambda s: F.length(s) >= 10,
    )
    embedded = (
        txns.withColumn("_pd", digits(F.col("payee")))
        .where(F.length("_pd") >= 10)
        .withColumn("number", F.explode(F.array_distinct(runs)))
        .drop("_pd")
        .join(parties.where(F.length("number") >= 10), ["entity_id", "number"])
        .where(~F.coalesce(F.col("payee_entity") == F.col("callee_entity"), F.lit(False)))
        .drop("number")
    )
    links = resolved.withColumn("link", F.lit("resolved")).unionByName(
        embedded.withColumn("link", F.lit("embedded"))
    )
    return links, calls.withColumnRenamed("counterparty", "party")


def call_then_transfer(
    events: DataFrame, id_map: DataFrame, window_minutes: float = 15, least_minutes: float = 1
) -> DataFrame:
    """Transfers that follow a call to the payee by ``least`` .. ``window`` minutes."""
    links, calls = call_payee_links(events, id_map)
    return linked_calls_before(links, calls, int(window_minutes * MINUTE), int(least_minutes * MINUTE)).transfers


def tcs2(events: DataFrame, id_map: DataFrame, window_minutes: float = 15, least_minutes: float = 1) -> Found:
    """Call-then-transfer. Every transfer and every call that one follows is evidence, once per party."""
    links, calls = call_payee_links(events, id_map)
    found = linked_calls_before(links, calls, int(window_minutes * MINUTE), int(least_minutes * MINUTE))
    hits = cut(found.transfers, "tcs2")
    gap = (F.col("us") - F.col("last_call_us")) / MINUTE
    texts = _first_texts(
        hits, [F.asc("us"), F.asc("raw_row_ref"), F.asc("party")],
        F.concat(
            F.lit("called "), "party", F.lit(" on "), _stamp(F.col("last_call_us")), F.lit(" and paid "),
            _whole(F.abs("amount")), F.lit(" to "), "payee", F.lit(" "), _whole(gap), F.lit(" min later ("), "link", F.lit(")"),
        ),
    )
    sums = hits.groupBy("entity_id").agg(
        F.sum("n_calls").alias("instances"), F.array_join(F.array_sort(F.collect_set("callee_entity")), ", ").alias("who")
    )
    rows = texts.join(sums, "entity_id")
    text = F.concat(
        "entity_id", F.lit(" paid a party it had called up to "), F.lit(f"{window_minutes:g}"), F.lit(" minutes before, "),
        F.col("instances").cast("string"), F.lit(" time(s): "), "details", F.lit("."),
        F.when(F.col("who") != "", F.concat(F.lit(" Called: "), "who", F.lit("."))).otherwise(""),
    )
    paid = _tokens(
        hits, "TCS-2", F.col("us"), F.col("raw_row_ref"),
        [
            row_token("row_", F.col("raw_row_ref")),
            F.concat(F.lit("calls:"), F.col("n_calls").cast("string")),
            F.concat(F.lit("link:"), "link"),
            F.concat(F.lit("called:"), "party"),
            F.concat(F.lit("paid:"), "payee"),
        ],
    )
    called = _tokens(
        found.calls, "TCS-2", F.col("us"), F.col("raw_row_ref"),
        [row_token("row_", F.col("raw_row_ref")), F.concat(F.lit("called:"), "party")],
    )
    return Found(_firing(rows, "TCS-2", "MEDIUM", text), paid.unionByName(called))


# --------------------------------------------------------------------------- STR-1


def structuring_windows(
    events: DataFrame,
    threshold: float = 50_000,
    count_min: int = 3,
    window_hours: float = 48,
    lower_ratio: float = 0.90,
) -> DataFrame:
    """Every run of ``count_min`` consecutive just-under-threshold debits in time.

    Debits in the band are filtered first; each goes to its own time slice and to the
    slice before, so a run never has to look past its slice.
    """
    span = int(window_hours * HOUR)
    length = span
    band = events.where(
        (F.col("event_type") == "transaction")
        & (F.col("amount") < 0)
        & (F.abs("amount") >= threshold * lower_ratio)
        & (F.abs("amount") < threshold)
    ).select("entity_id", "us", "raw_row_ref", "amount")
    band = into_slices(band, F.col("us") - span, F.col("us"), length)
    w = Window.partitionBy("entity_id", "_slice").orderBy("us", "raw_row_ref")
    rows = band.select(
        "*",
        *[
            F.lead(F.struct("us", "raw_row_ref", "amount"), i).over(w).alias(f"_n{i}")
            for i in range(1, count_min)
        ],
    ).where(F.floor(F.col("us") / length) == F.col("_slice"))
    last = F.col(f"_n{count_min - 1}") if count_min > 1 else F.struct("us", "raw_row_ref", "amount")
    members = F.array(
        F.struct("us", "raw_row_ref", "amount"), *[F.col(f"_n{i}") for i in range(1, count_min)]
    )
    return rows.where(last["us"] - F.col("us") <= span).select(
        "entity_id", "us", "raw_row_ref", last["us"].alias("last_us"), members.alias("members")
    )


def str1(events: DataFrame, threshold: float = 50_000, **limits) -> Found:
    """Structuring: the earliest such run of each entity."""
    first = first_per_key(
        structuring_windows(events, threshold, **limits), "entity_id", ["us", "raw_row_ref"]
    )
    first = cut(first, "str1")
    hours = (F.col("last_us") - F.col("us")) / HOUR
    amounts = F.array_join(F.transform(F.col("members.amount"), lambda a: F.format_string("%.0f", F.abs(a))), ", ")
    text = F.concat(
        "entity_id", F.lit(" sent "), F.size("members").cast("string"),
        F.lit(f" payments a little below {threshold:.0f} in "), F.format_string("%.1f", hours), F.lit(" h: "), amounts, F.lit("."),
    )
    tokens = first.select(
        "entity_id", F.lit("STR-1").alias("rule_id"), F.posexplode("members").alias("pos", "m")
    ).select(
        "entity_id", "rule_id", F.col("m.us").alias("ord_us"), F.col("m.raw_row_ref").alias("ord_ref"),
        "pos", row_token("row_", F.col("m.raw_row_ref")).alias("token"),
    )
    return Found(_firing(first, "STR-1", "HIGH", text), tokens)


# --------------------------------------------------------------------------- LAY-1


def transfer_edges(events: DataFrame, id_map: DataFrame) -> DataFrame:
    """Debits whose counterparty resolves: (src, dst, us, ref, amt)."""
    lookup = id_map.select(F.col("identifier").alias("counterparty"), F.col("entity_id").alias("dst"))
    return (
        events.where("event_type = 'transaction' and amount < 0 and counterparty is not null and us is not null")
        .select(
            F.col("entity_id").alias("src"), "counterparty", "us",
            F.col("raw_row_ref").alias("ref"), F.abs("amount").alias("amt"),
        )
        .join(lookup, "counterparty")
        .select("src", "dst", "us", "ref", "amt")
    )


def _band_join(front: DataFrame, hops: DataFrame, span: int, low: float, high: float) -> DataFrame:
    """``front`` (cur, us, amt, ...) with every transfer that may follow: (n_dst, n_us, n_ref, n_amt, ...).

    Next hops are found by equality on (entity, time bucket, amount bucket): both windows span two
    neighbour buckets, so even the transfers of one hub are spread over many join keys.
    """
    width = max(math.log(high / low), 1e-6)

    def amount_bucket(c: Column, slack: float) -> Column:
        return F.floor(F.log(c) / width + slack)

    keyed = hops.select(
        F.col("src").alias("cur"), *[F.col(c).alias(f"n_{c}") for c in hops.columns if c != "src"],
        F.floor(F.col("us") / span).alias("_t"), amount_bucket(F.col("amt"), 0.0).alias("_a"),
    )
    probe = front.withColumn(
        "_t", F.explode(F.sequence(F.floor((F.col("us") + 1) / span), F.floor((F.col("us") + span) / span)))
    ).withColumn(
        "_a",
        F.explode(F.sequence(amount_bucket(F.col("amt") * low, -1e-9), amount_bucket(F.col("amt") * high, 1e-9))),
    )
    return probe.join(keyed, ["cur", "_t", "_a"]).where(
        (F.col("n_us") > F.col("us"))
        & (F.col("n_us") <= F.col("us") + span)
        & (F.col("n_amt") >= F.col("amt") * low)
        & (F.col("n_amt") <= F.col("amt") * high)
    )


def layering_paths(
    edges: DataFrame,
    max_hours: float = 12,
    min_amount: float = 50_000.0,
    min_skim: float = 0.03,
    max_skim: float = 0.20,
    max_depth: int = 6,
    min_entities: int = 3,
) -> DataFrame:
    """Every transfer path that shrinks by a commission at each hop.

    One join per hop. A hop back to the origin closes a cycle and ends the path; other entities are not
    visited twice. A dense graph has exponentially many paths; ``best_chains`` finds the reported ones without them.
    """
    span, low, high = int(max_hours * HOUR), 1 - max_skim, 1 - min_skim
    hops = cut(edges.where("amt > 0"), "hops")
    front = hops.where((F.col("amt") >= min_amount) & (F.col("src") != F.col("dst"))).select(
        F.col("src").alias("origin"), F.col("dst").alias("cur"), "us", "amt",
        F.array("src", "dst").alias("path"),
        F.array(F.struct("us", "ref")).alias("hops"),
        F.array("amt").alias("amounts"),
    )
    found = []
    for depth in range(2, max_depth + 1):
        step = (
            _band_join(front, hops, span, low, high)
            .where((F.col("n_dst") == F.col("origin")) | ~F.array_contains("path", F.col("n_dst")))
            .select(
                "origin", F.col("n_dst").alias("cur"), F.col("n_us").alias("us"), F.col("n_amt").alias("amt"),
                F.concat("path", F.array("n_dst")).alias("path"),
                F.concat("hops", F.array(F.struct(F.col("n_us").alias("us"), F.col("n_ref").alias("ref")))).alias("hops"),
                F.concat("amounts", F.array("n_amt")).alias("amounts"),
                (F.col("n_dst") == F.col("origin")).alias("cycle"),
            )
        )
        step = cut(step, f"hop{depth}")
        found.append(step)
        front = step.where("not cycle").drop("cycle")
        if front.isEmpty():
            break
    paths = reduce(DataFrame.unionByName, found)
    if min_entities <= 2:
        two = hops.where((F.col("amt") >= min_amount) & (F.col("src") != F.col("dst"))).select(
            F.col("src").alias("origin"), F.col("dst").alias("cur"), "us", "amt",
            F.array("src", "dst").alias("path"), F.array(F.struct("us", "ref")).alias("hops"),
            F.array("amt").alias("amounts"), F.lit(False).alias("cycle"),
        )
        paths = paths.unionByName(two)
    return paths.where(F.size("path") >= min_entities).select("origin", "path", "hops", "amounts", "cycle")


def best_paths(paths: DataFrame) -> DataFrame:
    """The reported path of each origin: cycles first, then length, then first in time."""
    first = F.struct(
        (~F.col("cycle")).alias("c"), (-F.size("path")).alias("n"), F.col("hops").alias("h")
    )
    return (
        paths.groupBy("origin")
        .agg(F.min_by(F.struct("path", "hops", "amounts", "cycle"), first).alias("b"))
        .select("origin", "b.*")
    )


# A chain is ranked by its hops, and a cycle above any chain that is none.
_CYCLE = 1 << 16


def best_chains(
    edges: DataFrame,
    max_hours: float = 12,
    min_amount: float = 50_000.0,
    min_skim: float = 0.03,
    max_skim: float = 0.20,
    max_depth: int = 6,
    min_entities: int = 3,
) -> DataFrame:
    """The reported path of each origin, as ``best_paths(layering_paths(...))`` gives it, without listing paths.

    Transfers that may follow each other are joined once. From every origin the states (origin, transfer, depth) are
    reached forwards; backwards, each keeps the highest rank that a walk through it can have, and of such walks the
    earliest. Walks may visit an entity twice, so this is a bound; an origin whose best walk visits none twice has
    its answer, since nothing ranks higher and no path of this rank starts earlier. Only the other origins are
    searched with several paths for a state (``_exact_chains``). Rows are states and the transfers between them, however
    many paths there are.
    """
    span, low, high = int(max_hours * HOUR), 1 - max_skim, 1 - min_skim
    hops = cut(edges.where("amt > 0 and src <> dst").withColumn("e", F.monotonically_increasing_id()), "hops")
    fronts = hops.select("e", F.col("dst").alias("cur"), "us", "amt")
    hop = F.struct("us", "ref", "dst", "amt")
    links = _band_join(fronts, hops, span, low, high).select(
        "e", F.col("n_e").alias("f"), F.struct(*[F.col(f"n_{c}").alias(c) for c in ("us", "ref", "dst", "amt")]).alias("hop")
    )
    links = cut(links, "links")
    first = hops.where(F.col("amt") >= min_amount).select(F.col("src").alias("origin"), "e", hop.alias("hop"))
    # steps[d]: (origin, e, f, hop of f) from the states of depth d + 1 to those of depth d + 2
    steps: list[DataFrame] = []
    states = [first.select("origin", "e", F.col("hop.dst").alias("end"))]
    while len(states) < max_depth:
        step = cut(states[-1].where("end <> origin").drop("end").join(links, "e").select("origin", "e", "f", "hop"), "steps")
        if step.isEmpty():
            break
        steps.append(step)
        states.append(step.select("origin", F.col("f").alias("e"), F.col("hop.dst").alias("end")).distinct())
    tail = None
    for depth in range(len(states), 0, -1):
        walks = states[depth - 1].select("origin", "e", F.struct(
            (-_chain_rank(depth, F.col("end"), min_entities)).alias("low"), F.array().cast("array<struct<us:bigint,ref:bigint,dst:string,amt:double>>").alias("tail"),
        ).alias("walk")).where("walk.low is not null")
        if tail is not None:
            longer = F.struct(F.col("walk.low").alias("low"), F.concat(F.array("hop"), "walk.tail").alias("tail"))
            walks = walks.unionByName(
                steps[depth - 1].join(tail.withColumnRenamed("e", "f"), ["origin", "f"]).select("origin", "e", longer.alias("walk"))
            )
        tail = walks.groupBy("origin", "e").agg(F.min("walk").alias("walk"))
    best = first.join(tail, ["origin", "e"]).groupBy("origin").agg(
        F.min(F.struct(F.col("walk.low").alias("low"), F.concat(F.array("hop"), "walk.tail").alias("hops"))).alias("walk")
    )
    path = F.concat(F.array("origin"), F.col("walk.hops.dst"))
    best = best.select(
        "origin", path.alias("path"), F.transform("walk.hops", lambda h: F.struct(h["us"].alias("us"), h["ref"].alias("ref"))).alias("hops"),
        F.col("walk.hops.amt").alias("amounts"),
    )
    best = cut(best.withColumn("cycle", F.element_at("path", -1) == F.col("origin")), "chains")
    simple = F.size(F.array_distinct("path")) == F.size("path") - F.col("cycle").cast("int")
    unsettled = best.where(~simple).select("origin")
    if unsettled.isEmpty():
        return best
    exact = _exact_chains(cut(unsettled, "unsettled"), first, steps, max_depth, min_entities)
    return best.where(simple).unionByName(exact.withColumn("cycle", F.element_at("path", -1) == F.col("origin")))


def _chain_rank(depth: int, end: Column, min_entities: int) -> Column:
    """Rank of a path of ``depth`` transfers to ``end``; null if it has too few entities."""
    return F.when(F.lit(depth + 1 >= min_entities), F.when(end == F.col("origin"), _CYCLE).otherwise(0) + depth)


def _exact_chains(origins: DataFrame, first: DataFrame, steps: list[DataFrame], max_depth: int, min_entities: int) -> DataFrame:
    """Best simple path of each origin: (origin, path, hops, amounts).

    Of the paths into a state only representatives go on: a path is dropped if every continuation that it allows is
    allowed by an earlier one, too. A continuation has few entities, so a state keeps few paths.
    """
    at = lambda h: F.struct(h["us"].alias("us"), h["ref"].alias("ref"))
    front = first.join(origins, "origin").select(
        "origin", "e", F.array("origin", "hop.dst").alias("path"), F.array(at(F.col("hop"))).alias("hops"), F.array("hop.amt").alias("amounts")
    )
    best = None
    for depth in range(1, len(steps) + 2):
        if depth > 1:
            front = front.join(steps[depth - 2], ["origin", "e"]).where((F.col("hop.dst") == F.col("origin")) | ~F.array_contains("path", F.col("hop.dst")))
            front = front.select(
                "origin", F.col("f").alias("e"), F.concat("path", F.array("hop.dst")).alias("path"), F.concat("hops", F.array(at(F.col("hop")))).alias("hops"),
                F.concat("amounts", F.array("hop.amt")).alias("amounts"),
            )
        front = cut(front, "front")
        end = F.element_at("path", -1)
        ended = front.select("origin", "path", "hops", "amounts", _chain_rank(depth, end, min_entities).alias("rank")).where("rank is not null")
        ended = ended if best is None else ended.unionByName(best)
        order = F.struct(-F.col("rank"), "hops", "path")
        best = ended.groupBy("origin").agg(F.min_by(F.struct("path", "hops", "amounts", "rank"), order).alias("b")).select("origin", "b.*")
        best = cut(best, "best")
        front = _representatives(front.where(end != F.col("origin")), max_depth - depth)
    return best.drop("rank")


def spares(path: frozenset, kept: list[frozenset], entities: int) -> bool:
    """Whether some set of at most ``entities`` entities leaves ``path`` alone but touches all of ``kept``."""
    if not kept:
        return True
    if not entities:
        return False
    return any(spares(path, [k for k in kept if x not in k], entities - 1) for x in kept[0] - path)


def _representatives(paths: DataFrame, entities: int) -> DataFrame:
    """In order of time, the paths of each (origin, e) that some continuation of ``entities`` entities needs."""

    def run(batches):
        state, kept = None, []
        for b in batches:
            take = []
            for n, (origin, e, path) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if (origin, e) != state:
                    state, kept = (origin, e), []
                inner = frozenset(path)
                if spares(inner, kept, entities):
                    kept.append(inner)
                    take.append(n)
            yield b.take(take)

    return paths.repartition("origin", "e").sortWithinPartitions("origin", "e", "hops", "path").mapInArrow(run, paths.schema)


def hop_skims(amounts: Column) -> Column:
    """Percent lost at each hop."""
    n = F.size(amounts) - 1
    return F.zip_with(F.slice(amounts, 1, n), F.slice(amounts, 2, n), lambda a, b: (a - b) / a * 100)


def lay1(
    events: DataFrame,
    id_map: DataFrame,
    max_hours: float = 12,
    min_skim: float = 0.03,
    max_skim: float = 0.20,
    best: DataFrame | None = None,
    **limits,
) -> Found:
    """Layering or circular flow: the best path of each origin (``best`` if it is there already)."""
    if best is None:
        edges = transfer_edges(events, id_map)
        best = cut(best_chains(edges, max_hours=max_hours, min_skim=min_skim, max_skim=max_skim, **limits), "lay1")
    best = best.withColumnRenamed("origin", "entity_id")
    hours = (F.element_at("hops", -1)["us"] - F.element_at("hops", 1)["us"]) / HOUR
    skims = F.transform(hop_skims(F.col("amounts")), lambda s: F.format_string("%.1f", s))
    shape = F.when(
        F.col("cycle"),
        F.concat(
            F.lit("Money of "), "entity_id", F.lit(" came back to it in "), (F.size("path") - 1).cast("string"), F.lit(" hops"),
        ),
    ).otherwise(
        F.concat(
            F.lit("Money of "), "entity_id", F.lit(" went on through "), F.size("path").cast("string"),
            F.lit(f" entities within {max_hours:g} h"),
        )
    )
    text = F.concat(
        shape, F.lit(" in "), F.format_string("%.1f", hours), F.lit(" h: "), F.array_join("path", " > "), F.lit("; amounts "),
        F.array_join(F.transform("amounts", lambda a: F.format_string("%.0f", a)), ", "), F.lit("; kept per hop "),
        F.array_join(F.transform(skims, lambda s: F.concat(s, F.lit("%"))), ", "),
        F.lit(f" (a skim is {min_skim * 100:.0f} to {max_skim * 100:.0f}%)."),
    )
    rows = best.select(
        "entity_id", F.lit("LAY-1").alias("rule_id"), F.posexplode("hops").alias("pos", "h")
    ).select(
        "entity_id", "rule_id", F.col("h.us").alias("ord_us"), F.col("h.ref").alias("ord_ref"), "pos",
        row_token("row_", F.col("h.ref")).alias("token"),
    )
    facts = _tokens(
        best, "LAY-1", F.lit(None), F.lit(None),
        [
            F.concat(F.lit("cycle:"), F.when(F.col("cycle"), "true").otherwise("false")),
            F.concat(F.lit("hops:"), (F.size("path") - 1).cast("string")),
            F.concat(F.lit("skim_pct:"), F.array_join(skims, ",")),
            F.concat(F.lit("chain:"), F.array_join("path", ">")),
        ],
    )
    return Found(_firing(best, "LAY-1", "HIGH", text), rows.unionByName(facts))


# --------------------------------------------------------------------------- MUL-1

# Money is summed as whole ten-thousandths, so differences of running sums are exact.
UNIT = 10_000


def _units(amount: Column) -> Column:
    return F.round(F.abs(amount) * UNIT).cast("bigint")


def mule_credits(
    events: DataFrame,
    dormancy_days: float = 30,
    outflow_pct: float = 0.80,
    min_inflow: float = 100_000,
    micro: float = 10,
    outflow_hours: float = 6,
    min_txns: int = 3,
) -> DataFrame:
    """Large credits to a dormant account that leave again within hours.

    Dormancy needs only the first and last activity per entity and day, an
    aggregate that is small even for a hot entity. Outflow is a difference of
    running sums inside time slices.
    """
    txns = events.where("event_type = 'transaction' and us is not null").select(
        "entity_id", "us", "raw_row_ref", "amount"
    )
    dormancy = int(dormancy_days * DAY)
    unit = min(DAY, dormancy)
    days = (
        txns.groupBy("entity_id", F.floor(F.col("us") / unit).alias("_d"))
        .agg(
            F.min(F.when(F.abs("amount") > micro, F.col("us"))).alias("_first"),
            F.max(F.when(F.abs("amount") > micro, F.col("us"))).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    back = Window.partitionBy("entity_id").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("entity_id")
    days = days.select(
        "entity_id", "_d", "_first", F.max("_last").over(back).alias("_before"), F.sum("_n").over(whole).alias("_txns")
    )
    credits = txns.where(F.col("amount") >= min_inflow).withColumn("_d", F.floor(F.col("us") / unit))
    quiet = credits.join(days, ["entity_id", "_d"]).where(
        (F.col("_txns") >= min_txns)
        & ~F.coalesce(F.col("_first") < F.col("us"), F.lit(False))
        & ~F.coalesce(F.col("_before") >= F.col("us") - dormancy, F.lit(False))
    ).select("entity_id", "us", "raw_row_ref", "amount")

    span = int(outflow_hours * HOUR)
    length = 2 * span
    debits = into_slices(
        txns.where("amount < 0").select("entity_id", "us", _units(F.col("amount")).alias("_out")),
        F.col("us") - span,
        F.col("us"),
        length,
    )
    stacked = (
        quiet.withColumn("_slice", F.floor(F.col("us") / length))
        .withColumn("_side", F.lit(1))
        .unionByName(debits.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    )
    w = Window.partitionBy("entity_id", "_slice").orderBy("us")
    until = w.rangeBetween(Window.unboundedPreceding, span)
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    latest = F.max(F.when(F.col("_side") == 0, F.col("us"))).over(until)
    zero = F.lit(0)
    out = stacked.select(
        "*",
        (F.coalesce(F.sum("_out").over(until), zero) - F.coalesce(F.sum("_out").over(upto), zero)).alias("_units"),
        latest.alias("last_out_us"),
    ).where("_side = 1 and _units > 0")
    return out.select(
        "entity_id", "us", "raw_row_ref", "amount",
        (F.col("_units") / UNIT).alias("outflow"), "last_out_us",
    ).where(F.col("outflow") / F.col("amount") >= outflow_pct)


def mul1(events: DataFrame, dormancy_days: float = 30, outflow_hours: float = 6, **limits) -> Found:
    """Mule signature: the earliest such credit of each entity, with the debits that followed."""
    first = first_per_key(
        mule_credits(events, dormancy_days=dormancy_days, outflow_hours=outflow_hours, **limits),
        "entity_id", ["us", "raw_row_ref"],
    )
    first = cut(first, "mul1")
    retained = F.col("amount") - F.col("outflow")
    text = F.concat(
        F.lit("Quiet for "), F.lit(f"{dormancy_days:g}"), F.lit(" days, "), "entity_id", F.lit(" got "), _whole(F.col("amount")),
        F.lit(" and sent "), _whole(F.col("outflow")), F.lit(" on ("), _whole(F.col("outflow") / F.col("amount") * 100),
        F.lit("%) in "), F.format_string("%.1f", (F.col("last_out_us") - F.col("us")) / HOUR), F.lit(" h; "),
        _whole(retained), F.lit(" stayed."),
    )
    span = int(outflow_hours * HOUR)
    probe = first.select("entity_id", F.col("us").alias("c_us")).withColumn(
        "_t", F.explode(F.sequence(F.floor(F.col("c_us") / span), F.floor((F.col("c_us") + span) / span)))
    )
    outs = (
        events.where("event_type = 'transaction' and amount < 0")
        .select("entity_id", "us", "raw_row_ref", F.floor(F.col("us") / span).alias("_t"))
        .join(probe, ["entity_id", "_t"])
        .where((F.col("us") > F.col("c_us")) & (F.col("us") <= F.col("c_us") + span))
    )
    tokens = (
        _tokens(first, "MUL-1", F.col("us"), F.col("raw_row_ref"), [row_token("row_", F.col("raw_row_ref"))])
        .unionByName(_tokens(outs, "MUL-1", F.col("us"), F.col("raw_row_ref"), [row_token("row_", F.col("raw_row_ref"))]))
        .unionByName(
            _tokens(
                first, "MUL-1", F.lit(None), F.lit(None),
                [
                    F.concat(F.lit("inflow:"), _whole(F.col("amount"))),
                    F.concat(F.lit("outflow:"), _whole(F.col("outflow"))),
                    F.concat(F.lit("retained:"), _whole(retained)),
                    F.lit("prior_txns_in_dormancy:0"),
                ],
            )
        )
    )
    return Found(_firing(first, "MUL-1", "HIGH", text), tokens)


# --------------------------------------------------------------------------- LOC-1


def travel_legs(placed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distance and speed between consecutive placed events of each entity.

    ``placed`` has entity_id, us, raw_row_ref, event_type and place struct<lat,lon,label>.
    """
    d = placed.where("place is not null and us is not null").select(
        "entity_id", "us", "raw_row_ref", "event_type", "place"
    )
    legs = last_before(
        d, "entity_id", ["us", "raw_row_ref"],
        {"prev": F.struct("us", "raw_row_ref", "event_type", "place")}, min_rows=hot_rows,
    ).where("prev is not null")
    a, b = F.col("prev.place"), F.col("place")
    km = distance_km(a["lat"], a["lon"], b["lat"], b["lon"])
    secs = (F.col("us") - F.col("prev.us")) / 1_000_000
    return legs.withColumn("distance_km", km).withColumn("secs", secs).withColumn(
        "speed_kmh", F.col("distance_km") / F.greatest(F.col("secs") / 3600.0, F.lit(0.00028))
    )


def impossible_legs(placed: DataFrame, max_speed_kmh: float = 200.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    return travel_legs(placed, hot_rows).where(
        (F.col("distance_km") >= 1.0) & (F.col("speed_kmh") > max_speed_kmh)
    )


def loc1(placed: DataFrame, max_speed_kmh: float = 200.0, hot_rows: int = HOT_ROWS) -> Found:
    """Impossible travel: the first leg of each entity faster than the limit."""
    first = first_per_key(
        impossible_legs(placed, max_speed_kmh, hot_rows), "entity_id", ["us", "raw_row_ref"]
    )
    first = cut(first, "loc1")
    mins = F.col("secs") / 60.0
    one = lambda c: F.format_string("%.1f", c)
    text = F.concat(
        "entity_id", F.lit(" was at "), "prev.place.label", F.lit(" ("), "prev.event_type", F.lit(") and "), one(mins),
        F.lit(" min later at "), "place.label", F.lit(" ("), "event_type", F.lit("), "), one(F.col("distance_km")),
        F.lit(" km away: "), one(F.col("speed_kmh")), F.lit(f" km/h, more than {max_speed_kmh:.0f}."),
    )
    tokens = _tokens(
        first, "LOC-1", F.col("us"), F.col("raw_row_ref"),
        [
            row_token("row_", F.col("prev.raw_row_ref")),
            row_token("row_", F.col("raw_row_ref")),
            F.concat(F.lit("distance_km:"), one(F.col("distance_km"))),
            F.concat(F.lit("speed_kmh:"), one(F.col("speed_kmh"))),
            F.concat(F.lit("time_mins:"), one(mins)),
        ],
    )
    return Found(_firing(first, "LOC-1", "HIGH", text), tokens)


# ----------------------------------------------------------------------------- all


def run_rules(
    events: DataFrame,
    identifiers: DataFrame,
    enriched: DataFrame,
    placed: DataFrame,
    id_map: DataFrame,
    window_minutes: float = 15,
    limits: dict[str, dict] | None = None,
) -> Found:
    """All seven rules; ``limits`` holds keyword overrides per rule id."""
    k = limits or {}
    # Each rule writes its hits; the rules do not depend on each other.
    found = at_once(
        lambda: idr1(events, identifiers, **k.get("IDR-1", {})),
        lambda: tcs1(enriched),
        lambda: tcs2(events, id_map, **{"window_minutes": window_minutes, **k.get("TCS-2", {})}),
        lambda: str1(events, **k.get("STR-1", {})),
        lambda: lay1(events, id_map, **k.get("LAY-1", {})),
        lambda: mul1(events, **k.get("MUL-1", {})),
        lambda: loc1(placed, **k.get("LOC-1", {})),
    )
    return Found(
        reduce(DataFrame.unionByName, [f.firings for f in found]),
        reduce(DataFrame.unionByName, [f.evidence for f in found]),
    )


def rule_summary(firings: DataFrame) -> DataFrame:
    """Firings and entities per rule, and over all rules."""
    per = firings.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("firings"), F.count_distinct("entity_id").alias("entities")
    )
    every = firings.agg(
        F.lit("ALL").alias("rule_id"), F.count(F.lit(1)).alias("firings"),
        F.count_distinct("entity_id").alias("entities"),
    )
    return per.unionByName(every)
