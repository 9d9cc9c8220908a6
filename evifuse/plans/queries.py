"""Registered queries over the given tables, each with its SQL definition where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.functions import fields as ff
from evifuse.operators import graph, places, reports, resolution, rules, scoring, temporal, verification
from evifuse.operators.keyed import HOUR, MINUTE
from evifuse.plans import casework as cw
from evifuse.plans.oracles import CTE, header_oracle, inst, sql  # noqa: F401
from evifuse.session import cut, work_dir
from evifuse.sources import audit, statements
from evifuse.sources.reference import kyc_rows, place_events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = sql(oracle)
        return fn

    return add


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def r4(name: str, alias: str | None = None):
    return F.round(F.col(name).cast("double"), 4).alias(alias or name)


def _ref(name: str, alias: str | None = None):
    """Row reference as reports print it."""
    return F.coalesce(F.col(name).cast("string"), F.lit("N/A")).alias(alias or name.split(".")[-1])


def joined(name: str, alias: str | None = None):
    return F.array_join(name, ",").alias(alias or name)


# ------------------------------------------------------------------------- fields


@query("SELECT o_orderkey, utr, counterparty, channel FROM narx")
def narration_extract(spark, sf):
    utr, party, channel = ff.narration_parts(F.col("narration"))
    return cw.narrations(spark, sf).select(
        "o_orderkey", utr.alias("utr"), party.alias("counterparty"), channel.alias("channel")
    )


@query("SELECT o_orderkey, coalesce(us, -1) AS us, round(abs(amount), 4) AS amount FROM stm")
def amount_date_parse(spark, sf):
    amount = F.greatest(ff.money(F.col("Debit")), ff.money(F.col("Credit")))
    return cw.statement_rows(spark, sf).select(
        F.col("raw_row_ref").alias("o_orderkey"), F.coalesce(ff.micros(ff.moment(F.col("Txn Date"))), F.lit(-1)).alias("us"), F.round(amount, 4).alias("amount")
    )


_IDENT = (
    "case c_custkey % 8 when 0 then concat('9', lpad({c}, 9, '0')) when 1 then concat('ACCT_', c_custkey) "
    "when 2 then concat('acc-', c_custkey) when 3 then concat('u', c_custkey, '@bank') "
    "when 4 then concat('35', lpad({c}, 13, '0')) when 5 then concat('10.0.', c_custkey % 200, '.7') "
    "when 6 then concat('12', lpad({c}, 13, '0')) else concat('12', lpad({c}, 10, '0')) end"
)


@query(
    f"SELECT identifier, CASE WHEN regexp_full_match(identifier, '[6-9][0-9]{{9}}') THEN 'phone' "
    "WHEN starts_with(identifier, 'ACCT_') OR regexp_matches(identifier, '(?i)^acc[_-]') THEN 'account' WHEN contains(identifier, '@') THEN 'vpa' "
    "WHEN regexp_full_match(identifier, '3[5-9][0-9]{13}') THEN 'imei' WHEN regexp_full_match(identifier, '[0-9]{1,3}([.][0-9]{1,3}){3}') THEN 'ip' "
    "WHEN regexp_full_match(identifier, '[0-9]{15}') THEN 'imei' WHEN regexp_full_match(identifier, '[0-9]{10,}') THEN 'phone' ELSE 'account' END AS id_type "
    f"FROM (SELECT {_IDENT.format(c='CAST(c_custkey AS VARCHAR)')} AS identifier FROM customer)"
)
def identifier_classify(spark, sf):
    d = cw.table(spark, sf, "customer").select(F.expr(_IDENT.format(c="string(c_custkey)")).alias("identifier"))
    return d.select("identifier", ff.identifier_type(F.col("identifier")).alias("id_type"))


@query(
    "SELECT institution, count(*) AS files, sum(o_orderkey)::BIGINT AS key_sum FROM (SELECT o_orderkey, "
    + inst("(['SBI','my_hdfc','icici_','CDR','ipdr','bank','other'][o_orderkey % 7 + 1])")
    + " AS institution FROM orders) GROUP BY 1"
)
def institution_map(spark, sf):
    names = F.expr("element_at(array('SBI', 'my_hdfc', 'icici_', 'CDR', 'ipdr', 'bank', 'other'), int(o_orderkey % 7) + 1)")
    d = cw.table(spark, sf, "orders").select("o_orderkey", ff.institution(names).alias("institution"))
    return d.groupBy("institution").agg(F.count(F.lit(1)).alias("files"), F.sum("o_orderkey").alias("key_sum"))


@query(
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 6 THEN NULL ELSE o_orderpriority END AS cleaned FROM orders"
)
def nullish_clean(spark, sf):
    d = F.expr(
        "case when o_orderkey % 9 < 6 then element_at(array('nan', ' NONE ', '', 'null', 'NaT', '<NA>'), int(o_orderkey % 9) + 1) "
        "else concat(' ', o_orderpriority, '  ') end"
    )
    return cw.table(spark, sf, "orders").select("o_orderkey", ff.present(d).alias("cleaned"))


@query(
    "SELECT l_orderkey, count(*) AS rows, count(*) FILTER (l_linenumber = 1 AND l_orderkey % 3 = 0) AS headers FROM lineitem GROUP BY 1"
)
def repeated_header_filter(spark, sf):
    head = F.array(*[F.lit(x) for x in ("Order", "Part", "Qty", "Price")])
    cells = F.when(
        (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 3 == 0),
        F.array(F.lit(" order"), F.lit("PART "), F.lit("Qty"), F.lit("")),
    ).otherwise(F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")]))
    d = cw.table(spark, sf, "lineitem").select("l_orderkey", ff.repeats_header(cells, head).alias("h"))
    return d.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if("h").alias("headers"))


def _statement(spark, sf):
    return statements.normalise_bank(cw.statement_rows(spark, sf), cw.STATEMENT_FIELDS)


@query(
    "SELECT o_orderkey AS raw_row_ref, entity_ref, us, round(amount, 4) AS amount, counterparty, utr, channel, source_file FROM stmr WHERE reject_reason IS NULL"
)
def bank_normalise(spark, sf):
    d = _statement(spark, sf).where("reject_reason is null")
    return d.select(
        "raw_row_ref", "entity_ref", ff.micros(F.col("timestamp")).alias("us"), r4("amount"), "counterparty", "utr", "channel", "source_file"
    )


@query(
    "SELECT source_file, count(*) AS total_rows, count(*) FILTER (reject_reason IS NULL) AS parsed_rows, count(reject_reason) AS skipped_rows, "
    "count(*) FILTER (reject_reason = 'unparseable_date') AS unparseable_date, count(*) FILTER (reject_reason = 'missing_or_zero_amount') AS missing_or_zero_amount "
    "FROM stmr GROUP BY 1"
)
def row_accounting(spark, sf):
    return statements.row_accounting(_statement(spark, sf)).drop("column_count_mismatch", "no_date_column")


@query(
    "SELECT event_id AS raw_row_ref, 'P' || u AS entity_ref, CASE WHEN et = 'error' THEN 'sms' ELSE 'call' END AS event_type, "
    f"(us // 1000000) * 1000000 AS us, (us // 1000000 + k) * 1000000 AS end_us, 'Q' || k AS counterparty FROM ev0 WHERE et IN ('click','error')"
)
def cdr_normalise(spark, sf):
    e = cw.table(spark, sf, "events").where("event_type in ('click', 'error')").withColumn("k", F.get_json_object("props", "$.k"))
    raw = e.select(
        F.concat(F.lit("P"), "user_id").alias("A_PARTY"), F.concat(F.lit(" Q"), "k").alias("B_PARTY"),
        F.expr("if(event_type = 'error', 'sms', 'moc')").alias("CALL_TYPE"), F.date_format("ts", "dd-MM-yyyy").alias("DATE"),
        F.date_format("ts", "HH:mm:ss").alias("TIME"), F.col("k").alias("DURATION_SEC"), F.lit("cdr.csv").alias("source_file"),
        F.col("event_id").alias("raw_row_ref"),
    )
    got = statements.normalise_cdr(raw, statements.header_fields(raw.columns))
    return got.where("reject_reason is null").select(
        "raw_row_ref", "entity_ref", "event_type", ff.micros(F.col("timestamp")).alias("us"),
        ff.micros(F.col("end_timestamp")).alias("end_us"), "counterparty",
    )


@query(
    "SELECT event_id AS raw_row_ref, CASE WHEN k % 10 = 0 THEN '103.' || (21 + k % 8) || '.1.' || (u % 250) ELSE 'P' || u END AS entity_ref, "
    "(us // 1000000) * 1000000 AS us, ['Mumbai','Delhi','Bangalore','Ahmedabad','Surat','Pune','Hyderabad','Chennai'][k % 8 + 1] AS location, "
    "'10.0.0.' || k AS counterparty, CAST(k AS BIGINT) AS port FROM ev0 WHERE et = 'view'"
)
def ipdr_normalise(spark, sf):
    e = cw.table(spark, sf, "events").where("event_type = 'view'").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    raw = e.select(
        F.expr("if(k % 10 = 0, 'nan', concat('P', user_id))").alias("MSISDN"),
        F.expr("concat('103.', 21 + k % 8, '.1.', user_id % 250)").alias("PUBLIC_IP"), F.lit("10.1.1.1").alias("PRIVATE_IP"),
        F.expr("concat('10.0.0.', k)").alias("DEST_IP"), F.col("k").cast("string").alias("PORT"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("SESSION_START"), F.lit("ipdr.csv").alias("source_file"),
        F.col("event_id").alias("raw_row_ref"),
    )
    got = statements.normalise_ipdr(raw, statements.header_fields(raw.columns))
    return got.where("reject_reason is null").select(
        "raw_row_ref", "entity_ref", ff.micros(F.col("timestamp")).alias("us"), "location", "counterparty", F.col("_port").cast("bigint").alias("port")
    )


@query(header_oracle())
def header_type_detect(spark, sf):
    texts = sorted({t for ts in statements.HEADERS.values() for t in ts})
    at = (F.col("o_orderkey") * 7 % len(texts)).cast("int") + 1
    cells = cw.table(spark, sf, "orders").select(
        F.concat(F.lit("file_"), "o_custkey").alias("file"), F.element_at(F.array(*[F.lit(t) for t in texts]), at).alias("column")
    )
    return statements.detect_types(cells).withColumn("confidence", F.round("confidence", 4))


# ------------------------------------------------------------------------- in time


@query("SELECT raw_row_ref, entity_id, coalesce(CAST(call_ref AS VARCHAR), 'N/A') AS call_row_ref, call_cp AS call_counterparty, call_loc AS call_location, call_imei FROM enr")
def asof_nearest_call(spark, sf):
    return cw.enriched(spark, sf).select("raw_row_ref", "entity_id", _ref("call_row_ref"), "call_counterparty", "call_location", "call_imei")


@query("SELECT raw_row_ref, entity_id, coalesce(CAST(session_ref AS VARCHAR), 'N/A') AS session_row_ref, session_cp AS session_dest_ip, session_loc AS session_location FROM enr")
def asof_nearest_session(spark, sf):
    return cw.enriched(spark, sf).select("raw_row_ref", "entity_id", _ref("session_row_ref"), "session_dest_ip", "session_location")


@query("SELECT raw_row_ref, has_call AS has_call_correlation, has_session AS has_session_correlation, has_call AND has_session AS has_both_correlation FROM enr")
def correlation_flags(spark, sf):
    return cw.enriched(spark, sf).select("raw_row_ref", "has_call_correlation", "has_session_correlation", "has_both_correlation")


@query(
    f"SELECT t.raw_row_ref, t.entity_id, coalesce(CAST(arg_max(s.raw_row_ref, (s.end_us, s.raw_row_ref)) AS VARCHAR), 'N/A') AS session_row_ref, coalesce(max(s.end_us), -1) AS session_end_us "
    f"FROM (SELECT * FROM ev WHERE event_type = 'transaction') t LEFT JOIN (SELECT * FROM ev WHERE event_type = 'ip_session') s "
    f"ON s.entity_id = t.entity_id AND s.us <= t.us + {10 * MINUTE} AND s.end_us >= t.us - {10 * MINUTE} GROUP BY 1, 2"
)
def session_overlap(spark, sf):
    e = cw.events(spark, sf)
    d = temporal.overlapping_session(e.where("event_type = 'transaction'"), e, 10 * MINUTE)
    return d.select("raw_row_ref", "entity_id", _ref("_session.raw_row_ref", "session_row_ref"), F.coalesce("_session.end_us", F.lit(-1)).alias("session_end_us"))


@query("SELECT entity_id, raw_row_ref, party, payee, link, n_calls, first_us AS first_call_us, last_us AS last_call_us FROM tcs2")
def call_before_transfer(spark, sf):
    d = rules.call_then_transfer(cw.stored(spark, sf), cw.id_map(spark, sf), 1440)
    return d.select("entity_id", "raw_row_ref", "party", "payee", "link", "n_calls", "first_call_us", "last_call_us")


@query(
    "SELECT raw_row_ref, row_number() OVER (PARTITION BY entity_id ORDER BY us, raw_row_ref) AS pos, entity_id, "
    "CASE WHEN event_type IN ('call','sms') THEN 'call' ELSE event_type END AS lane, CASE WHEN event_type = 'transaction' THEN CASE WHEN amount >= 0 THEN 'credit' ELSE 'debit' END END AS direction, "
    "CASE WHEN event_type = 'transaction' THEN NULL WHEN event_type = 'ip_session' THEN 'SESSION' ELSE upper(event_type) END AS text, round(abs(amount), 4) AS amount, "
    "raw_row_ref IN (SELECT r FROM (SELECT raw_row_ref AS r FROM str1 UNION SELECT r2 FROM str1 UNION SELECT r3 FROM str1)) AS cited FROM ev"
)
def timeline(spark, sf):
    e = cw.events(spark, sf)
    cited = reports.cited_rows(rules.str1(e, **cw.LIMITS["STR-1"]).evidence)
    d = temporal.timeline_rows(e, cited)
    return d.select(
        "raw_row_ref", "pos", "entity_id", "lane", "direction",
        F.when(F.col("lane") != "transaction", F.col("label")).alias("text"), r4("amount"), "cited",
    )


@query(
    "SELECT entity_id, count(*) AS total_events, count(*) FILTER (event_type = 'transaction') AS transactions, count(*) FILTER (event_type IN ('call','sms')) AS calls, "
    "count(*) FILTER (event_type = 'ip_session') AS sessions, min(us) AS start_us, max(us) AS end_us, count(*) > 1500 AS truncated FROM ev GROUP BY 1"
)
def timeline_totals(spark, sf):
    return temporal.timeline_totals(cw.events(spark, sf))


_BANDS = (
    "SELECT entity_id, CASE WHEN has_call AND has_session THEN 'tcs1' WHEN has_call THEN 'call' ELSE 'session' END AS kind, "
    f"us - {240 * MINUTE} AS start_us, us + {240 * MINUTE} AS end_us, us AS centre_us, round(abs(amount), 4) AS amount, raw_row_ref, coalesce(CAST(call_ref AS VARCHAR), 'N/A') AS call_row_ref, coalesce(CAST(session_ref AS VARCHAR), 'N/A') AS session_row_ref "
    "FROM enr WHERE has_call OR has_session"
)


@query(_BANDS)
def timeline_bands(spark, sf):
    d = temporal.correlation_bands(cw.enriched(spark, sf), cw.WINDOW)
    return d.withColumns({"amount": F.round("amount", 4), "call_row_ref": _ref("call_row_ref"), "session_row_ref": _ref("session_row_ref")})


@query(
    f"SELECT entity_id, kind, start_us, end_us, centre_us, amount, raw_row_ref FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY kind = 'tcs1' DESC, amount DESC, centre_us, raw_row_ref) AS rn FROM ({_BANDS})) WHERE rn = 1"
)
def focus_band(spark, sf):
    d = temporal.focus_bands(temporal.correlation_bands(cw.enriched(spark, sf), cw.WINDOW))
    return d.select("entity_id", "kind", "start_us", "end_us", "centre_us", r4("amount"), "raw_row_ref")


@query(
    "SELECT t.raw_row_ref, t.us, count(c.raw_row_ref) > 0 AS has_call_correlation FROM (SELECT * FROM ev WHERE event_type = 'transaction') t "
    f"LEFT JOIN (SELECT * FROM ev WHERE event_type IN ('call','sms')) c ON c.entity_id = t.entity_id AND c.us BETWEEN t.us - {1440 * MINUTE} AND t.us + {1440 * MINUTE} GROUP BY 1, 2"
)
def whatif_window(spark, sf):
    """All entities at a day's window; asking for more is clamped to a day."""
    return temporal.what_if(cw.events(spark, sf), None, 99_999).select("raw_row_ref", "us", "has_call_correlation")


@query("SELECT entity_id, raw_row_ref, us, event_type FROM ev")
def unified_timeline(spark, sf):
    return temporal.unified_timeline(cw.events(spark, sf)).select("entity_id", "raw_row_ref", "us", "event_type")


# --------------------------------------------------------------------------- rules


@query("SELECT entity_id, imei, msisdn, first_row_ref, msisdn_count FROM fan")
def idr_device_fanout(spark, sf):
    return rules.device_fanout(cw.events(spark, sf))


@query("SELECT entity_id, count(DISTINCT identifier) AS n FROM mem WHERE id_type = 'account' GROUP BY 1 HAVING count(DISTINCT identifier) >= 3")
def idr_account_fanout(spark, sf):
    return rules.identifier_fanout(cw.members(spark, sf), "account", 3)


@query("SELECT entity_id, count(DISTINCT identifier) AS n FROM mem WHERE id_type = 'imei' GROUP BY 1 HAVING count(DISTINCT identifier) >= 2")
def idr_device_multiplicity(spark, sf):
    return rules.identifier_fanout(cw.members(spark, sf), "imei", 2)


@query(
    "SELECT entity_id, number, us, raw_row_ref, prev_us, prev_ref AS prev_row_ref, old_imei, imei AS new_imei, old_imsi, imsi AS new_imsi, dev AS device_changed, sim AS sim_changed, nearby AS nearby_txn, severity FROM swaps"
)
def idr_swap(spark, sf):
    return rules.identifier_swaps(cw.events(spark, sf))


@query("SELECT entity_id, number, us, raw_row_ref, severity FROM swap1")
def idr_first_swap(spark, sf):
    return rules.first_swaps(rules.identifier_swaps(cw.events(spark, sf))).select("entity_id", "number", "us", "raw_row_ref", "severity")


@query("SELECT entity_id, severity FROM idr")
def idr_combined(spark, sf):
    return rules.idr1(cw.stored(spark, sf), cw.members(spark, sf)).firings.select("entity_id", "severity")


@query(
    "SELECT entity_id, unnest(['bank_row_' || raw_row_ref, 'cdr_row_' || call_ref, 'ipdr_row_' || session_ref]) AS token FROM enr WHERE has_call AND has_session"
)
def tcs1(spark, sf):
    return rules.tcs1(cw.enriched(spark, sf)).evidence.select("entity_id", "token")


@query("SELECT entity_id, sum(n_calls)::BIGINT AS instances FROM tcs2 WHERE link = 'resolved' GROUP BY 1")
def tcs2_resolved(spark, sf):
    d = rules.call_then_transfer(cw.stored(spark, sf), cw.id_map(spark, sf), 1440).where("link = 'resolved'")
    return d.groupBy("entity_id").agg(F.sum("n_calls").alias("instances"))


@query(
    f"SELECT t.entity_id, t.raw_row_ref, c.counterparty AS party, count(*) AS n_calls FROM (SELECT * FROM ev WHERE event_type = 'transaction') t "
    f"JOIN (SELECT * FROM ev WHERE event_type IN ('call','sms')) c ON c.entity_id = t.entity_id AND c.us BETWEEN t.us - {1440 * MINUTE} AND t.us - {MINUTE} "
    "AND contains(regexp_replace(t.counterparty, '[^0-9]', '', 'g'), c.counterparty) GROUP BY ALL"
)
def tcs2_embedded(spark, sf):
    """Without an owner map only numbers inside the payee can link a call."""
    none = cw.id_map(spark, sf).where("identifier is null")
    d = rules.call_then_transfer(cw.stored(spark, sf), none, 1440)
    return d.select("entity_id", "raw_row_ref", "party", "n_calls")


@query("SELECT entity_id, us, raw_row_ref, last_us FROM strw")
def structuring(spark, sf):
    d = rules.structuring_windows(cw.events(spark, sf), **cw.LIMITS["STR-1"])
    return d.select("entity_id", "us", "raw_row_ref", "last_us")


@query("SELECT entity_id, 'row_' || unnest([raw_row_ref, r2, r3]) AS token FROM str1")
def str1_evidence(spark, sf):
    return rules.str1(cw.events(spark, sf), **cw.LIMITS["STR-1"]).evidence.select("entity_id", "token")


@query("SELECT entity_id, us, raw_row_ref, round(amount, 4) AS amount, round(outflow, 4) AS outflow, last_us AS last_out_us FROM mulc")
def mule(spark, sf):
    d = rules.mule_credits(cw.events(spark, sf), **cw.LIMITS["MUL-1"])
    return d.select("entity_id", "us", "raw_row_ref", r4("amount"), r4("outflow"), "last_out_us")


@query(
    f"SELECT m.entity_id, 'row_' || m.raw_row_ref AS token FROM mul1 m UNION ALL SELECT m.entity_id, 'row_' || d.raw_row_ref FROM mul1 m "
    f"JOIN (SELECT * FROM ev WHERE event_type = 'transaction' AND amount < 0) d ON d.entity_id = m.entity_id AND d.us > m.us AND d.us <= m.us + {6 * HOUR}"
)
def mul1_evidence(spark, sf):
    d = rules.mul1(cw.events(spark, sf), **cw.LIMITS["MUL-1"]).evidence
    return d.where("token like 'row_%'").select("entity_id", "token")


@query("SELECT raw_row_ref, lat, lon, label FROM place")
def event_geocode(spark, sf):
    return place_events(cw.events(spark, sf)).select("raw_row_ref", "place.lat", "place.lon", "place.label")


@query("SELECT entity_id, raw_row_ref, pref AS prev_row_ref, round(km, 3) AS distance_km, round(kmh, 2) AS speed_kmh FROM legs WHERE km >= 1 AND kmh > 3000")
def geo_speed(spark, sf):
    d = rules.impossible_legs(place_events(cw.events(spark, sf)), 3000.0)
    return d.select(
        "entity_id", "raw_row_ref", F.col("prev.raw_row_ref").alias("prev_row_ref"), F.round("distance_km", 3).alias("distance_km"), F.round("speed_kmh", 2).alias("speed_kmh")
    )


_CHAIN = "origin, array_to_string(path, '>') AS chain, array_to_string(refs, '>') AS refs, cycle"


@query(f"SELECT {_CHAIN} FROM chains")
def layering_chains(spark, sf):
    return cw.layering(spark, sf).select("origin", F.array_join("path", ">").alias("chain"), F.array_join(F.col("hops.ref").cast("array<string>"), ">").alias("refs"), "cycle")


@query(
    f"SELECT {_CHAIN}, CAST(len(path) - 1 AS BIGINT) AS n_hops, round((amts[1] - amts[2]) / amts[1] * 100, 4) AS first_skim FROM best"
)
def layering_best(spark, sf):
    d = cw.best_chains(spark, sf)
    return d.select(
        "origin", F.array_join("path", ">").alias("chain"), F.array_join(F.col("hops.ref").cast("array<string>"), ">").alias("refs"), "cycle",
        (F.size("path") - 1).cast("bigint").alias("n_hops"), F.round(rules.hop_skims(F.col("amounts"))[0], 4).alias("first_skim"),
    )


@query("SELECT src, dst FROM chop")
def layering_hops(spark, sf):
    return graph.chain_hops(cw.best_chains(spark, sf))


@query("SELECT array_to_string(path, '>') AS chain, min(origin) AS detected_on FROM best GROUP BY path")
def layering_distinct(spark, sf):
    return graph.distinct_chains(cw.best_chains(spark, sf)).select(F.array_join("path", ">").alias("chain"), "detected_on")


@query("SELECT entity_id, rule_id, severity FROM fir")
def rule_firings(spark, sf):
    return cw.firings(spark, sf).select("entity_id", "rule_id", "severity")


@query(
    "SELECT rule_id, count(*) AS firings, count(DISTINCT entity_id) AS entities FROM fir GROUP BY 1 UNION ALL SELECT 'ALL', count(*), count(DISTINCT entity_id) FROM fir"
)
def rule_summary(spark, sf):
    return rules.rule_summary(cw.firings(spark, sf))


# ------------------------------------------------------------------------- scoring


@query("SELECT entity_id, risk_tier, n_rules, rules FROM sco")
def risk_tier(spark, sf):
    return cw.scored(spark, sf).select("entity_id", "risk_tier", "n_rules", joined("rules_fired", "rules"))


@query("SELECT risk_tier, count(*) AS entities, 0::BIGINT AS ml_flagged FROM sco GROUP BY 1")
def tier_distribution(spark, sf):
    return scoring.tier_distribution(cw.scored(spark, sf))


_U = "CAST(round({} * 10000) AS BIGINT)"


@query(
    f"SELECT entity_id, round(CASE WHEN n > 1 THEN n / greatest(span / {24 * HOUR}.0, 1.0) ELSE n END, 6) AS txn_velocity, "
    f"round(CASE WHEN n > 1 THEN span / {HOUR}.0 / (n - 1) ELSE 0.0 END, 6) AS avg_hold_hours, "
    "round(CASE WHEN n > 0 THEN coalesce(i, 0) / 10000.0 / greatest(coalesce(o, 0) / 10000.0, 1.0) ELSE 1.0 END, 6) AS in_out_ratio, CAST(cps AS DOUBLE) AS unique_counterparties, "
    f"round(CASE WHEN r > 1 THEN comms / greatest(aspan / {24 * HOUR}.0, 1.0) ELSE comms END, 6) AS comms_per_day FROM (SELECT entity_id, count(*) FILTER (event_type = 'transaction') AS n, "
    "max(us) FILTER (event_type = 'transaction') - min(us) FILTER (event_type = 'transaction') AS span, "
    f"sum({_U.format('amount')}) FILTER (amount > 0) AS i, sum({_U.format('-amount')}) FILTER (amount < 0) AS o, "
    "count(DISTINCT counterparty) FILTER (event_type = 'transaction') AS cps, count(*) FILTER (event_type <> 'transaction') AS comms, count(*) AS r, max(us) - min(us) AS aspan FROM ev GROUP BY 1)"
)
def ml_features(spark, sf):
    d = scoring.entity_features(cw.events(spark, sf))
    return d.select("entity_id", *[F.round(F.col(c), 6).alias(c) for c in scoring.FEATURES])


@query()
def iforest_flags(spark, sf):
    return scoring.isolation_flags(scoring.entity_features(cw.events(spark, sf))).select(
        "entity_id", F.round("score", 6).alias("score"), "ml_anomaly"
    )


# ---------------------------------------------------------------------- resolution


def _kyc(spark, sf):
    e = cw.stored(spark, sf)
    return cw._once(spark, sf, "kyc", lambda: resolution.kyc_from_events(
        e.where("event_type = 'transaction'"), e.where("event_type in ('call', 'sms')"), e.where("event_type = 'ip_session'")
    ))


def _nodes(spark, sf):
    return cw._once(spark, sf, "identity-nodes", lambda: resolution.identity_nodes(_kyc(spark, sf), cw.stored(spark, sf)))


def _assigned(spark, sf):
    return cw._once(spark, sf, "assigned", lambda: resolution.assign_entities(_nodes(spark, sf), resolution.ownership_edges(_kyc(spark, sf))))


def _validated(spark, sf):
    return cw._once(spark, sf, "validated", lambda: resolution.validate_entities(_assigned(spark, sf), _kyc(spark, sf)))


@query("SELECT entry, id_type, identifier FROM kyc")
def kyc_from_events(spark, sf):
    return _kyc(spark, sf).select("entry", "id_type", "identifier")


_KYC_NAME = "'Name ' || (c_custkey // 4)"


@query(
    f"SELECT 'K' || c_custkey AS entry, {_KYC_NAME} AS name, x.id_type, x.identifier FROM (SELECT *, unnest([{{'id_type': 'phone', 'identifier': '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')}}, "
    "{'id_type': 'account', 'identifier': 'ACC' || c_custkey}, {'id_type': 'vpa', 'identifier': 'c' || c_custkey || '@bank'}]) AS x FROM customer WHERE c_custkey % 2 = 0) "
    f"UNION ALL SELECT {_KYC_NAME}, {_KYC_NAME}, 'phone', '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer WHERE c_custkey % 2 = 1"
)
def kyc_json(spark, sf):
    """Customers as ownership documents: even keys as records, odd ones as flat pairs."""
    c = cw.table(spark, sf, "customer")
    phone = F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    name = F.concat(F.lit("Name "), F.expr("c_custkey div 4"))
    record = F.to_json(
        F.create_map(
            F.concat(F.lit("K"), "c_custkey"),
            F.struct(
                name.alias("name"), F.array(phone).alias("phones"), F.array(F.concat(F.lit("ACC"), "c_custkey")).alias("accounts"),
                F.array(F.concat(F.lit("c"), "c_custkey", F.lit("@bank"))).alias("vpas"),
            ),
        )
    )
    flat = F.to_json(F.create_map(phone, name))
    return kyc_rows(c.select(F.when(F.col("c_custkey") % 2 == 0, record).otherwise(flat).alias("value")))


@query("SELECT identifier, id_type FROM nod")
def id_nodes(spark, sf):
    return _nodes(spark, sf)


@query("SELECT src, dst FROM own")
def ownership_edges(spark, sf):
    return resolution.ownership_edges(_kyc(spark, sf)).select("src", "dst")


@query("SELECT identifier, component FROM cmp")
def components(spark, sf):
    return resolution.components(resolution.ownership_edges(_kyc(spark, sf)))


@query(
    "SELECT entity_id, count(*) FILTER (id_type = 'phone') AS n_phones, count(*) FILTER (id_type = 'account') AS n_accounts, count(*) FILTER (id_type = 'imei') AS n_imeis, "
    "coalesce('Phone ' || min(identifier) FILTER (id_type = 'phone'), 'Acct ' || min(identifier) FILTER (id_type = 'account'), 'VPA ' || min(identifier) FILTER (id_type = 'vpa'), "
    "'IP ' || min(identifier) FILTER (id_type = 'ip'), entity_id) AS name FROM asg GROUP BY 1"
)
def entity_assembly(spark, sf):
    d = resolution.entity_table(_assigned(spark, sf), _kyc(spark, sf))
    return d.select("entity_id", *big("n_phones", "n_accounts", "n_imeis"), "name")


@query("SELECT entity_id, identifier, id_type FROM val")
def entity_validate(spark, sf):
    return _validated(spark, sf)


@query("SELECT e.raw_row_ref, coalesce(v.entity_id, 'UNRESOLVED_' || e.entity_ref) AS entity_id FROM (SELECT * FROM ev) e LEFT JOIN (SELECT * FROM val WHERE id_type = 'phone') v ON v.identifier = e.entity_ref")
def apply_mapping(spark, sf):
    """Through the phone index, so account references stay unresolved."""
    known = resolution.identifier_index(_validated(spark, sf), ("phone",))
    return resolution.apply_mapping(cw.stored(spark, sf), known).select("raw_row_ref", "entity_id")


@query(
    "SELECT unnest(['nodes','kyc_mapped','unmapped']) AS metric, unnest([count(*), count(k.identifier), count(*) - count(k.identifier)]) AS value FROM nod n LEFT JOIN (SELECT DISTINCT identifier FROM kyc) k ON k.identifier = n.identifier "
    "UNION ALL SELECT unnest(['entities','multi_identifier','singletons']), unnest([count(*), count(*) FILTER (n > 1), count(*) FILTER (n <= 1)]) FROM (SELECT entity_id, count(*) FILTER (id_type IN ('phone','account','imei','vpa')) AS n FROM val GROUP BY 1)"
)
def coverage(spark, sf):
    return resolution.coverage(_nodes(spark, sf), _kyc(spark, sf), _validated(spark, sf))


@query(
    "SELECT DISTINCT w.key, coalesce(i.entity_id, s.entity_id) AS entity_id FROM (SELECT DISTINCT counterparty AS key FROM ev UNION SELECT 'U' || u FROM ev) w LEFT JOIN mem i ON i.identifier = w.key LEFT JOIN (SELECT DISTINCT entity_id FROM mem) s ON s.entity_id = w.key"
)
def entity_lookup(spark, sf):
    e = cw.stored(spark, sf)
    wanted = e.select(F.col("counterparty").alias("key")).unionByName(e.select(F.col("entity_id").alias("key"))).distinct()
    return resolution.lookup_entities(wanted, cw.members(spark, sf))


def _text_entities(spark, sf):
    """Benchmark items as named entities, with handles and numbers written in the documents."""
    d = cw.table(spark, sf, "documents")
    handles = d.where(F.contains("text", F.lit("@"))).select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._]+@[A-Za-z0-9]+)"), F.lit(1))).alias("identifier")).distinct()
    numbers = d.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9]{6,})\b"), F.lit(1))).alias("identifier")).distinct()
    ids = handles.withColumn("id_type", F.lit("vpa")).unionByName(numbers.withColumn("id_type", F.lit("account")))
    owner = F.concat(F.lit("ENT_"), F.substring(F.sha2("identifier", 256), 1, 12))
    b = cw.table(spark, sf, "benchmark")
    named = b.select(
        F.concat(F.lit("ENT_"), F.lpad(F.col("item_id").cast("string"), 4, "0")).alias("entity_id"), F.col("text").alias("name")
    )
    own = named.select("entity_id", F.col("entity_id").alias("identifier"), F.lit("unknown").alias("id_type"))
    return ids.select(owner.alias("entity_id"), "identifier", "id_type").unionByName(own), named


_SQUEEZE = r"regexp_replace(text, '[\s\-()+]', '', 'g')"


@query(
    f"""WITH d AS MATERIALIZED (SELECT doc_id AS text_id, text || CASE WHEN doc_id % 50 = 0 THEN ' see ENT-' || (doc_id % 40) || ' now' ELSE '' END AS text FROM documents),
hd AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(text, '([A-Za-z0-9._]+@[A-Za-z0-9]+)', 1)) AS identifier FROM documents),
nm AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(text, '\\b([0-9]{{6,}})\\b', 1)) AS identifier FROM documents),
own2 AS MATERIALIZED (SELECT 'ENT_' || substr(sha256(identifier), 1, 12) AS entity_id, identifier, true AS h FROM hd UNION ALL SELECT 'ENT_' || substr(sha256(identifier), 1, 12), identifier, false FROM nm),
bm AS MATERIALIZED (SELECT 'ENT_' || lpad(CAST(item_id AS VARCHAR), 4, '0') AS entity_id, lower(text) AS name FROM benchmark),
runs AS MATERIALIZED (SELECT DISTINCT text_id, unnest(regexp_extract_all({_SQUEEZE}, '[0-9]{{6,}}')) AS run FROM d),
hits AS (
 SELECT text_id, entity_id, 'id' AS how, 1 AS a, 0 AS b, '' AS c FROM (SELECT text_id, 'ENT_' || lpad(CAST(text_id % 40 AS VARCHAR), 4, '0') AS entity_id FROM d WHERE text_id % 50 = 0) WHERE entity_id IN (SELECT entity_id FROM bm)
 UNION ALL SELECT d.text_id, bm.entity_id, 'name', 2, -length(bm.name), bm.entity_id FROM d JOIN bm ON contains(lower(d.text), bm.name)
 UNION ALL SELECT r.text_id, o.entity_id, 'identifier', 3, 0, o.entity_id FROM runs r JOIN own2 o ON regexp_replace(o.identifier, '[^0-9]', '', 'g') = r.run
 UNION ALL SELECT d.text_id, o.entity_id, 'vpa', 4, 0, o.entity_id FROM d JOIN own2 o ON o.h AND contains(lower(d.text), lower(o.identifier)) WHERE d.text_id IN (SELECT text_id FROM runs)),
one AS (SELECT text_id, entity_id, arg_min(how, (a, b, c)) AS how, min((a, b, c)) AS ord FROM hits GROUP BY 1, 2)
SELECT text_id, entity_id, how, rank FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY ord) AS rank FROM one) WHERE rank <= 3"""
)
def mention_links(spark, sf):
    people, names = _text_entities(spark, sf)
    people = cut(people, "people")
    texts = cw.table(spark, sf, "documents").select(
        F.col("doc_id").alias("text_id"),
        F.concat("text", F.expr("if(doc_id % 50 = 0, concat(' see ENT-', doc_id % 40, ' now'), '')")).alias("text"),
    )
    return resolution.mention_links(texts, people, names)


# --------------------------------------------------------------------------- graph


@query("SELECT src, dst, round(weight, 4) AS weight, cnt AS count, source_file, from_debit AS counted_from_debit, first_us, last_us FROM flow")
def flow_edges(spark, sf):
    return graph.flow_edges(graph.transfers(cw.stored(spark, sf), cw.id_map(spark, sf))).withColumn("weight", F.round("weight", 4))


@query("SELECT src, dst, freq AS call_frequency, source_file, first_us, last_us FROM talk")
def call_edges(spark, sf):
    return graph.call_edges(graph.contacts(cw.stored(spark, sf), cw.phones(spark, sf)))


@query(
    f"SELECT src, dst, edge_type, round(weight, 4) AS weight, cnt AS count, coalesce(freq, 0) AS call_frequency, {inst('source_file')} AS institution, first_us, last_us FROM edg"
)
def merged_edges(spark, sf):
    d = graph.build_edges(cw.stored(spark, sf), cw.id_map(spark, sf), cw.phones(spark, sf))
    return d.select("src", "dst", "edge_type", r4("weight"), "count", F.coalesce("call_frequency", F.lit(0)).alias("call_frequency"), "institution", "first_us", "last_us")


@query(
    "SELECT entity_id, round(sum(i), 4) AS value_in, round(sum(o), 4) AS value_out FROM (SELECT src AS entity_id, 0 AS i, weight AS o FROM edg WHERE edge_type = 'transaction' UNION ALL SELECT dst, weight, 0 FROM edg WHERE edge_type = 'transaction') GROUP BY 1"
)
def value_in_out(spark, sf):
    return graph.value_in_out(cw.edges(spark, sf)).select("entity_id", r4("value_in"), r4("value_out"))


@query("SELECT src, dst, edge_class FROM cls")
def edge_class(spark, sf):
    return cw.classed_edges(spark, sf).select("src", "dst", "edge_class")


@query("SELECT entity_id, degree, risk_tier FROM vis")
def visible_nodes(spark, sf):
    return graph.visible_nodes(cw.edges(spark, sf), cw.scored(spark, sf))


@query(
    "SELECT entity_id, degree, risk_tier FROM vis ORDER BY CASE risk_tier WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, degree DESC, entity_id LIMIT 60"
)
def visible_nodes_top(spark, sf):
    return graph.visible_nodes(cw.edges(spark, sf), cw.scored(spark, sf), 60)


@query(
    "SELECT count(*) AS edges, count(*) FILTER (edge_type = 'transaction') AS transaction_edges, count(*) FILTER (edge_type = 'call') AS call_edges, count(*) FILTER (edge_class = 'layering') AS layering_edges, "
    "count(*) FILTER (edge_class = 'smoking_gun') AS smoking_gun_edges, round(sum(weight) FILTER (edge_type = 'transaction'), 2) AS total_value, round(min(weight) FILTER (edge_type = 'transaction' AND weight > 0), 4) AS amount_min, "
    "round(max(weight) FILTER (edge_type = 'transaction'), 4) AS amount_max, min(first_us) AS time_min_us, max(last_us) AS time_max_us FROM cls"
)
def graph_meta(spark, sf):
    d = graph.graph_meta(cw.classed_edges(spark, sf))
    return d.withColumn("total_value", F.round("total_value", 2)).withColumn("amount_min", F.round("amount_min", 4)).withColumn("amount_max", F.round("amount_max", 4))


@query("SELECT DISTINCT 'city' AS facet, value FROM plc WHERE kind = 'city' UNION ALL SELECT DISTINCT 'rule', rule_id FROM fir UNION ALL SELECT DISTINCT 'id_type', id_type FROM mem")
def graph_facets(spark, sf):
    return graph.graph_facets(graph.node_places(cw.stored(spark, sf)), cw.firings(spark, sf), cw.members(spark, sf))


_NEAR = "SELECT entity_id, other, sum(weight) AS weight FROM (SELECT src AS entity_id, dst AS other, weight FROM edg UNION ALL SELECT dst, src, weight FROM edg) WHERE entity_id <> other GROUP BY 1, 2"


@query(
    f"SELECT entity_id, rank, other, round(weight, 4) AS weight, CAST(greatest(n - 10, 0) AS BIGINT) AS remaining FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(weight, 4) DESC, other) AS rank, count(*) OVER (PARTITION BY entity_id) AS n FROM ({_NEAR})) WHERE rank <= 10"
)
def ego_top10(spark, sf):
    return graph.ego_view(cw.edges(spark, sf)).withColumn("weight", F.round("weight", 4))


@query(
    "SELECT x.entity_id, x.other, x.direction, x.edge_type, round(x.weight, 4) AS amount, rank, coalesce(s.risk_tier, 'LOW') AS tier FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(weight, 4) DESC, other, direction) AS rank FROM ("
    "SELECT src AS entity_id, dst AS other, 'out' AS direction, edge_type, weight FROM edg UNION ALL SELECT dst, src, 'in', edge_type, weight FROM edg)) x LEFT JOIN sco s ON s.entity_id = x.other WHERE rank <= 15"
)
def direct_counterparties(spark, sf):
    return graph.direct_counterparties(cw.edges(spark, sf), cw.scored(spark, sf)).withColumn("amount", F.round("amount", 4))


@query(
    "SELECT e.src, e.dst, round(e.weight, 4) AS amount, e.cnt AS count, coalesce(a.risk_tier, 'LOW') AS src_tier, coalesce(b.risk_tier, 'LOW') AS dst_tier FROM (SELECT * FROM edg WHERE edge_type = 'transaction' ORDER BY round(weight, 4) DESC, src, dst LIMIT 12) e "
    "LEFT JOIN sco a ON a.entity_id = e.src LEFT JOIN sco b ON b.entity_id = e.dst"
)
def top_transfers(spark, sf):
    return graph.largest_transfers(cw.edges(spark, sf), cw.scored(spark, sf)).withColumn("amount", F.round("amount", 4))


@query(
    "SELECT count(*) FILTER (edge_type = 'transaction') AS transfer_edges, count(*) FILTER (edge_type = 'call') AS call_edges, round(sum(weight) FILTER (edge_type = 'transaction'), 2) AS total_transferred FROM edg"
)
def money_flow_totals(spark, sf):
    return graph.money_flow_totals(cw.edges(spark, sf)).withColumn("total_transferred", F.round("total_transferred", 2))


@query(
    "SELECT m.identifier, m.id_type, m.entity_id, coalesce(s.risk_tier, 'LOW') AS risk_tier, coalesce(p.institution, 'Unknown') AS institution FROM mem m LEFT JOIN sco s ON s.entity_id = m.entity_id "
    "LEFT JOIN (SELECT entity_id, min(value) AS institution FROM plc WHERE kind = 'institution' GROUP BY 1) p ON p.entity_id = m.entity_id"
)
def identity_view(spark, sf):
    ids = cw.members(spark, sf)
    star = resolution.ownership_edges(ids.select(F.col("entity_id").alias("entry"), "identifier"))
    attrs = graph.node_attributes(graph.node_places(cw.stored(spark, sf)))
    return graph.identity_view(ids, star, cw.scored(spark, sf), attrs)[0]


_T_FROM, _T_TO = 1_704_500_000_000_000, 1_705_900_000_000_000


@query(
    f"WITH f AS MATERIALIZED (SELECT * FROM cls WHERE (edge_type <> 'transaction' OR weight >= 60) AND last_us >= {_T_FROM} AND first_us <= {_T_TO}), n AS MATERIALIZED (SELECT entity_id FROM sco WHERE risk_tier IN ('CRITICAL','HIGH')) "
    "SELECT src, dst, edge_type, edge_class FROM f WHERE src IN (SELECT entity_id FROM n) AND dst IN (SELECT entity_id FROM n)"
)
def graph_filter(spark, sf):
    """Tier at least HIGH, transfers of 60 and more, active in a range of days."""
    e = graph.filter_edges(cw.classed_edges(spark, sf), amount_min=60, from_us=_T_FROM, to_us=_T_TO)
    n = graph.filter_nodes(cw.scored(spark, sf), tier_at_least="HIGH")
    return graph.consistent_view(n, e, True)[1].select("src", "dst", "edge_type", "edge_class")


@query(
    "SELECT entity_id, risk_tier FROM sco WHERE risk_tier <> 'LOW' AND contains(rules, 'TCS-1') AND entity_id IN (SELECT entity_id FROM plc WHERE kind = 'city' AND value = 'Pune')"
)
def graph_node_filter(spark, sf):
    places_ = graph.node_places(cw.stored(spark, sf))
    return graph.filter_nodes(cw.scored(spark, sf), rule="TCS-1", places=places_, city="Pune", flagged=True).select("entity_id", "risk_tier")


@query(
    "WITH h AS MATERIALIZED (SELECT entity_id FROM sco WHERE contains(lower(entity_id), 'u14') UNION SELECT entity_id FROM mem WHERE id_type IN ('phone','account') AND contains(lower(identifier), 'u14')), "
    "keep AS MATERIALIZED (SELECT entity_id FROM h UNION SELECT dst FROM edg WHERE src IN (SELECT entity_id FROM h) UNION SELECT src FROM edg WHERE dst IN (SELECT entity_id FROM h)) SELECT entity_id, risk_tier FROM sco WHERE entity_id IN (SELECT entity_id FROM keep)"
)
def graph_search(spark, sf):
    return graph.search_nodes(cw.scored(spark, sf), cw.edges(spark, sf), cw.members(spark, sf), " U14 ").select("entity_id", "risk_tier")


@query(
    "WITH seed AS MATERIALIZED (SELECT entity_id FROM sco WHERE risk_tier <> 'LOW' AND (contains(rules, 'LAY-1') OR contains(rules, 'MUL-1'))), "
    "v AS MATERIALIZED (SELECT entity_id FROM seed UNION SELECT dst FROM edg WHERE src IN (SELECT entity_id FROM seed) UNION SELECT src FROM edg WHERE dst IN (SELECT entity_id FROM seed)) "
    "SELECT src, dst, edge_type FROM edg WHERE src IN (SELECT entity_id FROM v) AND dst IN (SELECT entity_id FROM v) AND (edge_type <> 'transaction' OR weight >= 40)"
)
def figure_view(spark, sf):
    return graph.figure_view(cw.edges(spark, sf), cw.scored(spark, sf), ("LAY-1", "MUL-1"), 40)[1].select("src", "dst", "edge_type")


@query(
    "SELECT entity_id, min(value) FILTER (kind = 'institution') AS institution, coalesce(string_agg(value, ',' ORDER BY value) FILTER (kind = 'institution'), '') AS institutions, "
    "coalesce(string_agg(value, ',' ORDER BY value) FILTER (kind = 'source_file'), '') AS source_files, coalesce(string_agg(value, ',' ORDER BY value) FILTER (kind = 'city'), '') AS cities FROM plc GROUP BY 1"
)
def node_attributes(spark, sf):
    d = graph.node_attributes(graph.node_places(cw.events(spark, sf)))
    return d.select("entity_id", "institution", joined("institutions"), joined("source_files"), joined("cities"))


# -------------------------------------------------------------------------- places

_ACT = (
    "SELECT {k}, count(*) AS events, count(DISTINCT g.entity_id) AS entities, {t} ['CRITICAL','HIGH','MEDIUM','LOW'][min(CASE coalesce(risk_tier, 'LOW') WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END)] AS highest_tier "
    "FROM geo g LEFT JOIN sco s ON s.entity_id = g.entity_id WHERE {k} IS NOT NULL GROUP BY 1"
)


@query(
    _ACT.format(k="tower", t=" ".join(f"count(*) FILTER (coalesce(risk_tier, 'LOW') = '{t}') AS {t.lower()}," for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW")))
)
def tower_activity(spark, sf):
    return places.tower_activity(cw.stored(spark, sf), cw.scored(spark, sf))


@query(_ACT.format(k="city", t=""))
def city_activity(spark, sf):
    return places.city_activity(cw.stored(spark, sf), cw.scored(spark, sf))


@query(
    "SELECT DISTINCT g.tower AS from_tower, f.tower AS to_tower FROM geo g JOIN mem m ON m.identifier = g.counterparty AND m.id_type = 'phone' "
    "JOIN (SELECT entity_id, arg_min(tower, raw_row_ref) AS tower FROM geo GROUP BY 1) f ON f.entity_id = m.entity_id WHERE g.event_type IN ('call','sms') AND g.tower <> f.tower"
)
def call_paths(spark, sf):
    return places.call_paths(cw.stored(spark, sf), cw.phones(spark, sf))


# ------------------------------------------------------------------------- reports


@query("SELECT entity_id, risk_tier, CASE risk_tier WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END::BIGINT AS tier_order, rules FROM sco")
def suspect_list(spark, sf):
    d = reports.suspect_list(cw.scored(spark, sf))
    return d.select("entity_id", "risk_tier", scoring.tier_rank(F.col("risk_tier")).cast("bigint").alias("tier_order"), joined("rules_fired", "rules"))


@query(
    "SELECT entity_id, risk_tier, n_rules FROM sco WHERE risk_tier <> 'LOW' ORDER BY CASE risk_tier WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, n_rules DESC, entity_id LIMIT 40"
)
def ranked_flagged(spark, sf):
    return reports.ranked_flagged(cw.scored(spark, sf)).select("entity_id", "risk_tier", "n_rules")


@query("SELECT CAST(greatest(count(*) - 40, 0) AS BIGINT) AS omitted FROM sco WHERE risk_tier <> 'LOW'")
def omitted_flagged(spark, sf):
    return reports.omitted_flagged(cw.scored(spark, sf))


@query()
def ml_only_entities(spark, sf):
    """Entities with the anomaly flag that no rule names."""
    flags = scoring.isolation_flags(scoring.entity_features(cw.stored(spark, sf)))
    return reports.only_anomalous(scoring.combine_scores(cw.firings(spark, sf), flags, cw.members(spark, sf)))


@query(
    "SELECT count(*) AS entities, CAST(ceil(0.1 * count(*)) AS BIGINT) AS flags_at_most, true AS flags_fit, true AS scores_apart, true AS tiers_same FROM (SELECT DISTINCT entity_id FROM ev)"
)
def anomaly_checks(spark, sf):
    """What holds for every anomaly run: all entities scored, flags within the share, flagged scores above the others, tiers untouched."""
    flags = cut(scoring.isolation_flags(scoring.entity_features(cw.stored(spark, sf))), "flags")
    share = F.ceil(0.1 * F.count(F.lit(1)))
    with_flags = scoring.combine_scores(cw.firings(spark, sf), flags, cw.members(spark, sf)).select("entity_id", "risk_tier")
    changed = with_flags.join(cw.scored(spark, sf).select("entity_id", F.col("risk_tier").alias("_t")), "entity_id").where("risk_tier <> _t")
    top = F.max(F.when(~F.col("ml_anomaly"), F.col("score")))
    return flags.agg(
        F.count(F.lit(1)).alias("entities"), share.cast("bigint").alias("flags_at_most"), (F.count_if("ml_anomaly") <= share).alias("flags_fit"),
        (F.min(F.when(F.col("ml_anomaly"), F.col("score"))) > top).alias("scores_apart"),
    ).withColumn("tiers_same", F.lit(changed.isEmpty()))


@query(
    f"SELECT DISTINCT l.entity_id, CAST(x.ref AS BIGINT) AS raw_row_ref, x.paid FROM (SELECT t.entity_id, t.raw_row_ref AS t_ref, c.raw_row_ref AS c_ref FROM ev t "
    f"JOIN ev c ON c.entity_id = t.entity_id AND c.event_type IN ('call','sms') AND t.event_type = 'transaction' AND c.us BETWEEN t.us - {1440 * MINUTE} AND t.us - {MINUTE} "
    "JOIN mem a ON a.identifier = t.counterparty JOIN mem b ON b.identifier = c.counterparty AND b.entity_id = a.entity_id) l, LATERAL (SELECT t_ref AS ref, true AS paid UNION ALL SELECT c_ref, false) x"
)
def tcs2_evidence(spark, sf):
    """Every transfer and every call that TCS-2 cites through a resolved payee."""
    links, calls = rules.call_payee_links(cw.stored(spark, sf), cw.id_map(spark, sf))
    found = temporal.linked_calls_before(links.where("link = 'resolved'"), calls, 1440 * MINUTE, MINUTE)
    paid = found.transfers.select("entity_id", "raw_row_ref", F.lit(True).alias("paid"))
    return paid.unionByName(found.calls.select("entity_id", "raw_row_ref", F.lit(False).alias("paid"))).distinct()


_FLAG = "(SELECT entity_id FROM sco WHERE risk_tier IN ('CRITICAL','HIGH'))"


def _flagged(spark, sf):
    return cw.scored(spark, sf).where(F.col("risk_tier").isin("CRITICAL", "HIGH"))


@query(
    f"SELECT entity_id, line, us, event_type, round(amount, 0) AS amount, substr(counterparty, 1, 30) AS counterparty, source_file, raw_row_ref FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us, raw_row_ref) AS line FROM ev WHERE entity_id IN {_FLAG}) WHERE line <= 50"
)
def evidence_table(spark, sf):
    return reports.evidence_table(cw.stored(spark, sf), _flagged(spark, sf))


@query(
    f"SELECT entity_id, serial, us, CASE WHEN amount > 0 THEN 'Credit (IN)' ELSE 'Debit (OUT)' END AS direction, round(abs(amount), 4) AS amount, substr(counterparty, 1, 30) AS counterparty, source_file, raw_row_ref FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us, raw_row_ref) AS serial FROM ev WHERE event_type = 'transaction' AND entity_id IN {_FLAG}) WHERE serial <= 100"
)
def str_schedule(spark, sf):
    return reports.filing_schedule(cw.stored(spark, sf), _flagged(spark, sf)).withColumn("amount", F.round("amount", 4))


@query(f"SELECT entity_id, round(sum(abs(amount)), 2) AS total_value, count(*) AS transactions FROM ev WHERE event_type = 'transaction' AND entity_id IN {_FLAG} GROUP BY 1")
def str_totals(spark, sf):
    return reports.filing_totals(cw.stored(spark, sf), _flagged(spark, sf)).withColumn("total_value", F.round("total_value", 2))


@query(
    "SELECT f.entity_id, f.rule_id, c.category, c.grounds FROM fir f JOIN (VALUES "
    + ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in reports.FILING_CATEGORIES)
    + ") c(rule_id, category, grounds) ON c.rule_id = f.rule_id"
)
def str_categories(spark, sf):
    return reports.filing_categories(cw.firings(spark, sf))


@query(
    "SELECT m.entity_id, s.risk_tier, s.n_rules, coalesce(e.n, 0) AS total_events, CAST(least(coalesce(e.n, 0), 60) AS BIGINT) AS shown_events, coalesce(e.n, 0) > 60 AS events_truncated, CAST(least(coalesce(g.n, 0), 15) AS BIGINT) AS shown_parties, round(coalesce(v.i, 0), 4) AS value_in, round(coalesce(v.o, 0), 4) AS value_out "
    "FROM (SELECT DISTINCT entity_id FROM mem) m JOIN sco s ON s.entity_id = m.entity_id LEFT JOIN (SELECT entity_id, count(*) AS n FROM ev GROUP BY 1) e ON e.entity_id = m.entity_id "
    "LEFT JOIN (SELECT entity_id, count(*) AS n FROM (SELECT src AS entity_id FROM edg UNION ALL SELECT dst FROM edg) GROUP BY 1) g ON g.entity_id = m.entity_id "
    "LEFT JOIN (SELECT entity_id, sum(i) AS i, sum(o) AS o FROM (SELECT src AS entity_id, 0 AS i, weight AS o FROM edg WHERE edge_type = 'transaction' UNION ALL SELECT dst, weight, 0 FROM edg WHERE edge_type = 'transaction') GROUP BY 1) v ON v.entity_id = m.entity_id"
)
def dossier(spark, sf):
    d = reports.dossiers(
        cw.scored(spark, sf), cw.entities(spark, sf), cw.edges(spark, sf), cw.stored(spark, sf), cw.firings(spark, sf), cw.evidence(spark, sf)
    )
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return d.select(
        "entity_id", "risk_tier", "n_rules", "total_events", n("events").alias("shown_events"), "events_truncated",
        n("counterparties").alias("shown_parties"), r4("value_in"), r4("value_out"),
    )


@query(
    f"SELECT s.entity_id, s.risk_tier, coalesce(g.rules, '') AS rules, round(coalesce(t.v, 0), 2) AS total_value, coalesce(t.n, 0) AS transactions, CAST(least(coalesce(t.n, 0), 100) AS BIGINT) AS scheduled "
    "FROM sco s LEFT JOIN (SELECT entity_id, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM fir GROUP BY 1) g ON g.entity_id = s.entity_id "
    "LEFT JOIN (SELECT entity_id, sum(abs(amount)) AS v, count(*) AS n FROM ev WHERE event_type = 'transaction' GROUP BY 1) t ON t.entity_id = s.entity_id WHERE s.risk_tier IN ('CRITICAL','HIGH')"
)
def str_package(spark, sf):
    d = reports.filing_package(cw.stored(spark, sf), cw.scored(spark, sf), cw.firings(spark, sf))
    return d.select(
        "entity_id", "risk_tier", F.coalesce(F.array_join("grounds.rule_id", ","), F.lit("")).alias("rules"),
        F.round("total_value", 2).alias("total_value"), "transactions",
        F.coalesce(F.size("schedule"), F.lit(0)).cast("bigint").alias("scheduled"),
    )


@query(
    "SELECT risk_tier, count(*) AS bundles, sum(n_rules)::BIGINT AS findings FROM sco WHERE risk_tier IN ('CRITICAL','HIGH') GROUP BY 1"
)
def forensic_bundles(spark, sf):
    """Bundles written a folder per tier and read back."""
    import uuid

    d = reports.dossiers(
        cw.scored(spark, sf), cw.entities(spark, sf), cw.edges(spark, sf), cw.stored(spark, sf), cw.firings(spark, sf), cw.evidence(spark, sf)
    )
    path = f"{work_dir(spark)}/bundles-{uuid.uuid4().hex}"
    reports.write_bundles(d, path)
    back = spark.read.schema("entity_id string, findings array<struct<rule_id:string>>, risk_tier string").json(path)
    return back.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("bundles"), F.sum(F.size("findings")).cast("bigint").alias("findings"))


@query(
    "SELECT f.entity_id, f.rule_id, f.severity, e.n AS raw_rows, s.risk_tier FROM fir f JOIN sco s ON s.entity_id = f.entity_id JOIN (SELECT entity_id, count(*) AS n FROM ev GROUP BY 1) e ON e.entity_id = f.entity_id"
)
def entity_trace(spark, sf):
    """Trace bundles: header, findings with evidence, raw rows; counted per finding here."""
    ids = cw.entities(spark, sf)
    head, found, raw = reports.trace_bundle(cw.scored(spark, sf), ids, cw.firings(spark, sf), cw.evidence(spark, sf), cw.stored(spark, sf))
    rows = raw.groupBy("entity_id").agg(F.count(F.lit(1)).alias("raw_rows"))
    per = found.groupBy("entity_id", "rule_id", "severity").agg(F.count("token").alias("tokens")).where("tokens > 0")
    return per.join(rows, "entity_id").join(head.select("entity_id", "risk_tier"), "entity_id").drop("tokens")


@query(
    "SELECT x.entity_id, x.raw_row_ref, x.token, e.event_type, e.raw_row_ref IS NOT NULL AS in_entity_rows FROM (SELECT entity_id, unnest([raw_row_ref, call_ref, session_ref]) AS raw_row_ref, unnest(['bank_row_' || raw_row_ref, 'cdr_row_' || call_ref, 'ipdr_row_' || session_ref]) AS token FROM enr WHERE has_call AND has_session) x "
    "LEFT JOIN ev e ON e.entity_id = x.entity_id AND e.raw_row_ref = x.raw_row_ref"
)
def evidence_join(spark, sf):
    d = reports.evidence_rows(rules.tcs1(cw.enriched(spark, sf)).evidence, cw.events(spark, sf))
    return d.select("entity_id", "raw_row_ref", "token", "event_type", "in_entity_rows")


@query(
    "SELECT 'critical_count' AS metric, count(*) FILTER (risk_tier = 'CRITICAL') AS value FROM sco UNION ALL SELECT 'high_count', count(*) FILTER (risk_tier = 'HIGH') FROM sco UNION ALL SELECT 'medium_count', count(*) FILTER (risk_tier = 'MEDIUM') FROM sco "
    "UNION ALL SELECT 'low_count', count(*) FILTER (risk_tier = 'LOW') FROM sco UNION ALL SELECT 'flagged_suspects', count(*) FILTER (risk_tier <> 'LOW') FROM sco UNION ALL SELECT 'ml_anomalies', 0 "
    "UNION ALL SELECT 'total_entities', count(DISTINCT entity_id) FROM mem UNION ALL SELECT 'kyc_anchored_entities', count(*) FILTER (n > 1) FROM (SELECT entity_id, count(*) AS n FROM mem GROUP BY 1) "
    "UNION ALL SELECT 'unmapped_passthrough_entities', count(*) FILTER (n <= 1) FROM (SELECT entity_id, count(*) AS n FROM mem GROUP BY 1) "
    "UNION ALL SELECT 'total_rule_firings', count(*) FROM fir UNION ALL SELECT 'rules_fired_count', count(DISTINCT rule_id) FROM fir UNION ALL SELECT 'total_events', count(*) FROM ev"
)
def run_metrics(spark, sf):
    ids = cw.members(spark, sf)
    ents = resolution.entity_table(ids, ids.withColumn("name", F.lit(None).cast("string")).withColumn("entry", F.col("entity_id")))
    return reports.run_metrics(cw.scored(spark, sf), cw.stored(spark, sf), ents, cw.firings(spark, sf))


@query(
    "SELECT event_type, count(*) AS events, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY 1 UNION ALL SELECT 'ALL', count(*), min(us), max(us) FROM ev"
)
def event_span(spark, sf):
    return reports.event_span(cw.events(spark, sf))


_OWN = "SELECT s.entity_id, risk_tier, rules, coalesce(p.value, 'Other Institution') AS institution FROM sco s LEFT JOIN plc p ON p.entity_id = s.entity_id AND p.kind = 'institution'"


@query(
    "SELECT institution, " + ", ".join(f'count(*) FILTER (risk_tier = \'{t}\') AS "{t}"' for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW")) + f" FROM ({_OWN}) GROUP BY 1"
)
def institution_tier_matrix(spark, sf):
    return reports.institution_matrix(cw.stored(spark, sf), cw.scored(spark, sf), cw.firings(spark, sf))[0]


@query(
    "SELECT institution, " + ", ".join(f'count(*) FILTER (contains(rules, \'{t}\')) AS "{t}"' for t in ("STR-1", "LAY-1", "MUL-1", "IDR-1", "LOC-1", "TCS-1", "TCS-2")) + f" FROM ({_OWN}) GROUP BY 1"
)
def institution_rule_matrix(spark, sf):
    return reports.institution_matrix(cw.stored(spark, sf), cw.scored(spark, sf), cw.firings(spark, sf))[1]


@query(f"SELECT institution, entity_id, risk_tier, rules FROM ({_OWN}) WHERE risk_tier <> 'LOW'")
def institution_flagged(spark, sf):
    return reports.institution_flagged(cw.stored(spark, sf), cw.scored(spark, sf)).select("institution", "entity_id", "risk_tier", joined("rules_fired", "rules"))


# -------------------------------------------------------------------- verification


def _matches(spark, sf):
    entries, ids = cw.truth(spark, sf)
    return cw._once(spark, sf, "matches", lambda: verification.match_truth(entries, ids, cw.members(spark, sf), cw.scored(spark, sf)))


def _status(spark, sf):
    return verification.truth_status(cw.truth(spark, sf)[0], _matches(spark, sf), cw.scored(spark, sf))


@query("SELECT truth_id, typology, detected_as, detected_tier, status FROM stat")
def truth_match(spark, sf):
    return _status(spark, sf)


@query(
    "SELECT *, round(CASE WHEN truth_entities > 0 THEN true_positives / greatest(truth_entities, 1) END, 6) AS recall, round(true_positives / greatest(true_positives + false_positives, 1), 6) AS precision, "
    "round(2.0 * (true_positives / greatest(true_positives + false_positives, 1)) * (true_positives / truth_entities) / greatest(true_positives / greatest(true_positives + false_positives, 1) + true_positives / truth_entities, 0.0001), 6) AS f1, round((1000 - least(false_positives, 1000)) / 1000, 6) AS specificity "
    "FROM (SELECT (SELECT count(*) FROM stat) AS truth_entities, (SELECT count(*) FROM stat WHERE status = 'DETECTED') AS true_positives, (SELECT count(*) FROM fps) AS false_positives, (SELECT count(*) FROM stat WHERE status <> 'DETECTED') AS false_negatives)"
)
def detection_scores(spark, sf):
    st = _status(spark, sf)
    d = verification.detection_scores(st, verification.false_positives(st, cw.scored(spark, sf)), 1000)
    return d.select(
        "truth_entities", "true_positives", "false_positives", "false_negatives", *[F.round(F.col(c), 6).alias(c) for c in ("recall", "precision", "f1", "specificity")]
    )


@query(
    "SELECT t.typology, l.label, count(*) AS planted, count(*) FILTER (status = 'DETECTED') AS detected, count(*) FILTER (status <> 'DETECTED') AS missed, round(count(*) FILTER (status = 'DETECTED') / count(*), 6) AS recall FROM stat t JOIN (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in verification.TYPOLOGIES)
    + ") l(typology, label) ON l.typology = t.typology GROUP BY 1, 2"
)
def typology_scores(spark, sf):
    return verification.typology_scores(_status(spark, sf)).withColumn("recall", F.round("recall", 6))


@query(
    "SELECT entity_id, CASE WHEN entity_id IN (SELECT unnest(path) FROM best) THEN 'sits on a detected layering chain' ELSE 'flagged on ' || replace(rules, ',', ', ') || ' with no ground-truth match' END AS note FROM fps"
)
def false_positive_notes(spark, sf):
    fps = verification.false_positives(_status(spark, sf), cw.scored(spark, sf))
    return verification.false_positive_notes(fps, cw.best_chains(spark, sf))


# --------------------------------------------------------------------------- audit


def _digests(spark, sf, content="text"):
    return cw.table(spark, sf, "documents").select(
        F.concat("doc_id", F.expr("if(doc_id % 3 = 0, '.json', '.csv')")).alias("filename"),
        F.octet_length("text").cast("bigint").alias("size_bytes"), F.sha2(F.expr(content), 256).alias("sha256"),
    )


@query(
    "SELECT d.doc_id || CASE WHEN d.doc_id % 3 = 0 THEN '.json' ELSE '.csv' END AS filename, CAST(octet_length(encode(d.text)) AS BIGINT) AS size_bytes, sha256(d.text) AS sha256, CASE WHEN d.doc_id % 3 = 0 THEN 'json' ELSE 'csv' END AS extension, "
    "CASE WHEN l.quality = 1 THEN 'PARSED' WHEN l.quality = 0 THEN 'FAILED' WHEN d.doc_id % 3 = 0 THEN 'REFERENCE' ELSE 'NOT INGESTED' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)
def file_manifest(spark, sf):
    """Documents as evidence files, labels as their parse record."""
    stats = cw.table(spark, sf, "labels").select(
        F.concat("doc_id", F.expr("if(doc_id % 3 = 0, '.json', '.csv')")).alias("filename"), F.expr("if(quality = 1, 'PARSED', 'FAILED')").alias("status")
    )
    return audit.file_manifest(_digests(spark, sf), stats).select("filename", "size_bytes", "sha256", "extension", "status")


@query(
    "SELECT doc_id || CASE WHEN doc_id % 3 = 0 THEN '.json' ELSE '.csv' END AS filename, sha256(rtrim(text, chr(10) || '. ')) AS sha256, sha256(text) AS sha256_at_ingest, sha256(text) <> sha256(rtrim(text, chr(10) || '. ')) AS modified_since_ingest FROM documents"
)
def tamper_check(spark, sf):
    now = _digests(spark, sf, "rtrim(concat(char(10), '. '), text)")
    return audit.tamper_check(_digests(spark, sf), now)


@query(
    "SELECT storage_path, max(doc_id) AS created_at, CASE WHEN max(doc_id) % 2 = 0 THEN 'evidence' ELSE 'str_report' END AS kind, arg_max(sha256(text), doc_id) AS sha256 FROM (SELECT *, lang || '/' || source AS storage_path FROM documents WHERE doc_id % 5 > 0) GROUP BY 1"
)
def artifact_upsert(spark, sf):
    """Documents written over each other on one path per language and source, twice; every fifth has an unknown kind."""
    d = cw.table(spark, sf, "documents").select(
        F.concat_ws("/", "lang", "source").alias("storage_path"), F.col("doc_id").alias("created_at"),
        F.expr("case when doc_id % 5 = 0 then 'photo' when doc_id % 2 = 0 then 'evidence' else 'str_report' end").alias("kind"), F.sha2("text", 256).alias("sha256"),
    )
    old = audit.upsert_artifacts(d.limit(0), d.withColumn("created_at", -F.col("created_at") - 1))
    return audit.upsert_artifacts(old.select(*d.columns), d)


@query("SELECT entity_id, rule_id, severity FROM fir WHERE entity_id IN (SELECT entity_id FROM sco WHERE risk_tier = 'CRITICAL')")
def trace_roundtrip(spark, sf):
    """The decision trace written as JSON lines and read back for the critical entities."""
    import uuid

    path = f"{work_dir(spark)}/trace-{uuid.uuid4().hex}"
    audit.write_trace(cw.firings(spark, sf), cw.evidence(spark, sf), path)
    worst = cw.scored(spark, sf).where("risk_tier = 'CRITICAL'").select("entity_id")
    return audit.read_trace(spark, path).join(worst, "entity_id", "left_semi").select("entity_id", "rule_id", "severity")
