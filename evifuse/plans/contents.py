"""Registered queries that compare contents: documents, lists, evidence and stored tables row by row."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evifuse.operators import graph, reports, resolution, rules, scoring, storage
from evifuse.plans import casework as cw
from evifuse.plans.queries import _assigned, _kyc, _validated, query
from evifuse.session import work_dir
from evifuse.sources import reference


def _place(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------------ graph


@query(
    "SELECT (SELECT count(*) FROM (SELECT entity_id FROM sco UNION SELECT entity_id FROM deg)) AS nodes, (SELECT count(*) FROM vis) AS visible, "
    "(SELECT count(*) FROM (SELECT entity_id FROM sco UNION SELECT entity_id FROM deg)) - (SELECT count(*) FROM vis) AS hidden_isolated, (SELECT count(*) > 60 FROM vis) AS truncated"
)
def graph_hidden(spark, sf):
    return graph.visible_counts(cw.edges(spark, sf), cw.scored(spark, sf), 60)


@query("SELECT src, dst, 'kyc_ownership' AS source FROM own")
def identity_edges(spark, sf):
    """The edge frame of the identifier graph."""
    own = resolution.ownership_edges(_kyc(spark, sf))
    members = cw.members(spark, sf)
    attributes = members.select("entity_id", F.lit("SBI Bank").alias("institution")).distinct()
    return graph.identity_view(members, own, cw.scored(spark, sf), attributes)[1]


# ------------------------------------------------------------------------- resolution


@query(
    "SELECT entity_id, " + ", ".join(f"string_agg(DISTINCT identifier, ',' ORDER BY identifier) FILTER (id_type = '{t}') AS {t}s" for t in ("phone", "account", "vpa", "imei", "ip")) + " FROM asg GROUP BY 1"
)
def entity_lists(spark, sf):
    d = resolution.entity_table(_assigned(spark, sf), _kyc(spark, sf))
    lists = {f"{t}s": F.array_join(f"{t}s", ",") for t in ("phone", "account", "vpa", "imei", "ip")}
    return d.select("entity_id", *[F.when(c != "", c).alias(n) for n, c in lists.items()])


@query(
    "SELECT e.raw_row_ref, coalesce(v.entity_id, 'UNRESOLVED_' || e.entity_ref) AS entity_id FROM (SELECT * FROM ev) e LEFT JOIN (SELECT * FROM val WHERE id_type IN ('phone','account','vpa')) v ON v.identifier = e.entity_ref"
)
def map_all_identifiers(spark, sf):
    """Events resolved through numbers, accounts and handles."""
    known = resolution.identifier_index(_validated(spark, sf))
    return resolution.apply_mapping(cw.stored(spark, sf), known).select("raw_row_ref", "entity_id")


# ------------------------------------------------------------------- rules and scores


@query("SELECT entity_id, string_agg(rule_id || '=' || severity, ',' ORDER BY rule_id) AS severities FROM fir GROUP BY 1")
def rule_severity_map(spark, sf):
    d = scoring.risk_tiers(cw.firings(spark, sf))
    pairs = F.transform(F.array_sort(F.map_keys("rule_severities")), lambda k: F.concat(k, F.lit("="), F.element_at("rule_severities", k)))
    return d.select("entity_id", F.array_join(pairs, ",").alias("severities"))


@query(
    "SELECT entity_id, unnest(['row_' || first_row_ref, 'imei:' || imei, 'msisdn:' || msisdn, 'limb:device_fanout']) AS token FROM fan "
    "UNION ALL SELECT entity_id, 'msisdn_count:' || msisdn_count FROM (SELECT DISTINCT entity_id, imei, msisdn_count FROM fan) "
    "UNION ALL SELECT entity_id, id_type || ':' || identifier FROM (SELECT *, count(*) OVER (PARTITION BY entity_id, id_type) AS n FROM mem) WHERE (id_type = 'account' AND n >= 3) OR (id_type = 'imei' AND n >= 2) "
    "UNION ALL SELECT entity_id, unnest([id_type || '_count:' || n, CASE id_type WHEN 'account' THEN 'limb:account_fanout' ELSE 'limb:device_multiplicity' END]) FROM (SELECT entity_id, id_type, count(*) AS n FROM mem GROUP BY 1, 2) WHERE (id_type = 'account' AND n >= 3) OR (id_type = 'imei' AND n >= 2) "
    "UNION ALL SELECT entity_id, token FROM (SELECT entity_id, unnest(['row_' || coalesce(CAST(prev_ref AS VARCHAR), 'N/A'), 'row_' || raw_row_ref, 'phone:' || number, 'severity:' || severity, "
    "'change:' || CASE severity WHEN 'HIGH' THEN 'SIM and device replaced together' WHEN 'MEDIUM' THEN 'SIM or device replaced close to a payment' ELSE 'SIM or device replaced, no payment near' END, "
    "'nearby_txn:' || CASE WHEN nearby THEN 'yes' ELSE 'no' END, CASE WHEN dev THEN 'old_imei:' || old_imei END, CASE WHEN dev THEN 'new_imei:' || imei END, CASE WHEN sim THEN 'old_imsi:' || old_imsi END, CASE WHEN sim THEN 'new_imsi:' || imsi END, 'limb:identifier_swap']) AS token FROM swap1) WHERE token IS NOT NULL "
    "UNION ALL SELECT entity_id, unnest(['severity:' || severity, 'limbs:' || limbs]) FROM idr"
)
def idr_evidence(spark, sf):
    """All evidence of the identity rule but the printed time gap."""
    return rules.idr1(cw.stored(spark, sf), cw.members(spark, sf)).evidence.where("token not like 'time_gap:%'").select("entity_id", "token")


_EMBEDDED = (
    "SELECT t.entity_id, t.raw_row_ref, t.counterparty AS payee, c.counterparty AS party, c.raw_row_ref AS call_ref FROM (SELECT * FROM ev WHERE event_type = 'transaction') t "
    "JOIN (SELECT * FROM ev WHERE event_type IN ('call','sms')) c ON c.entity_id = t.entity_id AND c.us BETWEEN t.us - 86400000000 AND t.us - 60000000 "
    "AND contains(regexp_replace(t.counterparty, '[^0-9]', '', 'g'), c.counterparty)"
)


@query(
    f"SELECT entity_id, unnest(['row_' || raw_row_ref, 'calls:' || n, 'link:embedded', 'called:' || party, 'paid:' || payee]) AS token FROM (SELECT entity_id, raw_row_ref, payee, party, count(*) AS n FROM ({_EMBEDDED}) GROUP BY ALL) "
    f"UNION ALL SELECT entity_id, unnest(['row_' || call_ref, 'called:' || party]) FROM (SELECT DISTINCT entity_id, party, call_ref FROM ({_EMBEDDED}))"
)
def tcs2_embedded_evidence(spark, sf):
    """Evidence of the limb that finds a called number inside the payee; no owner is known."""
    none = cw.id_map(spark, sf).where("identifier is null")
    return rules.tcs2(cw.stored(spark, sf), none, 1440).evidence.select("entity_id", "token")


# -------------------------------------------------------------------------- documents


@query(
    "SELECT entity_id, pos, us, event_type, CASE WHEN event_type = 'transaction' THEN CASE WHEN amount < 0 THEN 'out' ELSE 'in' END END AS direction, round(amount, 4) AS amount, "
    "CASE WHEN event_type = 'transaction' THEN ['UPI','IMPS','NEFT'][k % 3 + 1] END AS channel, counterparty, location, source_file, raw_row_ref "
    "FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us, raw_row_ref) AS pos FROM ev) WHERE pos <= 60 AND entity_id IN (SELECT entity_id FROM mem)"
)
def dossier_events(spark, sf):
    """The events that dossiers show, with the payment channel."""
    kinds = F.array(*[F.lit(c) for c in ("UPI", "IMPS", "NEFT")])
    k = F.regexp_extract("counterparty", "^(?:ACC_|9?0*)([0-9]+)", 1).cast("bigint")
    e = cw.stored(spark, sf).withColumn("channel", F.when(F.col("event_type") == "transaction", kinds[(k % 3).cast("int")]))
    d = reports.dossiers(cw.scored(spark, sf), cw.entities(spark, sf), cw.edges(spark, sf), e, cw.firings(spark, sf), cw.evidence(spark, sf))
    x = d.select("entity_id", F.explode("events").alias("x")).select("entity_id", "x.*")
    return x.withColumn("amount", F.round("amount", 4)).withColumn("pos", F.col("pos").cast("bigint")).select(
        "entity_id", "pos", "us", "event_type", "direction", "amount", "channel", "counterparty", "location", "source_file", "raw_row_ref"
    )


@query(
    "SELECT entity_id, 'finding' AS section, rule_id || ' ' || severity AS body FROM fir WHERE entity_id IN (SELECT entity_id FROM sco WHERE risk_tier IN ('HIGH','CRITICAL')) "
    "UNION ALL SELECT entity_id, 'event', raw_row_ref || ' ' || event_type || ' ' || us FROM ev WHERE entity_id IN (SELECT entity_id FROM sco WHERE risk_tier IN ('HIGH','CRITICAL')) "
    "UNION ALL SELECT entity_id, 'entity', risk_tier || ' ' || n_rules || ' ' || rules FROM sco WHERE risk_tier IN ('HIGH','CRITICAL') AND entity_id IN (SELECT entity_id FROM mem) "
    "UNION ALL SELECT entity_id, 'evidence', 'STR-1 row_' || unnest([raw_row_ref, r2, r3]) FROM str1"
)
def bundle_documents(spark, sf):
    """Bundles written as sorted lines and read back; evidence of one rule is compared."""
    e, s = cw.stored(spark, sf), cw.scored(spark, sf)
    lines = storage.bundle_lines(
        s, cw.entities(spark, sf), cw.firings(spark, sf), cw.evidence(spark, sf), graph.direct_counterparties(cw.edges(spark, sf), s), e.drop("ts")
    )
    path = _place(spark, "bundle-lines")
    storage.write_bundle_lines(lines, path)
    schema = "section string, entity_id string, rule_id string, severity string, token string, raw_row_ref bigint, event_type string, us bigint, risk_tier string, n_rules bigint, rules_fired array<string>"
    d = spark.read.text(path).select(F.from_json("value", schema).alias("x")).select("x.*")
    body = (
        F.when(F.col("section") == "finding", F.concat_ws(" ", "rule_id", "severity"))
        .when(F.col("section") == "event", F.concat_ws(" ", "raw_row_ref", "event_type", "us"))
        .when(F.col("section") == "entity", F.concat("risk_tier", F.lit(" "), "n_rules", F.lit(" "), F.array_join("rules_fired", ",")))
        .otherwise(F.concat_ws(" ", "rule_id", "token"))
    )
    shown = (F.col("section") != "counterparty") & ((F.col("section") != "evidence") | ((F.col("rule_id") == "STR-1") & F.col("token").startswith("row_")))
    return d.where(shown).select("entity_id", "section", body.alias("body"))


@query(
    "SELECT entity_id, source_file, raw_row_ref, us, event_type, round(coalesce(amount, 0), 4) AS amount, coalesce(counterparty, '') AS counterparty, coalesce(location, '') AS location FROM ev"
)
def entity_trace_rows(spark, sf):
    """Raw rows of every trace bundle."""
    _, _, raw = reports.trace_bundle(cw.scored(spark, sf), cw.entities(spark, sf), cw.firings(spark, sf), cw.evidence(spark, sf), cw.stored(spark, sf))
    return raw.withColumn("amount", F.round("amount", 4))


@query(
    "SELECT 'rule_firings' AS part, rule_id AS key, CAST(count(*) AS VARCHAR) AS value FROM fir GROUP BY 2 "
    "UNION ALL SELECT 'entity_findings', entity_id || ' ' || rule_id, severity FROM fir "
    "UNION ALL SELECT 'entities', entity_id, risk_tier || ' ' || n FROM (SELECT s.*, (SELECT count(*) FROM mem m WHERE m.entity_id = s.entity_id AND id_type = 'account') AS n, "
    "row_number() OVER (ORDER BY CASE risk_tier WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, n_rules DESC, entity_id) AS rn FROM sco s WHERE risk_tier <> 'LOW') WHERE rn <= 40 "
    "UNION ALL SELECT 'top_transfers', src || '>' || dst, CAST(cnt AS VARCHAR) FROM (SELECT * FROM edg WHERE edge_type = 'transaction' ORDER BY round(weight, 4) DESC, src, dst LIMIT 12) "
    "UNION ALL SELECT 'entities_omitted', '', CAST(greatest((SELECT count(*) FROM sco WHERE risk_tier <> 'LOW') - 40, 0) AS VARCHAR) "
    "UNION ALL SELECT 'layering_chains', origin, array_to_string(path, '>') FROM best"
)
def run_digest(spark, sf):
    """The digest of a run, its tables stacked."""
    s = cw.scored(spark, sf)
    parts = reports.run_digest(s, cw.stored(spark, sf), cw.entities(spark, sf), cw.firings(spark, sf), cw.edges(spark, sf), cw.best_chains(spark, sf))
    show = {
        "rule_firings": ("rule_id", F.col("firings")), "entity_findings": (F.concat_ws(" ", "entity_id", "rule_id"), F.col("severity")),
        "entities": ("entity_id", F.concat_ws(" ", "risk_tier", "n_accounts")), "top_transfers": (F.concat_ws(">", "src", "dst"), F.col("count")),
        "entities_omitted": (F.lit(""), F.col("omitted")), "layering_chains": ("origin", F.array_join("path", ">")),
    }
    out = None
    for name, (key, value) in show.items():
        key = F.col(key) if isinstance(key, str) else key
        rows = parts[name].select(F.lit(name).alias("part"), key.alias("key"), value.cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------------------ stored tables


@query("SELECT entity_id, raw_row_ref, us, event_type FROM ev")
def stored_timeline(spark, sf):
    """The event table laid out by entity and time; reading it back needs no sort."""
    path = _place(spark, "timeline")
    storage.write_by_entity(cw.events(spark, sf), path, ["us", "raw_row_ref"])
    return storage.read_by_entity(spark, path).select("entity_id", "raw_row_ref", "us", "event_type")


@query(
    "SELECT storage_path, max(doc_id) AS created_at, CASE WHEN max(doc_id) % 2 = 0 THEN 'evidence' ELSE 'str_report' END AS kind, arg_max(sha256(text), doc_id) AS sha256 FROM (SELECT *, lang || '/' || source || '/' || doc_id % 97 AS storage_path FROM documents WHERE doc_id % 5 > 0) GROUP BY 1"
)
def registry_upsert(spark, sf):
    """Documents put into the registry on disk in two goes; every fifth has an unknown kind."""
    d = cw.table(spark, sf, "documents").select(
        F.concat_ws("/", "lang", "source", F.col("doc_id") % 97).alias("storage_path"), F.lit("c").alias("case_id"),
        F.expr("case when doc_id % 5 = 0 then 'photo' when doc_id % 2 = 0 then 'evidence' else 'str_report' end").alias("kind"),
        F.lit(None).cast("string").alias("entity_id"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("created_at"),
    )
    path = _place(spark, "registry")
    storage.upsert_registry(d.where("created_at % 3 = 0"), path)
    storage.upsert_registry(d.where("created_at % 3 > 0"), path)
    return storage.read_registry(spark, path).select("storage_path", "created_at", "kind", "sha256")


# ------------------------------------------------------------------- reference documents


@query("SELECT 'TW-' || s_suppkey AS key, s_nationkey * 1.5 AS lat, s_suppkey % 90 + 0.25 AS lon, s_name AS label FROM supplier WHERE s_suppkey % 10 > 0")
def tower_file(spark, sf):
    """Suppliers as a tower list; every tenth has no readable place."""
    path = _place(spark, "towers")
    rows = cw.table(spark, sf, "supplier").select(
        F.concat(F.lit("tw-"), "s_suppkey").alias("Tower ID"), (F.col("s_nationkey") * 1.5).cast("string").alias("Lat"),
        F.when(F.col("s_suppkey") % 10 > 0, F.col("s_suppkey") % 90 + 0.25).cast("string").alias("Long"), F.col("s_name").alias("Address"),
    )
    rows.write.option("header", True).csv(path)
    first = next(p for p in reference.list_files(spark, path, ".csv"))
    return reference.tower_master(spark, first, path).where("startswith(key, 'TW-')").select("key", "lat", "lon", "label")


@query(
    "SELECT 'E' || s_suppkey AS truth_id, typology, identifier, expected FROM (SELECT s_suppkey, ['STR-1','LAY-1','MUL-1'][s_suppkey % 3 + 1] AS typology, "
    "unnest(['9' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'ACC_' || s_suppkey]) AS identifier, 'bank_row_' || s_nationkey AS expected FROM supplier)"
)
def truth_file(spark, sf):
    """Suppliers written as documents of labelled truth, a thousand in each, and read back."""
    s = cw.table(spark, sf, "supplier").withColumn("doc", F.expr("s_suppkey div 1000"))
    ids = F.struct(
        F.array(F.concat(F.lit("9"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).alias("phones"), F.array(F.concat(F.lit("ACC_"), "s_suppkey")).alias("accounts")
    )
    entry = F.struct(
        F.concat(F.lit("E"), "s_suppkey").alias("entity_id"), F.element_at(F.array(*[F.lit(t) for t in ("STR-1", "LAY-1", "MUL-1")]), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("typology"),
        ids.alias("raw_identifiers"), F.array(F.concat(F.lit("bank_row_"), "s_nationkey")).alias("expected_flagged_rows"),
    )
    path = _place(spark, "truth")
    docs = s.groupBy("doc").agg(F.collect_list(entry).alias("entities")).withColumn("normal_entities", F.lit(40))
    docs.repartition("doc").write.partitionBy("doc").json(path)
    truth, names, rows = reference.read_truth(spark, path)
    return truth.select("truth_id", "typology").join(names, "truth_id").join(rows.withColumnRenamed("token", "expected"), "truth_id")
