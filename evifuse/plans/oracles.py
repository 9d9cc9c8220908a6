"""ANSI SQL (as DuckDB reads it) for the registered queries, written from the definitions.

Named subqueries are shared; ``sql`` puts those a query needs in front of it.
"""
from __future__ import annotations

from evifuse.functions.geo import ADDRESS_PREFIXES, CITIES, TOWERS
from evifuse.sources.statements import HEADERS, TYPE_FIELDS, TYPE_WORDS

MIN = 60_000_000
HOUR = 60 * MIN
DAY = 24 * HOUR


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + _list(values)[1:-1] + ")"


_coords = {n: (a, b) for n, a, b in CITIES}
_first = {}
for _t in TOWERS:
    _first.setdefault(_t[0].split("-")[0], _t)
# Order in which city names and tower prefixes are matched on the map.
_map_order = ("Mumbai", "Delhi", "Bangalore", "Ahmedabad", "Surat", "Pune", "Hyderabad", "Chennai")


def _asof(side: str, types: str, w: int) -> str:
    """Nearest row per transaction within w; ties back in time, then by row number."""
    return f"""
SELECT * FROM (
  SELECT t.raw_row_ref, t.entity_id, t.us, t.amount, c.raw_row_ref AS {side}_ref, c.counterparty AS {side}_cp,
         c.location AS {side}_loc, c.imei AS {side}_imei,
         row_number() OVER (PARTITION BY t.raw_row_ref ORDER BY abs(t.us - c.us), c.us > t.us,
            CASE WHEN c.us > t.us THEN c.raw_row_ref ELSE -c.raw_row_ref END) AS rn
  FROM (SELECT * FROM ev WHERE event_type = 'transaction') t
  JOIN (SELECT * FROM ev WHERE event_type IN {types}) c
    ON c.entity_id = t.entity_id AND c.us BETWEEN t.us - {w} AND t.us + {w}
) WHERE rn = 1"""


CTE: dict[str, str] = {}

CTE["ev0"] = """SELECT event_id, ts, epoch_us(ts) AS us, user_id AS u, event_type AS et, value,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events"""

CTE["ev"] = f"""SELECT event_id AS raw_row_ref, ts, us, u, k, 'U' || u AS entity_id,
  CASE WHEN et IN ('purchase','signup') THEN 'transaction' WHEN et = 'click' THEN 'call' WHEN et = 'error' THEN 'sms' ELSE 'ip_session' END AS event_type,
  CASE WHEN et IN ('purchase','signup') THEN 'ACC_' || u || CASE WHEN k % 50 = 0 THEN '_2' WHEN k % 25 = 0 THEN '_1' ELSE '' END
       ELSE CASE WHEN k % 25 = 0 THEN '8' ELSE '9' END || lpad(CAST(u AS VARCHAR), 9, '0') END AS entity_ref,
  CASE et WHEN 'purchase' THEN -value WHEN 'signup' THEN value END AS amount,
  CASE WHEN et IN ('click','error') THEN '9' || lpad(CAST(k AS VARCHAR), 9, '0')
       WHEN et = 'view' THEN '10.0.' || k || '.1'
       WHEN event_id % 3 = 0 THEN '9' || lpad(CAST(k AS VARCHAR), 9, '0') || '@okbank' ELSE 'ACC_' || k END AS counterparty,
  CASE WHEN et IN ('click','error') THEN {_list(t[0] for t in TOWERS)}[k % {len(TOWERS)} + 1]
       WHEN et = 'view' THEN {_list(c for _, c in ADDRESS_PREFIXES)}[k % {len(ADDRESS_PREFIXES)} + 1] END AS location,
  CASE WHEN et = 'view' THEN '103.' || (21 + k % 8) || '.' || (u % 250) || '.' || (u // 250) END AS public_ip,
  CASE WHEN et IN ('click','error') AND k % 17 <> 0 THEN '35' || lpad(CAST((u // 3) * 2 + CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END AS VARCHAR), 13, '0') END AS imei,
  CASE WHEN et IN ('click','error') THEN '404' || lpad(CAST(u * 2 + CASE WHEN k % 30 = 0 THEN 1 ELSE 0 END AS VARCHAR), 12, '0') END AS imsi,
  CASE WHEN et IN ('purchase','signup') THEN ['bank_hdfc.csv','bank_sbi.csv','bank_icici.csv'][u % 3 + 1] WHEN et = 'view' THEN 'ipdr_export.csv' ELSE 'cdr_export.csv' END AS source_file,
  CASE WHEN et = 'view' THEN us + k * {MIN} WHEN et IN ('click','error') THEN us + k * 1000000 END AS end_us
  FROM ev0"""

CTE["idm"] = """SELECT identifier, CASE WHEN identifier LIKE 'ACC%' THEN 'U' || regexp_extract(identifier, '^ACC_([0-9]+)', 1)
  ELSE 'U' || CAST(CAST(substr(split_part(identifier, '@', 1), 2) AS BIGINT) AS VARCHAR) END AS entity_id
  FROM (SELECT entity_ref AS identifier FROM ev UNION SELECT counterparty FROM ev WHERE event_type <> 'ip_session')"""

CTE["mem"] = """SELECT entity_id, identifier, CASE WHEN identifier LIKE '%@%' THEN 'vpa' WHEN identifier LIKE 'ACC%' THEN 'account' ELSE 'phone' END AS id_type FROM idm
  UNION ALL SELECT DISTINCT entity_id, imei, 'imei' FROM ev WHERE imei IS NOT NULL"""

CTE["near_call"] = _asof("call", "('call','sms')", 240 * MIN)
CTE["near_ses"] = _asof("session", "('ip_session')", 240 * MIN)
CTE["enr"] = """SELECT t.*, c.call_ref, c.call_cp, c.call_loc, c.call_imei, s.session_ref, s.session_cp, s.session_loc,
  c.call_ref IS NOT NULL AS has_call, s.session_ref IS NOT NULL AS has_session
  FROM (SELECT * FROM ev WHERE event_type = 'transaction') t
  LEFT JOIN near_call c ON c.raw_row_ref = t.raw_row_ref LEFT JOIN near_ses s ON s.raw_row_ref = t.raw_row_ref"""

CTE["fan"] = """SELECT entity_id, imei, entity_ref AS msisdn, arg_min(raw_row_ref, us) AS first_row_ref,
  count(*) OVER (PARTITION BY entity_id, imei) AS msisdn_count
  FROM ev WHERE imei IS NOT NULL GROUP BY entity_id, imei, entity_ref QUALIFY msisdn_count >= 2"""

CTE["swp"] = f"""SELECT s.*, EXISTS (SELECT 1 FROM ev t WHERE t.event_type = 'transaction' AND t.entity_id = s.entity_id
    AND t.us BETWEEN s.us - {60 * MIN} AND s.us + {60 * MIN}) AS nearby
  FROM (SELECT entity_id, entity_ref AS number, us, raw_row_ref, imei, imsi,
      last_value(imei IGNORE NULLS) OVER w AS old_imei, last_value(imsi IGNORE NULLS) OVER w AS old_imsi,
      lag(us) OVER (PARTITION BY entity_id, entity_ref ORDER BY us, raw_row_ref) AS prev_us,
      lag(raw_row_ref) OVER (PARTITION BY entity_id, entity_ref ORDER BY us, raw_row_ref) AS prev_ref
    FROM ev WINDOW w AS (PARTITION BY entity_id, entity_ref ORDER BY us, raw_row_ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s
  WHERE coalesce(imei <> old_imei, false) OR coalesce(imsi <> old_imsi, false)"""
CTE["swaps"] = """SELECT *, coalesce(imei <> old_imei, false) AS dev, coalesce(imsi <> old_imsi, false) AS sim,
  CASE WHEN coalesce(imei <> old_imei, false) AND coalesce(imsi <> old_imsi, false) THEN 'HIGH' WHEN nearby THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM swp"""
CTE["swap1"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY number, us, raw_row_ref) AS rn FROM swaps) WHERE rn = 1"
CTE["limbs"] = """SELECT DISTINCT entity_id, 2 AS grade, 'd' || imei AS limb FROM fan
  UNION ALL SELECT entity_id, 1, 'a' FROM mem WHERE id_type = 'account' GROUP BY entity_id HAVING count(DISTINCT identifier) >= 3
  UNION ALL SELECT entity_id, 1, 'i' FROM mem WHERE id_type = 'imei' GROUP BY entity_id HAVING count(DISTINCT identifier) >= 2
  UNION ALL SELECT entity_id, CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END, 's' FROM swap1"""
CTE["idr"] = """SELECT entity_id, count(*) AS limbs, CASE WHEN max(grade) = 2 OR (max(grade) = 1 AND count(*) > 1) THEN 'HIGH' WHEN max(grade) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM limbs GROUP BY entity_id"""

CTE["cpair"] = f"""SELECT t.entity_id, t.raw_row_ref, t.us, t.amount, t.counterparty AS payee, c.counterparty AS party,
    c.raw_row_ref AS call_ref, c.us AS call_us, po.entity_id AS payee_entity, co.entity_id AS callee_entity,
    regexp_replace(c.counterparty, '[^0-9]', '', 'g') AS cd, regexp_replace(t.counterparty, '[^0-9]', '', 'g') AS pd
  FROM (SELECT * FROM ev WHERE event_type = 'transaction') t
  JOIN (SELECT * FROM ev WHERE event_type IN ('call','sms')) c ON c.entity_id = t.entity_id AND c.us BETWEEN t.us - {1440 * MIN} AND t.us - {MIN}
  LEFT JOIN idm po ON po.identifier = t.counterparty LEFT JOIN idm co ON co.identifier = c.counterparty"""
CTE["tcs2"] = """SELECT entity_id, raw_row_ref, party, payee, 'resolved' AS link, count(*) AS n_calls, min(call_us) AS first_us, max(call_us) AS last_us
    FROM cpair WHERE callee_entity = payee_entity GROUP BY ALL
  UNION ALL SELECT entity_id, raw_row_ref, party, payee, 'embedded', count(*), min(call_us), max(call_us)
    FROM cpair WHERE NOT coalesce(callee_entity = payee_entity, false) AND length(cd) >= 10 AND contains(pd, cd) GROUP BY ALL"""

CTE["strw"] = f"""SELECT * FROM (SELECT entity_id, us, raw_row_ref, amount, lead(us, 2) OVER w AS last_us, lead(raw_row_ref, 1) OVER w AS r2, lead(raw_row_ref, 2) OVER w AS r3
  FROM ev WHERE event_type = 'transaction' AND amount < 0 AND abs(amount) >= 25 AND abs(amount) < 50
  WINDOW w AS (PARTITION BY entity_id ORDER BY us, raw_row_ref)) WHERE last_us - us <= {48 * HOUR}"""
CTE["str1"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us, raw_row_ref) AS rn FROM strw) WHERE rn = 1"

CTE["hop"] = """SELECT e.entity_id AS src, m.entity_id AS dst, e.us, e.raw_row_ref AS ref, abs(e.amount) AS amt
  FROM ev e JOIN idm m ON m.identifier = e.counterparty WHERE e.event_type = 'transaction' AND e.amount < 0"""
CTE["walk"] = f"""SELECT src AS origin, dst AS cur, us, amt, [src, dst] AS path, [us] AS uss, [ref] AS refs, [amt] AS amts, false AS cycle, 1 AS depth
    FROM hop WHERE amt >= 20 AND src <> dst
  UNION ALL
  SELECT w.origin, h.dst, h.us, h.amt, list_append(w.path, h.dst), list_append(w.uss, h.us), list_append(w.refs, h.ref), list_append(w.amts, h.amt), h.dst = w.origin, w.depth + 1
    FROM walk w JOIN hop h ON h.src = w.cur AND h.us > w.us AND h.us <= w.us + {48 * HOUR}
      AND h.amt >= w.amt * (1 - 0.20) AND h.amt <= w.amt * (1 - 0.03)
    WHERE NOT w.cycle AND w.depth < 6 AND (h.dst = w.origin OR NOT list_contains(w.path, h.dst))"""
CTE["chains"] = "SELECT * FROM walk WHERE len(path) >= 3"
CTE["best"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY cycle DESC, len(path) DESC, list_zip(uss, refs)) AS rn FROM chains) WHERE rn = 1"

CTE["mulc"] = f"""SELECT c.entity_id, c.us, c.raw_row_ref, c.amount, sum(CAST(round(-d.amount * 10000) AS BIGINT)) / 10000.0 AS outflow, max(d.us) AS last_us
  FROM (SELECT * FROM ev WHERE event_type = 'transaction' AND amount >= 20) c
  JOIN (SELECT * FROM ev WHERE event_type = 'transaction' AND amount < 0) d ON d.entity_id = c.entity_id AND d.us > c.us AND d.us <= c.us + {6 * HOUR}
  WHERE NOT EXISTS (SELECT 1 FROM ev p WHERE p.event_type = 'transaction' AND p.entity_id = c.entity_id AND p.us >= c.us - {DAY} AND p.us < c.us AND abs(p.amount) > 1)
    AND c.entity_id IN (SELECT entity_id FROM ev WHERE event_type = 'transaction' GROUP BY 1 HAVING count(*) >= 3)
  GROUP BY ALL HAVING sum(CAST(round(-d.amount * 10000) AS BIGINT)) / 10000.0 / c.amount >= 0.8"""
CTE["mul1"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us, raw_row_ref) AS rn FROM mulc) WHERE rn = 1"

CTE["place"] = f"""SELECT e.*, coalesce(t.lat, x.lat, a.lat, c.lat) AS lat, coalesce(t.lon, x.lon, a.lon, c.lon) AS lon, coalesce(t.label, x.label, a.label, c.label) AS label
  FROM ev e
  LEFT JOIN (VALUES {", ".join(f"('{t[0]}', {t[1]}, {t[2]}, '{t[3]}, {t[4]}')" for t in TOWERS)}) t(id, lat, lon, label) ON t.id = upper(e.location)
  LEFT JOIN (VALUES {", ".join(f"('{p}', {t[1]}, {t[2]}, '{t[3]}, {t[4]}')" for p, t in _first.items())}) x(p, lat, lon, label) ON starts_with(upper(e.location), x.p)
  LEFT JOIN (VALUES {", ".join(f"('{p}.', {_coords[c][0]}, {_coords[c][1]}, 'IP-Geo ({c})')" for p, c in ADDRESS_PREFIXES)}) a(p, lat, lon, label) ON starts_with(e.public_ip, a.p)
  LEFT JOIN (VALUES {", ".join(f"('{n.upper()}', {a}, {b}, '{n}')" for n, a, b in CITIES)}) c(n, lat, lon, label) ON contains(upper(e.location), c.n)"""
CTE["leg0"] = """SELECT entity_id, us, raw_row_ref, lat, lon, label, event_type, lag(us) OVER w AS pus, lag(raw_row_ref) OVER w AS pref, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
  FROM place WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY us, raw_row_ref)"""
CTE["legs"] = """SELECT *, km / greatest((us - pus) / 1000000.0 / 3600.0, 0.00028) AS kmh FROM (SELECT *, 6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (
  SELECT *, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS h FROM leg0 WHERE pus IS NOT NULL))"""
CTE["loc1"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us, raw_row_ref) AS rn FROM legs WHERE km >= 1 AND kmh > 3000) WHERE rn = 1"

CTE["fir"] = """SELECT entity_id, 'IDR-1' AS rule_id, severity FROM idr
  UNION ALL SELECT DISTINCT entity_id, 'TCS-1', 'MEDIUM' FROM enr WHERE has_call AND has_session
  UNION ALL SELECT DISTINCT entity_id, 'TCS-2', 'MEDIUM' FROM tcs2
  UNION ALL SELECT entity_id, 'STR-1', 'HIGH' FROM str1
  UNION ALL SELECT origin, 'LAY-1', 'HIGH' FROM best
  UNION ALL SELECT entity_id, 'MUL-1', 'HIGH' FROM mul1
  UNION ALL SELECT entity_id, 'LOC-1', 'HIGH' FROM loc1"""
CTE["flags"] = """SELECT entity_id, count(*) AS n_rules, string_agg(rule_id, ',' ORDER BY rule_id) AS rules,
  bool_or(rule_id = 'MUL-1') AS mul, bool_or(rule_id = 'LAY-1') AS lay, bool_or(rule_id = 'STR-1') AS st, bool_or(rule_id = 'LOC-1') AS loc,
  bool_or(rule_id = 'IDR-1') AS idr, bool_or(rule_id IN ('TCS-1','TCS-2')) AS tcs,
  bool_or(rule_id = 'IDR-1' AND severity = 'HIGH') AS ih, bool_or(rule_id = 'IDR-1' AND severity = 'MEDIUM') AS im FROM fir GROUP BY entity_id"""
CTE["sco"] = """SELECT e.entity_id, coalesce(n_rules, 0) AS n_rules, coalesce(rules, '') AS rules,
  CASE WHEN (mul AND tcs) OR (lay AND (idr OR tcs)) OR (ih AND n_rules >= 2) THEN 'CRITICAL'
       WHEN mul OR lay OR st OR loc OR ih OR (idr AND tcs) THEN 'HIGH' WHEN tcs OR im THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
  FROM (SELECT DISTINCT entity_id FROM mem UNION SELECT entity_id FROM fir) e LEFT JOIN flags f ON f.entity_id = e.entity_id"""

CTE["mov"] = """SELECT CASE WHEN e.amount < 0 THEN e.entity_id ELSE m.entity_id END AS src, CASE WHEN e.amount < 0 THEN m.entity_id ELSE e.entity_id END AS dst,
  abs(e.amount) AS amt, e.amount < 0 AS is_debit, e.us, e.raw_row_ref, e.source_file
  FROM ev e JOIN idm m ON m.identifier = e.counterparty WHERE e.event_type = 'transaction' AND e.amount <> 0"""
CTE["flow"] = """SELECT src, dst, sum(CAST(round(amt * 10000) AS BIGINT)) / 10000.0 AS weight, count(*) AS cnt, arg_min(source_file, (us, source_file)) AS source_file,
  bool_or(is_debit) AS from_debit, min(us) AS first_us, max(us) AS last_us
  FROM (SELECT *, bool_or(is_debit) OVER (PARTITION BY src, dst) AS any_debit FROM mov) WHERE is_debit OR NOT any_debit GROUP BY src, dst"""
CTE["talk"] = """SELECT e.entity_id AS src, m.entity_id AS dst, count(*) AS freq, arg_min(source_file, (us, source_file)) AS source_file, min(us) AS first_us, max(us) AS last_us
  FROM ev e JOIN mem m ON m.identifier = e.counterparty AND m.id_type = 'phone' WHERE e.event_type IN ('call','sms') AND e.entity_id <> m.entity_id GROUP BY 1, 2"""
CTE["edg"] = """SELECT coalesce(f.src, t.src) AS src, coalesce(f.dst, t.dst) AS dst, CASE WHEN f.src IS NOT NULL THEN 'transaction' ELSE 'call' END AS edge_type,
  coalesce(f.weight, t.freq * 100.0) AS weight, coalesce(f.cnt, t.freq) AS cnt, t.freq, coalesce(f.source_file, t.source_file) AS source_file,
  least(coalesce(f.first_us, t.first_us), coalesce(t.first_us, f.first_us)) AS first_us, greatest(coalesce(f.last_us, t.last_us), coalesce(t.last_us, f.last_us)) AS last_us
  FROM flow f FULL JOIN talk t ON t.src = f.src AND t.dst = f.dst"""
CTE["chop"] = "SELECT DISTINCT path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM best)"
CTE["cls"] = """SELECT e.*, CASE WHEN h.src IS NOT NULL THEN 'layering'
    WHEN e.edge_type = 'transaction' AND (e.src IN (SELECT entity_id FROM fir WHERE rule_id IN ('TCS-1','TCS-2')) OR e.dst IN (SELECT entity_id FROM fir WHERE rule_id IN ('TCS-1','TCS-2'))) THEN 'smoking_gun'
    WHEN e.edge_type = 'transaction' THEN 'transaction' ELSE 'call' END AS edge_class
  FROM edg e LEFT JOIN chop h ON h.src = e.src AND h.dst = e.dst"""
CTE["deg"] = "SELECT entity_id, count(*) AS degree FROM (SELECT src AS entity_id FROM edg UNION ALL SELECT dst FROM edg) GROUP BY 1"
CTE["vis"] = """SELECT coalesce(d.entity_id, s.entity_id) AS entity_id, coalesce(degree, 0) AS degree, coalesce(risk_tier, 'LOW') AS risk_tier
  FROM deg d FULL JOIN sco s ON s.entity_id = d.entity_id WHERE coalesce(degree, 0) > 0 OR coalesce(risk_tier, 'LOW') <> 'LOW'"""

_INST = """CASE WHEN lower({f}) LIKE '%sbi%' THEN 'SBI Bank' WHEN lower({f}) LIKE '%hdfc%' THEN 'HDFC Bank' WHEN lower({f}) LIKE '%icici%' THEN 'ICICI Bank'
  WHEN lower({f}) LIKE '%cdr%' THEN 'Operator-CDR' WHEN lower({f}) LIKE '%ipdr%' THEN 'Operator-IPDR' WHEN lower({f}) LIKE '%bank%' THEN 'Bank (General)' ELSE 'Other Institution' END"""


def inst(f: str) -> str:
    return _INST.format(f=f)


_CITY = "CASE " + " ".join(f"WHEN contains(lower(location), '{c.lower()}') THEN '{c}'" for c in _map_order) + " " + " ".join(
    f"WHEN starts_with(upper(location), '{p}') THEN '{t[4]}'" for p, t in _first.items()
) + " END"
_TOWER = (
    f"CASE WHEN location IN {_in(t[0] for t in TOWERS)} THEN location "
    + " ".join(f"WHEN starts_with(upper(location), '{p}') THEN '{t[0]}'" for p, t in _first.items())
    + " "
    + " ".join(f"WHEN ({_CITY}) = '{t[4]}' THEN '{t[0]}'" for t in _first.values())
    + " END"
)
CTE["geo"] = f"SELECT *, {_TOWER} AS tower, {_CITY} AS city FROM ev WHERE location IS NOT NULL"
_tower_city = {t[0]: t[4] for t in TOWERS}
CTE["plc"] = f"""SELECT DISTINCT entity_id, kind, value FROM (
  SELECT entity_id, 'institution' AS kind, {inst('source_file')} AS value FROM ev
  UNION ALL SELECT entity_id, 'source_file', source_file FROM ev
  UNION ALL SELECT entity_id, 'city', coalesce(t.city, e.location) FROM ev e LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _tower_city.items())}) t(id, city) ON t.id = e.location) WHERE value IS NOT NULL"""

CTE["nar"] = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, CASE o_orderkey % 7
  WHEN 0 THEN 'UPI/DR/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '/c' || o_custkey || '@bank/Payment'
  WHEN 1 THEN 'UPI-DEBIT-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '-c' || o_custkey || '@bank'
  WHEN 2 THEN 'NEFT-CREDIT-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '-SALARY'
  WHEN 3 THEN 'IMPS-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '-Name ' || o_custkey
  WHEN 4 THEN 'IMPS-P2A/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '/NAME' || o_custkey || '/IFSC0'
  WHEN 5 THEN 'RTGS/' || lpad(CAST(o_orderkey AS VARCHAR), 11, '0') || '/rokam'
  ELSE 'upi/c' || o_custkey || '@ok/chai' END AS narration FROM orders"""
CTE["narx"] = r"""SELECT *, nullif(regexp_extract(narration, '(?:^|[/\-])([0-9]{12})(?:[/\-]|$)', 1), '') AS utr,
  coalesce(nullif(regexp_extract(narration, '([A-Za-z0-9._]+@[A-Za-z0-9]+)', 1), ''),
    CASE WHEN p4 <> '' AND NOT regexp_full_match(p4, '[0-9]+') AND p4 NOT IN ('Payment','CREDIT','DEBIT','CR','DR','P2A','P2M') THEN p4 END) AS counterparty,
  nullif(upper(regexp_extract(narration, '(?i)(UPI|IMPS|NEFT|RTGS)', 1)), '') AS channel
  FROM (SELECT *, trim(string_split_regex(narration, '[/\-]')[4]) AS p4 FROM nar)"""
# The date the statement layout of each order can carry.
CTE["stm"] = """SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE epoch_us(date_trunc('day', o_orderdate)) END AS us,
  CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN -CAST(floor(o_totalprice) AS DOUBLE) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount,
  ['bank_hdfc.csv','sbi_2024.csv','icici.csv','bank_x.csv','misc.csv'][o_custkey % 5 + 1] AS source_file,
  CASE WHEN o_custkey % 3 > 0 THEN 'AC' || o_custkey ELSE ['ACCT_HDFC','ACCT_SBI','ACCT_ICICI','ACCT_UNKNOWN','ACCT_UNKNOWN'][o_custkey % 5 + 1] END AS entity_ref FROM narx"""
CTE["stmr"] = """SELECT *, CASE WHEN us IS NULL THEN 'unparseable_date' WHEN amount = 0 THEN 'missing_or_zero_amount' END AS reject_reason FROM stm"""

# Ownership read off the events, and the components it forms.
CTE["kyc"] = """SELECT DISTINCT entity_ref AS entry, id_type, identifier FROM (
  SELECT entity_ref, 'phone' AS id_type, entity_ref AS identifier FROM ev WHERE event_type <> 'transaction'
  UNION ALL SELECT entity_ref, 'imei', imei FROM ev WHERE event_type IN ('call','sms')
  UNION ALL SELECT entity_ref, 'ip', public_ip FROM ev WHERE event_type = 'ip_session'
  UNION ALL SELECT entity_ref, 'account', entity_ref FROM ev WHERE event_type = 'transaction') WHERE identifier IS NOT NULL"""
CTE["nod"] = """SELECT identifier, arg_min(id_type, (id_type = 'unknown', rank)) AS id_type FROM (
  SELECT 1 AS rank, id_type, identifier FROM kyc
  UNION ALL SELECT 2, CASE WHEN event_type = 'transaction' THEN 'account' ELSE 'phone' END, entity_ref FROM ev
  UNION ALL SELECT 3, CASE WHEN contains(counterparty, '@') THEN 'vpa' ELSE 'account' END, counterparty FROM ev WHERE event_type = 'transaction'
  UNION ALL SELECT 5, 'phone', counterparty FROM ev WHERE event_type IN ('call','sms')
  UNION ALL SELECT 6, 'imei', imei FROM ev WHERE imei IS NOT NULL
  UNION ALL SELECT 8, 'ip', public_ip FROM ev WHERE public_ip IS NOT NULL
  UNION ALL SELECT 9, CASE WHEN contains(counterparty, '.') THEN 'ip' ELSE 'unknown' END, counterparty FROM ev WHERE event_type = 'ip_session') GROUP BY identifier"""
CTE["own"] = "SELECT DISTINCT h.src, k.identifier AS dst FROM kyc k JOIN (SELECT entry, min(identifier) AS src FROM kyc GROUP BY entry) h ON h.entry = k.entry WHERE h.src <> k.identifier"
CTE["lnk"] = "SELECT src AS a, dst AS b FROM own UNION SELECT dst, src FROM own"
CTE["reach"] = """SELECT DISTINCT a AS node, a AS label FROM lnk
  UNION SELECT l.b, r.label FROM reach r JOIN lnk l ON l.a = r.node"""
CTE["cmp"] = "SELECT node AS identifier, min(label) AS component FROM reach GROUP BY node"
CTE["asg"] = "SELECT 'ENT_' || substr(sha256(coalesce(c.component, n.identifier)), 1, 12) AS entity_id, n.identifier, n.id_type FROM nod n LEFT JOIN cmp c ON c.identifier = n.identifier"
CTE["need"] = """SELECT entity_id, count(*) FILTER (id_type IN ('phone','account','imei')) AS need FROM asg GROUP BY entity_id
  HAVING count(*) FILTER (id_type = 'phone') > 1 OR count(*) FILTER (id_type = 'account') > 1 OR count(*) FILTER (id_type = 'imei') > 1"""
CTE["cov"] = """SELECT entity_id, max(n) AS best FROM (SELECT a.entity_id, k.entry, count(*) AS n FROM asg a JOIN need d ON d.entity_id = a.entity_id
  JOIN kyc k ON k.identifier = a.identifier AND k.id_type = a.id_type WHERE a.id_type IN ('phone','account','imei') GROUP BY 1, 2) GROUP BY 1"""
CTE["val"] = """SELECT CASE WHEN d.need > coalesce(c.best, 0) AND a.id_type IN ('phone','account','vpa','imei','ip') THEN a.entity_id || '_' || substr(sha256(a.identifier), 1, 8) ELSE a.entity_id END AS entity_id, a.identifier, a.id_type
  FROM asg a LEFT JOIN need d ON d.entity_id = a.entity_id LEFT JOIN cov c ON c.entity_id = a.entity_id"""

# Labelled truth from the suppliers; entries choose one after the other.
CTE["tru"] = "SELECT 'E' || s_suppkey AS truth_id, s_suppkey AS seq, ['STR-1','LAY-1','MUL-1','IDR-1','LOC-1'][s_suppkey % 5 + 1] AS typology FROM supplier"
CTE["tid"] = """SELECT s_suppkey AS seq, unnest(CASE WHEN s_suppkey % 7 = 6 THEN ['ACC_' || (s_suppkey // 2)] ELSE ['9' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'ACC_' || s_suppkey] END) AS identifier FROM supplier"""
CTE["pref"] = """SELECT seq, entity_id, row_number() OVER (PARTITION BY seq ORDER BY stage, p, entity_id) AS pos FROM (
    SELECT t.seq, m.entity_id, 0 AS stage, -count(*) AS p FROM tid t JOIN mem m ON m.identifier = t.identifier GROUP BY 1, 2
    UNION ALL SELECT t.seq, s.entity_id, 1, -s.n_rules FROM tru t JOIN fir f ON f.rule_id = t.typology JOIN sco s ON s.entity_id = f.entity_id)"""
CTE["opts"] = """SELECT t.seq, coalesce(list(p.entity_id ORDER BY p.pos) FILTER (p.entity_id IS NOT NULL), []) AS opts FROM tru t LEFT JOIN pref p ON p.seq = t.seq GROUP BY t.seq"""
CTE["greedy"] = """SELECT CAST(-1 AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS pick
  UNION ALL SELECT o.seq, CASE WHEN len(list_filter(o.opts, lambda x: NOT list_contains(g.taken, x))) > 0 THEN list_append(g.taken, list_filter(o.opts, lambda x: NOT list_contains(g.taken, x))[1]) ELSE g.taken END,
    list_filter(o.opts, lambda x: NOT list_contains(g.taken, x))[1] FROM greedy g JOIN opts o ON o.seq = g.seq + 1"""
CTE["stat"] = """SELECT t.truth_id, t.typology, g.pick AS detected_as, CASE WHEN g.pick IS NULL THEN 'N/A' ELSE coalesce(s.risk_tier, 'LOW') END AS detected_tier,
  CASE WHEN s.risk_tier IN ('HIGH','CRITICAL') THEN 'DETECTED' WHEN coalesce(s.n_rules, 0) > 0 THEN 'MISSED (below HIGH)' ELSE 'MISSED' END AS status
  FROM tru t LEFT JOIN greedy g ON g.seq = t.seq LEFT JOIN sco s ON s.entity_id = g.pick"""
CTE["fps"] = "SELECT * FROM sco WHERE risk_tier IN ('HIGH','CRITICAL') AND entity_id NOT IN (SELECT detected_as FROM stat WHERE status = 'DETECTED')"

_NEEDS: dict[str, list[str]] = {}


def _needs(name: str) -> list[str]:
    """Subqueries that a text mentions, found by name."""
    import re

    if name not in _NEEDS:
        words = set(re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "", CTE[name])))
        _NEEDS[name] = [n for n in CTE if n in words and n != name]
    return _NEEDS[name]


def sql(final: str) -> str:
    """``final`` with the subqueries it needs in front, in the order they are defined."""
    import re

    want: set[str] = set()
    todo = [n for n in CTE if re.search(rf"\b(?:FROM|JOIN|from|join)\s+{n}\b", final) or re.search(rf",\s*{n}\b", final)]
    while todo:
        n = todo.pop()
        if n not in want:
            want.add(n)
            todo += _needs(n)
    if not want:
        return final
    loops = ("walk", "reach", "greedy")
    parts = [f"{n} AS {'' if n in loops else 'MATERIALIZED '}({CTE[n]})" for n in CTE if n in want]
    if final.startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + final[len("WITH "):]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


def header_oracle() -> str:
    texts = sorted({t for ts in HEADERS.values() for t in ts})
    cells = f"(SELECT 'file_' || o_custkey AS file, {_list(texts)}[(o_orderkey * 7) % {len(texts)} + 1] AS col FROM orders)"

    def score(kind: str) -> str:
        return " + ".join(
            f"max(CASE WHEN col IN {_in(HEADERS[f])} THEN 1 ELSE 0 END)" for f in TYPE_FIELDS[kind]
        )

    words = ", ".join(
        "max(CASE WHEN " + " OR ".join(f"contains(col, '{w}')" for w in ws) + f" THEN 1 ELSE 0 END) AS w_{k}"
        for k, ws in TYPE_WORDS
    )
    return f"""SELECT file, CASE WHEN top > 0 THEN CASE WHEN bank = top THEN 'bank' WHEN cdr = top THEN 'cdr' ELSE 'ipdr' END
      WHEN w_cdr = 1 THEN 'cdr' WHEN w_ipdr = 1 THEN 'ipdr' WHEN w_bank = 1 THEN 'bank' ELSE 'unknown' END AS detected_type,
      round(CASE WHEN top > 0 THEN top / 5.0 WHEN w_cdr + w_ipdr + w_bank > 0 THEN 0.5 ELSE 0.0 END, 4) AS confidence
    FROM (SELECT *, greatest(bank, cdr, ipdr) AS top FROM (SELECT file, {score('bank')} AS bank, {score('cdr')} AS cdr, {score('ipdr')} AS ipdr, {words} FROM {cells} GROUP BY file))"""
