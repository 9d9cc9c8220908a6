import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evifuse.plans.fusion import fuse_folder
from evifuse.sources import audit, files, reference, statements

BANK = """account_no,date,particulars,withdrawal_amt,deposit_amt,closing_balance
A1,2025/05/01 09:00:00,NEFT-CREDIT-679392876776-SALARY,,300000,310000
A1,2025/05/01 10:00:00,UPI-DEBIT-195544399726-ravi@ok,49999,,
A1,2025/05/01 11:00:00,UPI-DEBIT-195544399727-ravi@ok,49998,,
A1,2025/05/01 12:00:00,UPI-DEBIT-195544399728-ravi@ok,"49,997",,
A1,2025/05/01 12:00:00,UPI-DEBIT-195544399728-ravi@ok,49997,,
A1,soon,UPI-DEBIT-1-x@y,10,,
A1,2025/05/02 12:00:00,UPI-DEBIT-1-x@y,,,
"""
SLASH = """Txn Date;Value Date;Description;Debit;Credit;Balance
17-03-2026;17-03-2026;UPI/yahvi.kala@okhdfcbank/chukvani;19328.45;;12863.55
08-03-2026;08-03-2026;RTGS/19546636166/rok'am jama;;6599.47;19463.02
"""
CDR = """A_PARTY,B_PARTY,CALL_TYPE,START_TIME,DURATION_SEC,CELL_ID,IMEI
9000000001,9000000002,MOC,2025-05-01 09:58:00,81,SRT-T01,073815055049206
9000000001,9000000002,SMS,2025-05-01 10:10:00,,,073815055049206
"""
IPDR = """MSISDN,PRIVATE_IP,PUBLIC_IP,PORT,SESSION_START,SESSION_END,DEST_IP,DATA_VOLUME_KB
9000000001,10.0.0.1,103.21.4.4,15714,2025-05-01 09:57:00,2025-05-01 10:30:00,134.3.66.80,106895
,10.0.0.1,103.211.4.4,15714,2025-05-01 09:57:00,2025-05-01 10:30:00,,1
"""
KYC = {
    "9000000001": {"name": "Asha", "phones": ["9000000001"], "accounts": ["A1"], "vpas": ["asha@ok"], "imeis": ["073815055049206"]},
    "A1": {"name": "Asha", "phones": ["9000000001"], "accounts": ["A1"], "vpas": ["asha@ok"], "imeis": ["073815055049206"]},
    "9000000002": {"name": "Ravi", "phones": ["9000000002"], "accounts": [], "vpas": ["ravi@ok"], "imeis": [], "ips": []},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("case")
    (d / "bank_hdfc.csv").write_text(BANK)
    (d / "sbi_march.csv").write_text(SLASH)
    (d / "cdr.csv").write_text(CDR)
    (d / "ipdr.csv").write_text(IPDR)
    (d / "notes.csv").write_text("colour,shape\nred,round\n")
    (d / "kyc_map(1).json").write_text(json.dumps(KYC))
    return str(d)


def test_header_detection(spark):
    heads = {
        "a": ["MSISDN", "PUBLIC_IP", "DEST_IP"], "b": CDR.split("\n")[0].split(","),
        "c": ["S.No", "Account No", "Date", "Description", "Amount", "Type (DR/CR)", "Bal."], "d": ["sms text"], "e": ["colour", "shape"],
    }
    rows = [(f, c) for f, cs in heads.items() for c in cs]
    got = {r["file"]: (r["detected_type"], r["confidence"]) for r in statements.detect_types(spark.createDataFrame(rows, "file string, column string")).collect()}
    assert got["a"][0] == "ipdr" and got["b"] == ("cdr", 1.0) and got["c"][0] == "bank"
    assert got["d"] == ("cdr", 0.5) and got["e"] == ("unknown", 0.0)
    assert statements.header_fields(["Value Date", "Txn Date"])["date"] == "Txn Date"
    assert statements.split_header("a;b;c") == (";", ["a", "b", "c"])


def test_ingest_accounts_for_every_row(spark, folder):
    got = statements.ingest_folder(spark, folder)
    status = {f["filename"]: (f["detected_type"], f["status"]) for f in got.files.collect()}
    assert status["notes.csv"] == ("unknown", "UNRECOGNISED") and status["bank_hdfc.csv"] == ("bank", "PARSED")
    rows = got.events.withColumn("reject_reason", F.lit(None).cast("string")).select("source_file", "reject_reason").unionByName(got.rejects.select("source_file", "reject_reason"))
    acc = {r["source_file"]: r for r in statements.row_accounting(rows).collect()}
    b = acc["bank_hdfc.csv"]
    assert (b["total_rows"], b["parsed_rows"], b["skipped_rows"], b["unparseable_date"], b["missing_or_zero_amount"]) == (7, 5, 2, 1, 1)
    assert all(r["parsed_rows"] + r["skipped_rows"] == r["total_rows"] for r in acc.values())
    e = {(r["source_file"], r["raw_row_ref"]): r for r in got.events.collect()}
    assert e["bank_hdfc.csv", 3]["amount"] == -49997.0 and e["bank_hdfc.csv", 0]["amount"] == 300000.0
    assert e["bank_hdfc.csv", 1]["utr"] == "195544399726" and e["bank_hdfc.csv", 1]["counterparty"] == "ravi@ok"
    assert e["sbi_march.csv", 0]["entity_ref"] == "ACCT_SBI" and e["sbi_march.csv", 1]["amount"] == 6599.47
    assert e["cdr.csv", 0]["imei"] == "073815055049206" and e["cdr.csv", 1]["event_type"] == "sms"
    assert e["cdr.csv", 1]["location"] is None and e["cdr.csv", 0]["end_us"] - e["cdr.csv", 0]["us"] == 81_000_000
    assert e["ipdr.csv", 1]["entity_ref"] == "103.211.4.4" and e["ipdr.csv", 1]["location"] is None
    assert e["ipdr.csv", 0]["location"] == "Mumbai" and e["ipdr.csv", 0]["_port"] == 15714


def test_row_numbers_over_many_blocks(spark, tmp_path):
    for name, n in (("a.csv", 5000), ("b.csv", 1234)):
        (tmp_path / name).write_text("id,date\n" + "".join(f"{name}{i},2025-01-01\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        d = statements.read_rows(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ",", ["id", "date"])
        assert d.count() == 6234
        assert d.where(F.col("id") != F.concat("source_file", "raw_row_ref")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_type_column_and_signed_amounts(spark):
    d = spark.createDataFrame(
        [("01/06/25 21:53:47", "500.00", "CR"), ("01/06/25 21:53:47", "500.00", "DR"), ("01/06/25 21:53:47", "-7", "CR")], "Date string, Amount string, `Type (DR/CR)` string"
    ).withColumn("source_file", F.lit("icici.csv")).withColumn("raw_row_ref", F.monotonically_increasing_id())
    got = statements.normalise_bank(d, statements.header_fields(["Date", "Amount", "Type (DR/CR)"]))
    assert sorted(r["amount"] for r in got.collect()) == [-500.0, -7.0, 500.0]
    none = statements.normalise_bank(d, {"amount": "Amount"})
    assert {r["reject_reason"] for r in none.collect()} == {"no_date_column"}


def test_rows_taken_from_a_document(spark):
    head = ["S.No", "Account No", "Date", "Description", "Amount", "Type (DR/CR)", "Bal."]
    rows = [
        ["1", "77", "01/06/25 10:00:00", "UPI/500000/a@b", "500.00", "CR", "1"], head, ["2", "77", "01/06/25 10:00:00", "x", "", "DR", "1"],
        ["only", "three", "cells"], ["3", "77", "01/06/25 11:00:00", "x", "9", "DR", "1"],
    ]
    d = spark.createDataFrame([(r, "icici.txt", n) for n, r in enumerate(rows)], "cells array<string>, source_file string, raw_row_ref bigint")
    got = statements.normalise_extracted(d, head)
    assert {r["raw_row_ref"]: (r["amount"], r["reject_reason"]) for r in got.collect()} == {
        0: (500.0, None), 2: (0.0, "missing_or_zero_amount"), 3: (None, "column_count_mismatch"), 4: (-9.0, None),
    }
    acc = statements.row_accounting(got).first()
    assert (acc["total_rows"], acc["parsed_rows"], acc["skipped_rows"], acc["column_count_mismatch"]) == (4, 2, 2, 1)


def test_kyc_flat_and_structured(spark, folder, tmp_path):
    got = reference.read_kyc(spark, reference.find_kyc_file(spark, folder))
    assert got.where("entry = 'A1'").count() == 4 and got.where("name = 'Ravi'").count() == 2
    p = tmp_path / "flat_kyc.json"
    p.write_text(json.dumps({"9846913810": "Asha", "asha@ok": "Asha", "1.2.3.4": "Ravi"}))
    flat = {(r["entry"], r["id_type"]) for r in reference.read_kyc(spark, str(p)).collect()}
    assert flat == {("Asha", "phone"), ("Asha", "vpa"), ("Ravi", "ip")}


def test_tower_master_overrides(spark, tmp_path):
    p = tmp_path / "tower_master.csv"
    p.write_text("Tower ID,Cell ID,Lat,Long,Address\nsrt-t01,404.0,10.5,70.5,Here\nNEW-1,,x,70,bad\n")
    t = {r["key"]: r for r in reference.tower_master(spark, str(p)).collect()}
    assert t["SRT-T01"]["lat"] == 10.5 and t["404"]["label"] == "Here" and "NEW-1" not in t and len(t) == 30
    from tests.util import at, call, events

    e = events(spark, [call("A", at(0), location="srt-t01"), call("A", at(1), location="404.7"), call("A", at(2), location="Pune")])
    got = [r["place"]["label"] for r in reference.place_events(e, reference.tower_master(spark, str(p))).orderBy("us").collect()]
    assert got == ["Here", "Here", "Pune"]


def test_truth_document(spark, tmp_path):
    p = tmp_path / "ground_truth.json"
    p.write_text(json.dumps({"normal_entities": 40, "guilty_entity_ids": ["E1"], "entities": [{"entity_id": "E1", "typology": "STR-1", "name": "n", "raw_identifiers": {"phones": ["9"], "accounts": ["A"], "imeis": [], "vpas": ["v@x"], "ips": ["1"]}, "expected_flagged_rows": ["bank_row_1"]}]}, indent=1))
    truth, ids, rows = reference.read_truth(spark, str(p))
    assert truth.first()["typology"] == "STR-1" and sorted(r["identifier"] for r in ids.collect()) == ["9", "A", "v@x"]
    assert rows.first()["token"] == "bank_row_1"


def test_whole_run_from_a_folder(spark, folder):
    run = fuse_folder(spark, folder, anomalies=True)
    score = {r["entity_id"]: r for r in run.scored.collect()}
    asha = run.members.where("identifier = 'A1'").first()["entity_id"]
    assert run.members.where("identifier = '9000000001'").first()["entity_id"] == asha
    assert set(score[asha]["rules_fired"]) >= {"STR-1", "TCS-1", "TCS-2"} and score[asha]["risk_tier"] == "HIGH"
    ravi = run.members.where("identifier = 'ravi@ok'").first()["entity_id"]
    edge = run.edges.where((F.col("src") == asha) & (F.col("dst") == ravi)).first()
    assert edge["edge_type"] == "transaction" and edge["count"] == 4 and edge["call_frequency"] == 2
    assert run.evidence.where("rule_id = 'TCS-2' and token = 'called:9000000002'").count() >= 1
    m = {r["filename"]: r for r in run.extra["manifest"].collect()}
    b = m["bank_hdfc.csv"]
    assert (b["status"], b["detected_type"], b["total_rows"], b["parsed_rows"], b["sha256"]) == ("PARSED", "bank", 7, 5, hashlib.sha256(BANK.encode()).hexdigest())
    assert m["notes.csv"]["status"] == "UNRECOGNISED" and m["kyc_map(1).json"]["status"] == "REFERENCE" and len(m) == 6


def test_manifest_and_tampering(spark, tmp_path):
    d = tmp_path / "ev"
    d.mkdir()
    (d / "a.csv").write_text("x\n1\n")
    (d / "k.json").write_text("{}")
    (d / "z.csv").write_text("new")
    (d / "ground_truth.json").write_text("{}")
    first = [tuple(r) for r in audit.read_digests(spark, str(d)).collect()]
    before = spark.createDataFrame(first, "filename string, size_bytes bigint, sha256 string").where("filename <> 'z.csv'")
    stats = spark.createDataFrame([("a.csv", "PARSED", 1)], "filename string, status string, total_rows bigint")
    m = {r["filename"]: (r["status"], r["size_bytes"]) for r in audit.file_manifest(audit.read_digests(spark, str(d)), stats).collect()}
    assert m == {"a.csv": ("PARSED", 4), "k.json": ("REFERENCE", 2), "z.csv": ("NOT INGESTED", 3)}
    (d / "a.csv").write_text("x\n2\n")
    t = {r["filename"]: r["modified_since_ingest"] for r in audit.tamper_check(before, audit.read_digests(spark, str(d))).collect()}
    assert t == {"a.csv": True, "k.json": False, "z.csv": False}


def test_a_file_above_two_gigabytes_is_digested(spark, tmp_path):
    """Sparse, so it takes no room; read in chunks, so it takes no memory."""
    size = (2 << 30) + 12_345
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "small one.txt").write_bytes(b"abc" * 1000)
    want, left = hashlib.sha256(), size
    while left:
        n = min(left, 1 << 24)
        want.update(bytes(n))
        left -= n
    got = {r["filename"]: (r["size_bytes"], r["sha256"]) for r in audit.read_digests(spark, str(tmp_path)).collect()}
    assert got == {"big.bin": (size, want.hexdigest()), "small one.txt": (3000, hashlib.sha256(b"abc" * 1000).hexdigest())}
    assert files.digest(str(tmp_path / "small one.txt"), chunk=7) == got["small one.txt"][1]


def test_headers_are_read_in_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffx;y;z\r\n1;2;3\r\n")
    (tmp_path / "b.CSV").write_text("")
    (tmp_path / "c.txt").write_text("p,q")
    got = {r["filename"]: (r["sep"], r["columns"]) for r in files.file_headers(spark, str(tmp_path), ".csv").collect()}
    assert got == {"a.csv": (";", ["x", "y", "z"]), "b.CSV": (",", [""])}
    none = statements.ingest_folder(spark, str(tmp_path))
    assert none.events is None and none.files.count() == 2


def test_artifact_registry_and_trace(spark, tmp_path):
    s = "case_id string, kind string, entity_id string, storage_path string, sha256 string, created_at bigint"
    old = spark.createDataFrame([("c", "evidence", None, "p1", "s1", 1)], s)
    new = spark.createDataFrame([("c", "evidence", None, "p1", "s2", 2), ("c", "str_report", "E", "p2", "s3", 2), ("c", "photo", None, "p3", "s4", 2)], s)
    got = {r["storage_path"]: r["sha256"] for r in audit.upsert_artifacts(old, new).collect()}
    assert got == {"p1": "s2", "p2": "s3"}
    assert audit.artifacts_by(audit.upsert_artifacts(old, new), entity_id="E").count() == 1
    f = spark.createDataFrame([("A", "STR-1", "HIGH", "why"), ("B", "STR-1", "HIGH", "why")], "entity_id string, rule_id string, severity string, explanation string")
    ev = spark.createDataFrame([("A", "STR-1", "row_1")], "entity_id string, rule_id string, token string")
    for _ in range(2):
        audit.write_trace(f, ev, str(tmp_path / "trace"))
    back = audit.read_trace(spark, str(tmp_path / "trace"), "A").collect()
    assert len(back) == 1 and back[0]["rule_id"] == "STR-1" and back[0]["timestamp"] is not None
