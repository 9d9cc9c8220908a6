import random

from pyspark.sql import functions as F

from evifuse.operators import resolution as R
from tests.util import at, call, events, id_map, session, txn


def comps(spark, pairs, **k):
    got = R.components(spark.createDataFrame(pairs, "src string, dst string"), **k).collect()
    return {r["identifier"]: r["component"] for r in got}


def test_components_path_star_and_rings(spark):
    path = [(f"p{n:03}", f"p{n + 1:03}") for n in range(60)]
    random.Random(1).shuffle(path)
    star = [("s000", f"s{n:03}") for n in range(1, 50)] + [("s999", "s000")]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("x", "x")]
    got = comps(spark, path + star + ring)
    assert {v for k, v in got.items() if k[0] == "p"} == {"p000"} and len([k for k in got if k[0] == "p"]) == 61
    assert {v for k, v in got.items() if k[0] == "s"} == {"s000"}
    assert {v for k, v in got.items() if k[0] == "r"} == {"r1"} and "x" not in got


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(80)}") for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert comps(spark, pairs) == {x: find(x) for x in root}


def kyc(spark, rows):
    return spark.createDataFrame(rows, "entry string, name string, id_type string, identifier string")


def person(key, name, phone, account, vpa, device):
    return [(key, name, "phone", phone), (key, name, "account", account), (key, name, "vpa", vpa), (key, name, "imei", device)]


def test_own_identifiers_merge_and_nothing_else(spark):
    k = kyc(spark, person("k1", "Asha", "9000000001", "A1", "asha@ok", "350000000000001") + person("k2", "Ravi", "9000000002", "A2", "ravi@ok", "350000000000002"))
    e = events(
        spark,
        [txn(None, -5, at(0), p, entity_ref="A1") for p in ("s1@x", "s2@x", "s3@x", "ravi@ok")]
        + [call(None, at(1), "9000000002", entity_ref="9000000001", imei="350000000000001")],
    )
    nodes = R.identity_nodes(k, e)
    m = R.validate_entities(R.assign_entities(nodes, R.ownership_edges(k)), k).collect()
    of = {r["identifier"]: r["entity_id"] for r in m}
    assert len({of[x] for x in ("9000000001", "A1", "asha@ok", "350000000000001")}) == 1
    assert of["A1"] != of["A2"] and of["ravi@ok"] == of["A2"]
    assert len({of["s1@x"], of["s2@x"], of["s3@x"], of["A1"]}) == 4
    from evifuse.operators.graph import build_edges

    members = R.validate_entities(R.assign_entities(nodes, R.ownership_edges(k)), k)
    ev = R.apply_mapping(e, members.select("identifier", "entity_id"))
    edges = build_edges(ev, R.identifier_index(members), R.identifier_index(members, ("phone",)))
    pair = edges.where((F.col("src") == of["A1"]) & (F.col("dst") == of["A2"])).first()
    assert pair["edge_type"] == "transaction" and pair["call_frequency"] == 1
    t = {r["entity_id"]: r for r in R.entity_table(members, k).collect()}
    assert t[of["A1"]]["name"] == "Asha" and t[of["A1"]]["phones"] == ["9000000001"] and t[of["s1@x"]]["name"] == "VPA s1@x"


def test_unvouched_entity_is_split(spark):
    k = kyc(spark, [("a", None, "phone", "1"), ("a", None, "imei", "d"), ("b", None, "phone", "2"), ("b", None, "imei", "d")])
    nodes = k.select("identifier", "id_type").distinct()
    got = R.validate_entities(R.assign_entities(nodes, R.ownership_edges(k)), k)
    assert got.select("entity_id").distinct().count() == 3
    one = kyc(spark, [("a", None, "phone", "1"), ("a", None, "phone", "2")])
    same = R.validate_entities(R.assign_entities(one.select("identifier", "id_type"), R.ownership_edges(one)), one)
    assert same.select("entity_id").distinct().count() == 1


def test_kyc_from_events_never_links_other_parties(spark):
    e = events(
        spark,
        [
            txn(None, -5, at(0), "b@x", entity_ref="ACC1"), call(None, at(0), "999", entity_ref="111", imei="d1"),
            call(None, at(0), "999", entity_ref="111", imei="nan"), session(None, at(0), entity_ref="111", _public_ip="1.1.1.1"),
        ],
    )
    by = lambda t: e.where(F.col("event_type") == t)
    got = {tuple(r) for r in R.kyc_from_events(by("transaction"), by("call"), by("ip_session")).select("entry", "id_type", "identifier").collect()}
    assert got == {("111", "phone", "111"), ("111", "imei", "d1"), ("111", "ip", "1.1.1.1"), ("ACC1", "account", "ACC1")}


def test_apply_mapping_and_lookup(spark):
    e = events(spark, [txn(None, 1, at(0), entity_ref="A1"), txn(None, 1, at(0), entity_ref="A9")])
    got = {r["entity_ref"]: r["entity_id"] for r in R.apply_mapping(e, id_map(spark, [("A1", "E1")])).collect()}
    assert got == {"A1": "E1", "A9": "UNRESOLVED_A9"}
    m = spark.createDataFrame([("E1", "A1", "account")], "entity_id string, identifier string, id_type string")
    w = spark.createDataFrame([("A1",), ("E1",), ("?",)], "key string")
    assert {r["key"]: r["entity_id"] for r in R.lookup_entities(w, m).collect()} == {"A1": "E1", "E1": "E1", "?": None}


def test_mentions(spark):
    m = spark.createDataFrame(
        [("ENT_0043", "9825011234", "phone"), ("ENT_0007", "asha@okaxis", "vpa"), ("ENT_0008", "ACC-778899", "account"), ("ENT_0009", "x", "unknown")],
        "entity_id string, identifier string, id_type string",
    )
    names = spark.createDataFrame([("ENT_0007", "Yashica Issac"), ("ENT_0008", "Issac"), ("ENT_0009", "Bo")], "entity_id string, name string")
    texts = spark.createDataFrame(
        [
            (1, "what about ent 43?"), (2, "call +91 98250-11234 back, or 98250 11234"), (3, "did YASHICA ISSAC pay"), (4, "Issacs"),
            (5, "asha@okaxis alone"), (6, "asha@okaxis with 1234567"), (7, "Bo 778899"), (8, "ENT_0007 ENT-8 and ENT 43 and Yashica Issac"),
        ],
        "text_id bigint, text string",
    )
    got = {}
    for r in R.mention_links(texts, m, names).orderBy("text_id", "rank").collect():
        got.setdefault(r["text_id"], []).append(r["entity_id"])
    assert got == {
        1: ["ENT_0043"], 2: ["ENT_0043"], 3: ["ENT_0007", "ENT_0008"], 4: ["ENT_0008"], 6: ["ENT_0007"], 7: ["ENT_0008"],
        8: ["ENT_0007", "ENT_0008", "ENT_0043"],
    }


def test_component_steps_send_nothing_to_the_driver(spark, monkeypatch):
    plans, cut = [], R.cut

    def planned(df, name="cut", by=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name, by)

    monkeypatch.setattr(R, "cut", planned)
    rows = [(f"n{k:02}", f"n{k + 1:02}") for k in range(30) if k % 10 < 9]
    got = {r["identifier"]: r["component"] for r in R.components(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == {f"n{k:02}": f"n{k // 10 * 10:02}" for k in range(30)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_ownership_takes_one_pass_per_kind(spark):
    """Each kind of event is read once, whatever it tells."""
    cols = "entity_ref string, imei string, _public_ip string"
    bank, cdr, ipdr = (spark.createDataFrame(r, cols) for r in ([("A", None, None)], [("1", "d", None), ("1", "nan", None)], [("1", None, "9.9"), (" ", None, "8.8")]))
    d = R.kyc_from_events(bank, cdr, ipdr)
    assert {tuple(r) for r in d.select("entry", "id_type", "identifier").collect()} == {("A", "account", "A"), ("1", "phone", "1"), ("1", "imei", "d"), ("1", "ip", "9.9")}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
