import pytest
from pyspark.sql import functions as F

from evifuse.operators import graph, reports, scoring
from tests.util import at, call, events, id_map, txn


def firing(spark, rows):
    return spark.createDataFrame([(e, r, s, "why") for e, r, s in rows], "entity_id string, rule_id string, severity string, explanation string")


@pytest.mark.parametrize(
    "rules,want",
    [
        ([("IDR-1", "LOW")], "LOW"), ([("IDR-1", "MEDIUM")], "MEDIUM"), ([("IDR-1", "HIGH")], "HIGH"),
        ([("LAY-1", "HIGH"), ("IDR-1", "LOW")], "CRITICAL"), ([("MUL-1", "HIGH"), ("TCS-1", "MEDIUM")], "CRITICAL"),
        ([("LAY-1", "HIGH"), ("TCS-2", "MEDIUM")], "CRITICAL"), ([("IDR-1", "HIGH"), ("STR-1", "HIGH")], "CRITICAL"),
        ([("MUL-1", "HIGH")], "HIGH"), ([("LAY-1", "HIGH")], "HIGH"), ([("STR-1", "HIGH")], "HIGH"), ([("LOC-1", "HIGH")], "HIGH"),
        ([("IDR-1", "LOW"), ("TCS-1", "MEDIUM")], "HIGH"), ([("TCS-2", "MEDIUM")], "MEDIUM"), ([("STR-1", "HIGH"), ("LOC-1", "HIGH")], "HIGH"),
    ],
)
def test_tier_gate(spark, rules, want):
    assert scoring.risk_tiers(firing(spark, [("E", r, s) for r, s in rules])).first()["risk_tier"] == want


def test_combine_keeps_signals_apart(spark):
    flags = spark.createDataFrame([("B", 0.9, True), ("A", 0.1, False)], "entity_id string, score double, ml_anomaly boolean")
    everyone = spark.createDataFrame([("A",), ("B",), ("C",)], "entity_id string")
    got = {r["entity_id"]: r for r in scoring.combine_scores(firing(spark, [("A", "STR-1", "HIGH")]), flags, everyone).collect()}
    assert (got["A"]["risk_tier"], got["A"]["ml_anomaly"]) == ("HIGH", False)
    assert (got["B"]["risk_tier"], got["B"]["ml_anomaly"], got["B"]["rules_fired"]) == ("LOW", True, [])
    assert got["C"]["risk_tier"] == "LOW"
    assert [r[0] for r in reports.only_anomalous(scoring.combine_scores(firing(spark, [("A", "STR-1", "HIGH")]), flags, everyone)).collect()] == ["B"]


def test_only_anomalous_lists_every_entity(spark):
    flags = spark.createDataFrame([(f"E{n:02}", 0.9, n % 4 > 0) for n in range(60, 0, -1)], "entity_id string, score double, ml_anomaly boolean")
    fired = firing(spark, [(f"E{n:02}", "STR-1", "HIGH") for n in range(1, 61, 5)])
    want = [f"E{n:02}" for n in range(1, 61) if n % 4 > 0 and n % 5 != 1]
    assert len(want) > 15
    assert [r[0] for r in reports.only_anomalous(scoring.combine_scores(fired, flags)).collect()] == want


def test_isolation_forest_properties(spark):
    rows = [(f"e{n}", 1.0 + n % 7 * 0.1, 5.0 + n % 5 * 0.2, 1.0 + n % 3 * 0.05, float(n % 4), 2.0) for n in range(400)] + [("odd", 90.0, 900.0, 40.0, 300.0, 200.0)]
    d = spark.createDataFrame(rows, "entity_id string, " + ", ".join(f"{c} double" for c in scoring.FEATURES))
    a = {r["entity_id"]: r for r in scoring.isolation_flags(d).collect()}
    b = {r["entity_id"]: r for r in scoring.isolation_flags(d.repartition(7)).collect()}
    assert a == b
    assert max(a, key=lambda e: a[e]["score"]) == "odd" and a["odd"]["ml_anomaly"]
    assert 0.02 <= sum(r["ml_anomaly"] for r in a.values()) / len(a) <= 0.11
    few = scoring.isolation_flags(d.limit(4))
    assert few.where("ml_anomaly").count() == 0 and few.count() == 4


def test_features(spark):
    e = events(spark, [txn("A", 100, at(0), "x"), txn("A", -50, at(24), "y"), txn("A", -0.5, at(48), "y"), call("A", at(96), "z"), call("B", at(0), "z")])
    got = {r["entity_id"]: r for r in scoring.entity_features(e).collect()}
    a, b = got["A"], got["B"]
    assert (a["txn_velocity"], a["avg_hold_hours"], a["unique_counterparties"], a["comms_per_day"]) == (1.5, 24.0, 2.0, 0.25)
    assert abs(a["in_out_ratio"] - 100 / 50.5) < 1e-9
    assert (b["txn_velocity"], b["in_out_ratio"], b["comms_per_day"]) == (0.0, 1.0, 1.0)


IDX = [("a", "A"), ("b", "B"), ("c", "C")]


def build(spark, rows):
    i = id_map(spark, IDX)
    return graph.build_edges(events(spark, rows), i, i)


def test_edges_are_directed_and_not_counted_twice(spark):
    rows = [txn("A", -100, at(0), "b"), txn("B", 100, at(0), "a"), txn("B", 40, at(2), "c"), txn("A", -5, at(3), "b"), txn("A", -7, at(4), "nobody"), txn("A", 0, at(4), "b")]
    got = {(r["src"], r["dst"]): r for r in build(spark, rows).collect()}
    assert set(got) == {("A", "B"), ("C", "B")}
    assert (got["A", "B"]["weight"], got["A", "B"]["count"], got["A", "B"]["counted_from_debit"]) == (105.0, 2, True)
    assert (got["C", "B"]["weight"], got["C", "B"]["counted_from_debit"]) == (40.0, False)


def test_calls_merge_into_transfers(spark):
    rows = [txn("A", -100, at(5), "b"), call("A", at(1), "b"), call("A", at(9), "b"), call("B", at(0), "c"), call("C", at(0), "c")]
    got = {(r["src"], r["dst"]): r for r in build(spark, rows).collect()}
    ab = got["A", "B"]
    assert (ab["edge_type"], ab["weight"], ab["call_frequency"], ab["last_us"] - ab["first_us"]) == ("transaction", 100.0, 2, 8 * 3_600_000_000)
    assert (got["B", "C"]["edge_type"], got["B", "C"]["weight"]) == ("call", 100.0)
    assert ("C", "C") not in got


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, edge_type string, weight double, edge_class string, first_us bigint, last_us bigint, count bigint")


def demo(spark):
    return edges(
        spark,
        [
            ("A", "B", "transaction", 10.0, "layering", 10, 20, 1), ("B", "C", "transaction", 500.0, "transaction", 50, 60, 1),
            ("C", "D", "call", 100.0, "call", 5, 90, 1), ("D", "D", "transaction", 3.0, "transaction", None, None, 1),
        ],
    )


def pairs(d):
    return sorted((r["src"], r["dst"]) for r in d.collect())


def test_edge_filters(spark):
    e = demo(spark)
    assert pairs(graph.filter_edges(e, money_only=True)) == [("A", "B"), ("B", "C"), ("D", "D")]
    assert pairs(graph.filter_edges(e, layering_only=True)) == [("A", "B")]
    assert pairs(graph.filter_edges(e, amount_min=100)) == [("B", "C"), ("C", "D")]
    assert pairs(graph.filter_edges(e, from_us=15, to_us=40)) == [("A", "B"), ("C", "D"), ("D", "D")]


def test_node_filters_search_and_consistency(spark):
    e = demo(spark)
    n = spark.createDataFrame(
        [("A", "CRITICAL", ["LAY-1"], "Asha"), ("B", "HIGH", ["STR-1"], None), ("C", "MEDIUM", [], None), ("D", "LOW", [], None)],
        "entity_id string, risk_tier string, rules_fired array<string>, name string",
    )
    ids = lambda d: sorted(r["entity_id"] for r in d.collect())
    assert ids(graph.filter_nodes(n, tier_at_least="HIGH")) == ["A", "B"]
    assert ids(graph.filter_nodes(n, rule="STR-1")) == ["B"]
    assert ids(graph.filter_nodes(n, flagged=True)) == ["A", "B", "C"]
    m = spark.createDataFrame([("C", "98250", "phone"), ("D", "98250@x", "vpa")], "entity_id string, identifier string, id_type string")
    assert ids(graph.search_nodes(n, e, m, " ASHA ")) == ["A", "B"]
    assert ids(graph.search_nodes(n, e, m, "9825")) == ["B", "C", "D"]
    nodes, kept = graph.consistent_view(graph.filter_nodes(n, tier_at_least="MEDIUM"), graph.filter_edges(e, layering_only=True), True)
    assert ids(nodes) == ["A", "B"] and pairs(kept) == [("A", "B")]
    fig_nodes, fig_edges = graph.figure_view(e, n, ("STR-1",), 100)
    assert ids(fig_nodes) == ["A", "B", "C"] and pairs(fig_edges) == [("B", "C")]
    assert ids(graph.visible_nodes(e, n, 2)) == ["A", "B"]


def test_ego_counterparties_and_value(spark):
    e = demo(spark)
    ego = {(r["entity_id"], r["other"]): r for r in graph.ego_view(e, 1).collect()}
    assert ego["B", "C"]["remaining"] == 1 and ("D", "D") not in ego
    v = {r["entity_id"]: (r["value_in"], r["value_out"]) for r in graph.value_in_out(e).collect()}
    assert v == {"A": (0.0, 10.0), "B": (10.0, 500.0), "C": (500.0, 0.0), "D": (3.0, 3.0)}
    s = spark.createDataFrame([("C", "HIGH")], "entity_id string, risk_tier string")
    top = {(r["entity_id"], r["rank"]): r for r in graph.direct_counterparties(e, s).collect()}
    assert (top["B", 1]["other"], top["B", 1]["direction"], top["B", 1]["tier"]) == ("C", "out", "HIGH")


def test_classes_and_hops(spark):
    best = spark.createDataFrame([("A", ["A", "B", "C"]), ("B", ["A", "B", "C"])], "origin string, path array<string>")
    assert pairs(graph.chain_hops(best)) == [("A", "B"), ("B", "C")]
    assert graph.distinct_chains(best).first()["detected_on"] == "A"
    got = {(r["src"], r["dst"]): r["edge_class"] for r in graph.classify_edges(demo(spark).drop("edge_class"), graph.chain_hops(best.limit(1)), firing(spark, [("D", "TCS-1", "MEDIUM")])).collect()}
    assert got == {("A", "B"): "layering", ("B", "C"): "layering", ("C", "D"): "call", ("D", "D"): "smoking_gun"}


def test_report_tables(spark):
    e = events(spark, [txn("A", -5, at(n), "x" * 40) for n in range(3)] + [txn("B", 7, at(0)), call("A", at(-1), "9")])
    f = spark.createDataFrame([("A",)], "entity_id string")
    lines = reports.evidence_table(e, f, 2).orderBy("line").collect()
    assert [(r["line"], r["raw_row_ref"]) for r in lines] == [(1, 4), (2, 0)] and len(lines[1]["counterparty"]) == 30
    plan = reports.filing_schedule(e, f, 2).orderBy("serial").collect()
    assert [(r["serial"], r["direction"]) for r in plan] == [(1, "Debit (OUT)"), (2, "Debit (OUT)")]
    assert tuple(reports.filing_totals(e, f).first()) == ("A", 15.0, 3)
    c = {r["rule_id"]: r["category"] for r in reports.filing_categories(firing(spark, [("A", "STR-1", "HIGH"), ("A", "NEW-1", "LOW")])).collect()}
    assert c == {"STR-1": "Structuring / Smurfing", "NEW-1": "Other Suspicious Activity"}
    ev = spark.createDataFrame([("A", "STR-1", 1, 0, 0, "row_0"), ("A", "STR-1", 1, 0, 1, "row_77"), ("A", "STR-1", None, None, 2, "cycle:true"), ("A", "STR-1", 1, 4, 0, "cdr_row_4")], "entity_id string, rule_id string, ord_us bigint, ord_ref bigint, pos int, token string")
    got = {r["token"]: r["in_entity_rows"] for r in reports.evidence_rows(ev, e).collect()}
    assert got == {"row_0": True, "row_77": False, "cdr_row_4": True}
    assert reports.first_tokens(ev, 2).first()["tokens"] == ["row_0", "row_77"]


def test_dossier(spark):
    e = events(spark, [txn("A", -5, at(n), "b") for n in range(4)])
    ed = build(spark, [txn("A", -5, at(n), "b") for n in range(4)])
    fi = firing(spark, [("A", "STR-1", "HIGH")])
    ev = spark.createDataFrame([("A", "STR-1", 1, n, 0, f"row_{n}") for n in range(4)], "entity_id string, rule_id string, ord_us bigint, ord_ref bigint, pos int, token string")
    ent = spark.createDataFrame([("A", "Asha"), ("B", "Bo")], "entity_id string, name string")
    got = {r["entity_id"]: r for r in reports.dossiers(scoring.combine_scores(fi, None, ent), ent, ed, e, fi, ev, max_events=2, max_tokens=3).collect()}
    a = got["A"]
    assert (a["risk_tier"], a["total_events"], len(a["events"]), a["events_truncated"], a["value_out"]) == ("HIGH", 4, 2, True, 20.0)
    assert a["findings"][0]["tokens"] == ["row_0", "row_1", "row_2"] and a["counterparties"][0]["other"] == "B"
    assert got["B"]["value_in"] == 20.0 and got["B"]["findings"] is None
