import random

from pyspark.sql import functions as F

from evifuse.operators import rules
from evifuse.sources.reference import place_events
from tests.util import at, call, events, fired, id_map, members, session, tokens, txn

NOBODY = [("Z", "phone", "0")]


def test_structuring_fires_on_the_earliest_window(spark):
    e = events(spark, [txn("A", 200000, at(0))] + [txn("A", -49999, at(h)) for h in (2, 4, 6, 8)])
    got = rules.str1(e)
    assert fired(got)["A"]["severity"] == "HIGH"
    assert tokens(got, "A") == ["row_1", "row_2", "row_3"]
    assert "49999, 49999, 49999" in fired(got)["A"]["explanation"]


def test_structuring_silent(spark):
    assert not fired(rules.str1(events(spark, [txn("A", -50000, at(h)) for h in (1, 2, 3)] + [txn("A", -55000, at(4))])))
    spread = events(spark, [txn("A", -49000, at(h)) for h in (0, 30, 60, 110)])
    assert not fired(rules.str1(spread))
    edge = events(spark, [txn("A", -49000, at(h)) for h in (0, 47, 48)])
    assert fired(rules.str1(edge))


def test_mule_fires_and_stays_silent(spark):
    hit = events(spark, [txn("A", -500, at(days=-60)), txn("A", 500000, at(0)), txn("A", -480000, at(1))])
    got = rules.mul1(hit)
    assert "A" in fired(got)
    assert tokens(got, "A")[:4] == ["inflow:500000", "outflow:480000", "retained:20000", "prior_txns_in_dormancy:0"]
    assert {"row_1", "row_2"} <= set(tokens(got, "A"))
    recent = [txn("A", -500, at(days=-d)) for d in (7, 8, 9)]
    assert not fired(rules.mul1(events(spark, recent + [txn("A", 500000, at(0)), txn("A", -480000, at(1))])))
    micro = [txn("A", -9, at(days=-2)), txn("A", 500000, at(0)), txn("A", -480000, at(6))]
    assert fired(rules.mul1(events(spark, micro)))
    late = [txn("A", -9, at(days=-2)), txn("A", 500000, at(0)), txn("A", -480000, at(6, minutes=1))]
    assert not fired(rules.mul1(events(spark, late)))
    edge = [txn("A", -50, at(days=-30)), txn("A", 500000, at(0)), txn("A", -480000, at(1))]
    assert not fired(rules.mul1(events(spark, edge)))


def imei(entity, ref, when, device, sim=None):
    return call(entity, when, "B", entity_ref=ref, imei=device, imsi=sim)


def idr(spark, rows, ids=NOBODY, **k):
    return rules.idr1(events(spark, rows), members(spark, ids), **k)


def test_swap_grades(spark):
    both = idr(spark, [imei("A", "9", at(0), "d1", "s1"), imei("A", "9", at(1), "d2", "s2")])
    assert fired(both)["A"]["severity"] == "HIGH"
    near = idr(spark, [imei("A", "9", at(0), "d1"), imei("A", "9", at(1), "d2"), txn("A", -5, at(1, minutes=5))])
    assert fired(near)["A"]["severity"] == "MEDIUM"
    alone = idr(spark, [imei("A", "9", at(0), "d1"), imei("A", "9", at(1), "d2")])
    assert fired(alone)["A"]["severity"] == "LOW"
    assert {"row_0", "row_1", "old_imei:d1", "new_imei:d2", "nearby_txn:no"} <= set(tokens(alone, "A"))


def test_swap_constant_is_silent_and_hot_path_agrees(spark):
    assert not fired(idr(spark, [imei("A", "9", at(n), "d", "s") for n in range(20)]))
    rows = [imei("A", "9", at(n), None if n % 3 else f"d{n // 9}") for n in range(60)]
    a = rules.identifier_swaps(events(spark, rows)).orderBy("us").collect()
    b = rules.identifier_swaps(events(spark, rows), hot_rows=5).orderBy("us").collect()
    assert a == b and len(a) == 6


def test_device_fanout_and_counts(spark):
    fan = idr(spark, [imei("A", p, at(n), "d1") for n, p in enumerate(["n1", "n2", "n3"])])
    assert fired(fan)["A"]["severity"] == "HIGH"
    assert "msisdn_count:3" in tokens(fan, "A")
    accounts = [("A", "account", f"a{n}") for n in range(3)]
    devices = [("A", "imei", f"d{n}") for n in range(2)]
    assert fired(idr(spark, [], accounts))["A"]["severity"] == "MEDIUM"
    assert fired(idr(spark, [], devices))["A"]["severity"] == "MEDIUM"
    two = fired(idr(spark, [], accounts + devices))["A"]
    assert two["severity"] == "HIGH" and "2 independent" in two["explanation"]
    assert not fired(idr(spark, [], accounts[:2] + devices[:1]))


MAP = [(x, x) for x in "ABCDE"]


def lay(spark, rows, **k):
    return rules.lay1(events(spark, rows), id_map(spark, MAP), **k)


def test_layering_cycle(spark):
    rows = [
        txn("A", -100000, at(0), "B"), txn("B", 100000, at(0), "A"), txn("B", -90000, at(minutes=15), "C"),
        txn("C", 90000, at(minutes=15), "B"), txn("C", -80000, at(minutes=30), "A"),
    ]
    got = lay(spark, rows)
    assert {"cycle:true", "hops:3", "chain:A>B>C>A", "row_0", "row_2", "row_4"} <= set(tokens(got, "A"))
    assert "came back to it" in fired(got)["A"]["explanation"]
    assert "chain:B>C>A" in tokens(got, "B")


def test_layering_open_and_silent(spark):
    open_ = lay(spark, [txn("A", -100000, at(0), "B"), txn("B", -90000, at(1), "C"), txn("C", -80000, at(2), "nobody")])
    assert {"cycle:false", "chain:A>B>C"} <= set(tokens(open_, "A"))
    assert not fired(lay(spark, [txn("A", -1417, at(0), "B"), txn("B", -1275, at(1), "C"), txn("C", -1147, at(2), "A")]))
    assert not fired(lay(spark, [txn("A", -100000, at(0), "B"), txn("B", -50000, at(1), "C"), txn("C", -25000, at(2), "A")]))
    assert not fired(lay(spark, [txn("A", -100000, at(0), "B"), txn("B", -90000, at(13), "C")]))
    assert not fired(lay(spark, [txn("A", -100000, at(0), "B"), txn("A", -90000, at(1), "C")]))
    assert not fired(rules.lay1(events(spark, [txn("A", -100000, at(0), "B"), txn("B", -90000, at(1), "C")]), id_map(spark, [])))


def test_layering_band_and_window_edges(spark):
    low = [txn("A", -100000, at(0), "B"), txn("B", -80000, at(12), "C")]
    high = [txn("A", -100000, at(0), "B"), txn("B", -97000, at(1), "C")]
    over = [txn("A", -100000, at(0), "B"), txn("B", -97001, at(1), "C")]
    same = [txn("A", -100000, at(0), "B"), txn("B", -90000, at(0), "C")]
    assert fired(lay(spark, low)) and fired(lay(spark, high))
    assert not fired(lay(spark, over)) and not fired(lay(spark, same))


def test_layering_equals_walk(spark):
    rnd = random.Random(11)
    rows = [txn(rnd.choice("ABCDE"), -rnd.choice([100000, 92000, 85000, 78000, 70000, 64000, 58000]), at(minutes=rnd.randrange(0, 3000)), rnd.choice("ABCDE")) for _ in range(60)]
    out = sorted((r["timestamp"], n, r) for n, r in enumerate(rows))
    best = {}

    def go(path, refs, t, amt):
        for ts, n, r in out:
            if r["entity_id"] != path[-1] or ts <= t or (ts - t).total_seconds() > 12 * 3600:
                continue
            a = -r["amount"]
            if not amt * (1 - 0.20) <= a <= amt * (1 - 0.03):
                continue
            d = r["counterparty"]
            if d == path[0]:
                take(path + [d], refs + [n], True)
            elif d not in path:
                take(path + [d], refs + [n], False)
                if len(path) < 6:
                    go(path + [d], refs + [n], ts, a)

    def take(path, refs, cycle):
        key = (cycle, len(path))
        if path[0] not in best or key > best[path[0]][0]:
            best[path[0]] = (key, path, refs)

    for ts, n, r in out:
        if r["counterparty"] != r["entity_id"] and -r["amount"] >= 50000:
            go([r["entity_id"], r["counterparty"]], [n], ts, -r["amount"])
    got = rules.best_paths(rules.layering_paths(rules.transfer_edges(events(spark, rows), id_map(spark, MAP)))).collect()
    assert {r["origin"]: (r["path"], [h["ref"] for h in r["hops"]]) for r in got} == {k: (v[1], v[2]) for k, v in best.items()}

    assert {r["origin"]: (r["path"], [h["ref"] for h in r["hops"]]) for r in bounded(spark, rows)} == {k: (v[1], v[2]) for k, v in best.items()}


def bounded(spark, rows, **k):
    names = sorted({x for r in rows for x in (r["entity_id"], r["counterparty"])})
    edges = rules.transfer_edges(events(spark, rows), id_map(spark, [(n, n) for n in names]))
    return rules.best_chains(edges, **k).collect()


def test_bounded_chains_where_walks_revisit(spark):
    """Walks that come back to an entity bound better than any path: the exact search settles those origins."""
    rng = random.Random(11)
    for trial in range(3):
        rows = [txn(a, -100000 * 0.93 ** rng.randrange(7), at(minutes=rng.randrange(300)), b)
                for a, b in (rng.sample("ABCDE", 2) for _ in range(70 + 20 * trial))]
        names = [(n, n) for n in "ABCDE"]
        edges = rules.transfer_edges(events(spark, rows), id_map(spark, names))
        want = rules.best_paths(rules.layering_paths(edges)).collect()
        key = lambda r: (r["path"], [tuple(h) for h in r["hops"]], r["amounts"], r["cycle"])
        assert {r["origin"]: key(r) for r in bounded(spark, rows)} == {r["origin"]: key(r) for r in want}
    # A, B, A: every walk on from B goes through A again
    rows = [txn("X", -100000, at(0), "A"), txn("A", -92000, at(1), "B"), txn("B", -85000, at(2), "A"), txn("A", -79000, at(3), "C")]
    assert {r["origin"]: r["path"] for r in bounded(spark, rows)} == {"X": ["X", "A", "B"], "A": ["A", "B", "A"], "B": ["B", "A", "C"]}


def test_chains_of_a_dense_hub(spark):
    """Five layers of 14, all joined to the next: 14 ** 5 paths from every origin, a few states each."""
    rows = [
        txn(f"L{d}_{i}", -100000 * 0.9 ** d, at(minutes=30 * d, hours=0.001 * (14 * i + j)), f"L{d + 1}_{j}")
        for d in range(5) for i in range(14) for j in range(14)
    ]
    got = {r["origin"]: (r["path"], r["cycle"]) for r in bounded(spark, rows)}
    assert len(got) == 14 * 4 and got["L0_3"] == (["L0_3", "L1_0", "L2_0", "L3_0", "L4_0", "L5_0"], False)


def test_representatives_spare_what_others_block():
    kept = []
    for path in ("ab", "ac", "ad", "bc", "xy"):
        p = frozenset(path)
        if rules.spares(p, kept, 1):
            kept.append(p)
    assert kept == [frozenset("ab"), frozenset("ac"), frozenset("bc")]  # whatever one entity is avoided, one of them is left


def loc(spark, rows, **k):
    return rules.loc1(place_events(events(spark, rows)), **k)


def test_impossible_travel(spark):
    hit = loc(spark, [call("A", at(0), location="SRT-T01"), call("A", at(minutes=15), location="MUM-T01")])
    assert {"row_0", "row_1", "time_mins:15.0"} <= set(tokens(hit, "A"))
    assert not fired(loc(spark, [call("A", at(0), location="SRT-T01"), call("A", at(5), location="MUM-T01")]))
    assert not fired(loc(spark, [call("A", at(0), location="SRT-T01"), call("A", at(minutes=20), location="SRT-T01")]))
    by_ip = [call("A", at(0), location="SRT-T01"), session("A", at(minutes=15), location="BRD-T01", _public_ip="103.21.4.4")]
    assert fired(loc(spark, by_ip))


def test_impossible_travel_hot_path_agrees(spark):
    spots = ["SRT-T01", "MUM-T01", None, "DEL-T01"]
    rows = [call("A", at(minutes=25 * n), location=spots[n * 7 % 4]) for n in range(80)]
    p = place_events(events(spark, rows))
    a, b = (sorted(r["raw_row_ref"] for r in rules.impossible_legs(p, hot_rows=h).collect()) for h in (10**9, 7))
    assert a == b and a


def test_tcs1(spark):
    from evifuse.operators.temporal import enrich_transactions

    e = events(spark, [txn("A", -5, at(0)), call("A", at(minutes=2)), session("A", at(minutes=-3)), txn("B", -5, at(0)), call("B", at(0))])
    got = rules.tcs1(enrich_transactions(e))
    assert set(fired(got)) == {"A"} and tokens(got, "A") == ["bank_row_0", "cdr_row_1", "ipdr_row_2"]


def tcs2(spark, rows, pairs):
    return rules.tcs2(events(spark, rows), id_map(spark, pairs))


def test_tcs2_links(spark):
    emb = tcs2(spark, [call("A", at(0), "9876543210"), txn("A", -5, at(minutes=5), "9876543210@ok")], [])
    assert {"link:embedded", "row_0", "row_1"} <= set(tokens(emb, "A"))
    rows = [call("A", at(0), "98765"), txn("A", -5, at(minutes=5), "acct7")]
    assert "link:resolved" in tokens(tcs2(spark, rows, [("98765", "P"), ("acct7", "P")]), "A")
    assert not fired(tcs2(spark, rows, [("98765", "P"), ("acct7", "Q")]))
    assert not fired(tcs2(spark, rows, []))
    both = tcs2(spark, [call("A", at(0), "9876543210"), txn("A", -5, at(minutes=5), "9876543210@ok")], [("9876543210", "P"), ("9876543210@ok", "P")])
    assert [t for t in tokens(both, "A") if t.startswith("link")] == ["link:resolved"]


def test_tcs2_window_edges_and_counts(spark):
    pairs = [("c", "P"), ("p", "P")]
    for mins, ok in ((0.9, False), (1, True), (15, True), (15.1, False), (-5, False)):
        got = tcs2(spark, [call("A", at(0), "c"), txn("A", -5, at(minutes=mins), "p")], pairs)
        assert bool(fired(got)) == ok, mins
    many = events(spark, [call("A", at(minutes=m), "c") for m in (-20, 0, 3, 6, 20)] + [txn("A", -5, at(minutes=10), "p")])
    row = rules.call_then_transfer(many, id_map(spark, pairs)).first()
    assert (row["n_calls"], row["first_call_ref"], row["last_call_ref"]) == (3, 1, 3)


def test_every_firing_has_text_and_evidence(spark, sf):
    from evifuse.plans import casework as cw

    f, ev = cw.firings(spark, sf), cw.evidence(spark, sf)
    assert {r["rule_id"] for r in f.select("rule_id").distinct().collect()} >= {"IDR-1", "TCS-1", "TCS-2", "MUL-1", "LOC-1"}
    assert f.where("explanation is null or explanation = '' or severity is null").count() == 0
    assert f.join(ev, ["entity_id", "rule_id"], "left_anti").count() == 0
    assert f.groupBy("entity_id", "rule_id").count().where("count > 1").count() == 0
    crit = cw.scored(spark, sf).where("risk_tier = 'CRITICAL'")
    assert crit.count() and crit.where("n_rules < 2").count() == 0
    drops = cw.layering(spark, sf).where(F.exists(rules.hop_skims(F.col("amounts")), lambda s: (s < 2.999) | (s > 20.001)))
    assert drops.count() == 0
