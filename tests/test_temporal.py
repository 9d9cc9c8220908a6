import random

from pyspark.sql import functions as F

from evifuse.operators import keyed, temporal
from tests.util import at, call, events, session, txn


def enrich(spark, rows, **k):
    return {r["raw_row_ref"]: r for r in temporal.enrich_transactions(events(spark, rows), **k).collect()}


def test_nearest_ties_tolerance_and_no_match(spark):
    got = enrich(
        spark,
        [
            txn("A", -1, at(0)), call("A", at(minutes=-5)), call("A", at(minutes=5)),  # equal gap: earlier wins
            txn("B", -1, at(0)), call("B", at(minutes=10)), call("B", at(minutes=10)),  # inclusive; first of equal later ones
            txn("C", -1, at(0)), call("C", at(minutes=10.02)),  # beyond
            txn("D", -1, at(0)), call("D", at(minutes=-3)), call("D", at(minutes=-3)),  # last of equal earlier ones
            txn("E", -1, at(0)), session("E", at(minutes=1)), call("E", at(minutes=-1), None),
            txn("F", -1, at(0)), call("G", at(0)),  # other entity
        ],
    )
    assert got[0]["call_row_ref"] == 1
    assert got[3]["call_row_ref"] == 4
    assert got[6]["call_row_ref"] is None and not got[6]["has_call_correlation"]
    assert got[8]["call_row_ref"] == 10
    # A match without a counterparty is still a match.
    assert got[11]["has_both_correlation"]
    assert got[14]["call_row_ref"] is None
    assert len(got) == 6


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(400):
        who, when = rnd.choice("AAAB"), at(minutes=rnd.randrange(0, 3000))
        rows.append(rnd.choice([txn(who, -5, when), call(who, when), session(who, when)]))
    got = enrich(spark, rows, window_minutes=7)
    for n, t in enumerate(rows):
        if t["event_type"] != "transaction":
            continue
        best = None
        for m, c in enumerate(rows):
            if c["event_type"] == "call" and c["entity_id"] == t["entity_id"]:
                gap = (c["timestamp"] - t["timestamp"]).total_seconds()
                if abs(gap) <= 420:
                    key = (abs(gap), gap > 0, m if gap > 0 else -m)
                    best = min(best, (key, m)) if best else (key, m)
        assert got[n]["call_row_ref"] == (best[1] if best else None)


def test_session_overlap_option(spark):
    got = enrich(
        spark,
        [txn("A", -1, at(0)), session("A", at(hours=-9), end_timestamp=at(minutes=1)), txn("B", -1, at(0)), session("B", at(hours=-9), end_timestamp=at(hours=-1))],
        session_match="overlap",
    )
    assert got[0]["session_row_ref"] == 1 and got[2]["session_row_ref"] is None


def test_last_before_is_the_same_for_hot_keys(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aaab"), n * 37 * keyed.MINUTE, n, rnd.choice([None, "x", "y", "z"])) for n in range(300)]
    d = spark.createDataFrame(rows, "k string, us bigint, ref bigint, v string")
    plain = keyed.last_before(d, "k", ["us", "ref"], {"p": F.col("v")})
    hot = keyed.last_before(d, "k", ["us", "ref"], {"p": F.col("v")}, min_rows=10)
    last, want = {}, []
    for k, us, ref, v in rows:
        want.append((ref, last.get(k)))
        if v is not None:
            last[k] = v
    for got in (plain, hot):
        assert sorted((r["ref"], r["p"]) for r in got.collect()) == want


def test_nearest_is_the_same_in_slices_of_any_size(spark):
    """One key holds nearly all rows, many of one time, and the tolerance covers whole slices."""
    rnd = random.Random(5)
    rows = []
    for _ in range(500):
        who, when = rnd.choice("AAAAAAAAB"), at(minutes=rnd.choice([rnd.randrange(3000), 1440]))
        rows.append(rnd.choice([txn(who, -5, when), call(who, when), session(who, when)]))
    rows.append(txn(None, -5, at(0)))
    e = events(spark, rows)
    txns, rights = e.where("event_type = 'transaction'"), {"c": e.where("event_type = 'call'").select("entity_id", "us", "raw_row_ref")}
    for minutes in (3, 1440):
        a, b = (
            sorted((r["raw_row_ref"], r["c"] and r["c"]["raw_row_ref"]) for r in temporal.nearest_within(
                txns, rights, ["entity_id"], "us", "raw_row_ref", minutes * keyed.MINUTE, **k).collect())
            for k in ({}, {"min_rows": 20, "slice_rows": 16})
        )
        assert a == b and any(c is not None for _, c in a)


def test_hot_keys_are_cut_into_bounded_slices(spark):
    d = spark.range(20_000).selectExpr("if(id % 3 = 0, id % 5000, -1) as k", "if(id % 2 = 0, 7, id) as us", "id")
    cold, hot = keyed.split_hot(d, ["k"], ["us", "id"], min_rows=1000, slice_rows=500)
    assert hot.select("k").distinct().count() == 1 and cold.count() + hot.count() == 20_000
    sizes = [r["count"] for r in hot.groupBy("_slice").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 1000  # ties in time are cut, too


def test_linked_calls_in_slices(spark):
    rnd = random.Random(8)
    calls = [("A", rnd.choice("PPPQ"), rnd.randrange(3000), n) for n in range(300)]
    links = [("A", rnd.choice("PPPQ"), rnd.randrange(3000), 1000 + n) for n in range(150)] * 2
    c = spark.createDataFrame(calls, "entity_id string, party string, us bigint, raw_row_ref bigint")
    d = spark.createDataFrame(links, "entity_id string, party string, us bigint, raw_row_ref bigint")
    for window, least in ((15, 1), (900, 40), (0, 0)):
        want, followed = [], set()
        for _, p, t, ref in links:
            hits = sorted((u, r) for _, q, u, r in calls if q == p and t - window <= u <= t - least)
            followed |= {(p, u, r) for u, r in hits}
            if hits:
                want.append((p, t, ref, len(hits), *hits[0], *hits[-1]))
        for k in ({}, {"min_rows": 20, "slice_rows": 30}):
            got = temporal.linked_calls_before(d, c, window, least, **k)
            names = ["party", "us", "raw_row_ref", "n_calls", "first_call_us", "first_call_ref", "last_call_us", "last_call_ref"]
            assert sorted(tuple(r) for r in got.transfers.select(*names).collect()) == sorted(want)
            assert {(r["party"], r["us"], r["raw_row_ref"]) for r in got.calls.collect()} == followed


def test_timeline_rows_and_totals(spark):
    e = events(spark, [txn("A", 1500, at(0)), txn("A", -20, at(1)), call("A", at(2)), session("A", at(3)), {"entity_id": "A", "event_type": "other", "timestamp": at(4)}])
    cited = spark.createDataFrame([("A", 1)], "entity_id string, raw_row_ref bigint")
    rows = {r["raw_row_ref"]: r for r in temporal.timeline_rows(e, cited).collect()}
    assert (rows[0]["label"], rows[0]["direction"], rows[2]["label"], rows[3]["label"]) == ("+₹1,500", "credit", "CALL", "SESSION")
    assert [rows[n]["cited"] for n in range(4)] == [False, True, False, False] and 4 not in rows
    assert temporal.timeline_rows(e, cited, max_events=2).count() == 2
    assert temporal.timeline_totals(e, max_events=2).first()["truncated"]


def test_bands_focus_and_what_if(spark):
    e = events(spark, [txn("A", -900, at(0)), call("A", at(minutes=2)), txn("A", -5, at(5)), call("A", at(5)), session("A", at(5))])
    bands = temporal.correlation_bands(temporal.enrich_transactions(e, 10), 10)
    assert {r["raw_row_ref"]: r["kind"] for r in bands.collect()} == {0: "call", 2: "tcs1"}
    assert temporal.focus_bands(bands).first()["raw_row_ref"] == 2
    wide = temporal.what_if(e, "A", 10_000)
    assert wide.where("has_both_correlation").count() == 2 and wide.first()["is_preview"]


def test_top_per_key_beyond_the_group_limit(spark):
    d = spark.range(5000).select(F.lit("k").alias("k"), "id")
    got = keyed.top_per_key(d, ["k"], [F.desc("id")], 1500)
    assert got.count() == 1500 and got.agg(F.min("id")).first()[0] == 3500
