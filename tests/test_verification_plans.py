import random

import pytest

from evifuse.operators import verification as V
from evifuse.plans import contents, folders  # noqa: F401
from evifuse.plans.queries import ORACLES, QUERIES


def greedy(truth, ids, members, scored):
    taken, out = set(), {}
    for t, seq, typ in sorted(truth, key=lambda x: x[1]):
        mine = {i for tt, i in ids if tt == t}
        best = None
        for e in sorted({m[0] for m in members} - taken):
            n = len(mine & {i for ee, i, _ in members if ee == e})
            if n and (best is None or n > best[0]):
                best = (n, e)
        pick = best[1] if best else None
        if pick is None:
            options = sorted((-n, e) for e, _, n, rules in scored if typ in rules and e not in taken)
            pick = options[0][1] if options else None
        if pick:
            taken.add(pick)
            out[t] = pick
    return out


def test_rounds_have_a_row_per_entry(spark, monkeypatch):
    """Everyone waits for one rule, some behind holders that share identifiers: rows stay those of the entries."""
    n, m = 16, 12
    truth = [(f"T{k:02}", k, "STR-1") for k in range(n)]
    ids, members = [(f"T{k:02}", f"i{k}") for k in range(0, n, 4)], [(f"E{(n - k) % m:02}", f"i{k}", "phone") for k in range(0, n, 4)]
    scored = [(f"E{k:02}", "LOW", 1 + k % 4, ["STR-1"]) for k in range(m)]
    sizes, cut = [], V.cut

    def counted(df, name="cut", by=None):
        out = cut(df, name, by)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(V, "cut", counted)
    got = V.match_truth(
        spark.createDataFrame(truth, "truth_id string, seq bigint, typology string"), spark.createDataFrame(ids, "truth_id string, identifier string"),
        spark.createDataFrame(members, "entity_id string, identifier string, id_type string"),
        spark.createDataFrame(scored, "entity_id string, risk_tier string, n_rules bigint, rules_fired array<string>"),
    )
    assert {r["truth_id"]: r["entity_id"] for r in got.collect()} == greedy(truth, ids, members, scored)
    assert max(k for name, k in sizes if name in ("by-rule", "proposals")) <= n
    assert max(k for name, k in sizes if name == "pairs") <= n + len(ids)
    assert len([1 for name, _ in sizes if name == "by-rule"]) < n / 2


@pytest.mark.parametrize("seed", range(3))
def test_match_equals_one_by_one(spark, seed):
    rnd = random.Random(seed)
    pool = [f"i{n}" for n in range(14)]
    truth = [(f"T{n}", n, rnd.choice(["STR-1", "LAY-1"])) for n in range(12)]
    ids = [(t[0], i) for t in truth for i in rnd.sample(pool, rnd.randrange(0, 3))] or [("T0", "i0")]
    members = [(f"E{n % 8}", i, "phone") for n, i in enumerate(pool)]
    scored = []
    for n in range(12):
        rules = sorted(rnd.sample(["STR-1", "LAY-1", "TCS-1"], rnd.randrange(0, 4)))
        scored.append((f"E{n}", "LOW", len(rules), rules))
    got = V.match_truth(
        spark.createDataFrame(truth, "truth_id string, seq bigint, typology string"),
        spark.createDataFrame(ids, "truth_id string, identifier string"),
        spark.createDataFrame(members, "entity_id string, identifier string, id_type string"),
        spark.createDataFrame(scored, "entity_id string, risk_tier string, n_rules bigint, rules_fired array<string>"),
    )
    assert {r["truth_id"]: r["entity_id"] for r in got.collect()} == greedy(truth, ids, members, scored)


@pytest.mark.parametrize("slice_rows", (7, 50_000))
def test_displaced_entries_need_few_jobs(spark, monkeypatch, slice_rows):
    """Each entry by rule takes the own entity of a later one: few rounds of jobs, slices or not, and the one-by-one result."""
    n = 40
    rnd = random.Random(5)
    truth = [(f"T{k:02}", 2 * k, rnd.choice(["STR-1", "LAY-1", "MUL-1"])) for k in range(n)]
    ids = [(f"T{k:02}", f"i{k // 2 if k % 7 == 6 else k}") for k in range(n) if k]
    members = [(f"E{k:02}", f"i{k}", "phone") for k in range(n)]
    scored = [(f"E{k:02}", "LOW", 3 - k % 2, rnd.sample(["STR-1", "LAY-1", "MUL-1"], 3 - k % 2)) for k in range(n - 5)]
    names, cut = [], V.cut
    monkeypatch.setattr(V, "cut", lambda df, name="cut", by=None: names.append(name) or cut(df, name, by))
    got = V.match_truth(
        spark.createDataFrame(truth, "truth_id string, seq bigint, typology string"), spark.createDataFrame(ids, "truth_id string, identifier string"),
        spark.createDataFrame(members, "entity_id string, identifier string, id_type string"),
        spark.createDataFrame(scored, "entity_id string, risk_tier string, n_rules bigint, rules_fired array<string>"), **({"slice_rows": 7} if slice_rows == 7 else {}),
    )
    assert {r["truth_id"]: r["entity_id"] for r in got.collect()} == greedy(truth, ids, members, scored)
    assert len(names) <= 4 + 2 * -(-(n + len(ids)) // slice_rows)


def test_scorecard(spark):
    truth = spark.createDataFrame([("T1", 0, "STR-1"), ("T2", 1, "LAY-1"), ("T3", 2, "MUL-1"), ("T4", 3, "MUL-1")], "truth_id string, seq bigint, typology string")
    match = spark.createDataFrame([("T1", "A"), ("T2", "B"), ("T3", "C")], "truth_id string, entity_id string")
    scored = spark.createDataFrame(
        [("A", "HIGH", 1, ["STR-1"]), ("B", "MEDIUM", 1, ["TCS-1"]), ("C", "LOW", 0, []), ("D", "CRITICAL", 2, ["LAY-1", "TCS-1"]), ("F", "HIGH", 1, ["LOC-1"])],
        "entity_id string, risk_tier string, n_rules bigint, rules_fired array<string>",
    )
    st = V.truth_status(truth, match, scored)
    assert {r["truth_id"]: (r["status"], r["detected_tier"]) for r in st.collect()} == {
        "T1": ("DETECTED", "HIGH"), "T2": ("MISSED (below HIGH)", "MEDIUM"), "T3": ("MISSED", "LOW"), "T4": ("MISSED", "N/A"),
    }
    fps = V.false_positives(st, scored)
    s = V.detection_scores(st, fps, 40).first()
    assert (s["true_positives"], s["false_positives"], s["false_negatives"], s["recall"], s["specificity"]) == (1, 2, 3, 0.25, 38 / 40)
    notes = {r["entity_id"]: r["note"] for r in V.false_positive_notes(fps, spark.createDataFrame([(["X", "D"],)], "path array<string>")).collect()}
    assert notes == {"D": "sits on a detected layering chain", "F": "flagged on LOC-1 with no ground-truth match"}
    t = {r["typology"]: (r["planted"], r["detected"], r["recall"]) for r in V.typology_scores(st).collect()}
    assert t == {"LAY-1": (1, 0, 0.0), "MUL-1": (2, 0, 0.0), "STR-1": (1, 1, 1.0)}


def test_every_query_is_described():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"iforest_flags", "ml_only_entities"}


PLANNED = [q for q in QUERIES if q != "iforest_flags"]
# What may stand above rows that one task gets: an aggregate of partial results, or the first rows of sorted parts.
GATHERS = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "GlobalLimit", "TakeOrderedAndProject", "CollectLimit")


def gathered_rows(plan: str) -> list[str]:
    """Lines of a plan where all rows, not partial aggregates or limits, go to one task."""
    lines = plan.splitlines()
    return [lines[n - 1] for n, x in enumerate(lines) if "Exchange SinglePartition" in x and not any(g in lines[n - 1] for g in GATHERS)]


def test_no_plan_pairs_or_gathers_everything(spark, sf):
    bad = {}
    for q in PLANNED:
        plan = QUERIES[q](spark, sf)._jdf.queryExecution().executedPlan().toString()
        hits = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if w in plan] + gathered_rows(plan)
        if hits:
            bad[q] = hits
    assert not bad


def test_a_window_over_everything_is_noticed(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    d = spark.range(100)
    assert gathered_rows(plan(d.withColumn("n", F.row_number().over(Window.orderBy("id")))))
    assert not gathered_rows(plan(d.agg(F.sum("id")))) and not gathered_rows(plan(d.orderBy("id").limit(3)))


def test_source_does_not_gather_or_cut_locally():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[1] / "evifuse"
    for p in root.rglob("*.py"):
        text = p.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|\.collect\(\)|\.rdd\b|F\.udf\(", text), p
        if p.name != "scoring.py":
            assert "toPandas" not in text, p


@pytest.mark.parametrize("name", ("apply_mapping", "dossier_events", "institution_flagged", "str_schedule"))
def test_given_events_are_read_once(spark, sf, name):
    """Queries of many passes read the run's written event table, not the texts of the given one again."""
    files = QUERIES[name](spark, sf).inputFiles()
    assert files and not [f for f in files if f.startswith(f"file://{sf}/events.parquet")]
