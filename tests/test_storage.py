"""Tables laid out by entity, documents as sorted lines, and the registry on disk."""
import json
import os

from pyspark.sql import functions as F

from evifuse.operators import storage


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_one_entity_reads_one_bucket(spark, tmp_path):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', concat('e', id % 500)) as entity_id", "(id * 7919) % 30000 as us", "id as raw_row_ref")
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        storage.write_by_entity(rows, path, ["us", "raw_row_ref"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    whole = storage.read_by_entity(spark, path)
    assert whole.count() == 30_000 and "entity_bucket" not in whole.columns
    one = storage.read_by_entity(spark, path, "e7")
    assert [r["us"] for r in one.collect()] == sorted(r["us"] for r in rows.where("entity_id = 'e7'").collect())
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(entity_bucket" in plan
    read = {r["f"] for r in one.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 1 <= len(read) < len(files(path)) / 4
    hot = storage.read_by_entity(spark, path, "hot").withColumn("f", F.input_file_name())
    assert hot.count() == 10_000 and hot.groupBy("f").agg(F.max("us") - F.min("us")).count() > 1  # a hot entity fills several files


def test_documents_follow_each_other(spark, tmp_path):
    s = spark.createDataFrame([("A", "HIGH", 1, ["STR-1"]), ("B", "LOW", 0, []), ("C", "CRITICAL", 2, ["MUL-1"])], "entity_id string, risk_tier string, n_rules bigint, rules_fired array<string>")
    ents = s.select("entity_id", F.lit("n").alias("name"))
    fir = spark.createDataFrame([("A", "STR-1", "HIGH", "why"), ("C", "MUL-1", "HIGH", "why"), ("B", "TCS-1", "MEDIUM", "x")], "entity_id string, rule_id string, severity string, explanation string")
    ev = spark.range(3000).selectExpr("'A' as entity_id", "'STR-1' as rule_id", "3000 - id as ord_us", "id as ord_ref", "0 as pos", "concat('row_', id) as token")
    events = spark.range(20).selectExpr("if(id % 2 = 0, 'A', 'C') as entity_id", "20 - id as us", "id as raw_row_ref")
    parties = spark.createDataFrame([("A", "X", 1)], "entity_id string, other string, rank bigint")
    path = str(tmp_path / "b")
    storage.write_bundle_lines(storage.bundle_lines(s, ents, fir, ev, parties, events), path)
    assert sorted(os.listdir(path))[-2:] == ["risk_tier=CRITICAL", "risk_tier=HIGH"]
    high = os.path.join(path, "risk_tier=HIGH")
    lines = [json.loads(x) for f in sorted(os.listdir(high)) if f.endswith(".txt") for x in open(os.path.join(high, f))]
    assert [x["section"] for x in lines] == ["entity", "finding"] + ["evidence"] * 3000 + ["counterparty"] + ["event"] * 10
    assert [x["ord_us"] for x in lines[2:3002]] == list(range(1, 3001)) and [x["us"] for x in lines[3003:]] == list(range(2, 21, 2))
    assert lines[0]["rules_fired"] == ["STR-1"] and {x["entity_id"] for x in lines} == {"A"}


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "r")

    def rows(keys, at):
        return spark.createDataFrame([(f"p{k}", "c", "evidence", None, f"s{at}", at) for k in keys], "storage_path string, case_id string, kind string, entity_id string, sha256 string, created_at bigint")

    storage.upsert_registry(rows(range(200), 1), path, parts=16)
    before = files(path)
    storage.upsert_registry(rows([3, 3, 3], 2).unionByName(rows([7], 0)), path, parts=16)
    after = files(path)
    kept = [f for f in before if f in after]
    assert all(before[f] == after[f] for f in kept) and len(kept) >= len(before) - 2 * 4 and len(kept) < len(after)
    got = {r["storage_path"]: r["sha256"] for r in storage.read_registry(spark, path).collect()}
    assert len(got) == 200 and got["p3"] == "s2" and got["p7"] == "s1" and got["p9"] == "s1"
    storage.upsert_registry(rows([], 3), path, parts=16)
    assert files(path) == after


def test_bundle_lines_are_made_once(spark, tmp_path):
    """Ranges of lines are sampled from written lines: each line is made a single time."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def line(k):
        made.add(1)
        return f"line {k}"

    keys = F.lit("HIGH").alias("risk_tier"), F.lpad(F.col("id").cast("string"), 3, "0").alias("entity_id"), F.lit(0).alias("section")
    lines = spark.range(40).select(*keys, F.lit("").alias("a"), F.lit(0).alias("b"), F.lit("").alias("c"), line.asNondeterministic()("id").alias("line"))
    storage.write_bundle_lines(lines, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 40 and made.value == 40
