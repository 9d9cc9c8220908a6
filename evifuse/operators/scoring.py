"""Risk tiers from rule firings, entity features and the separate anomaly flag."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.operators.keyed import top_per_key
from evifuse.operators.temporal import CALL_TYPES
from evifuse.session import cut

# Tiers from worst to best.
TIERS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def tier_rank(tier):
    """0 for the worst tier."""
    out = F.when(tier == TIERS[0], 0)
    for i, t in enumerate(TIERS[1:], start=1):
        out = out.when(tier == t, i)
    return out.otherwise(len(TIERS))


def risk_tiers(firings: DataFrame) -> DataFrame:
    """Gated tier of every entity with a firing.

    One row per entity and rule is expected. The rule list is at most seven long.
    """

    def has(rule: str):
        return F.max(F.when(F.col("rule_id") == rule, 1).otherwise(0)) == 1

    g = firings.groupBy("entity_id").agg(
        has("MUL-1").alias("mul"), has("LAY-1").alias("lay"), has("STR-1").alias("st"), has("LOC-1").alias("loc"),
        has("IDR-1").alias("idr"), (has("TCS-1") | has("TCS-2")).alias("tcs"),
        F.max(F.when(F.col("rule_id") == "IDR-1", F.col("severity"))).alias("idr_grade"),
        F.count(F.lit(1)).alias("n_rules"),
        F.sort_array(F.collect_set("rule_id")).alias("rules_fired"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_id", "severity")))).alias("rule_severities"),
    )
    idr_high = F.coalesce(F.col("idr_grade") == "HIGH", F.lit(False))
    idr_medium = F.coalesce(F.col("idr_grade") == "MEDIUM", F.lit(False))
    critical = (
        (F.col("mul") & F.col("tcs"))
        | (F.col("lay") & (F.col("idr") | F.col("tcs")))
        | (idr_high & (F.col("n_rules") >= 2))
    )
    high = F.col("mul") | F.col("lay") | F.col("st") | F.col("loc") | idr_high | (F.col("idr") & F.col("tcs"))
    return g.select(
        "entity_id",
        F.when(critical, "CRITICAL").when(high, "HIGH").when(F.col("tcs") | idr_medium, "MEDIUM").otherwise("LOW").alias("risk_tier"),
        "n_rules", "rules_fired", "rule_severities",
    )


def entity_features(events: DataFrame) -> DataFrame:
    """Five activity features per entity, from two map-side combined aggregations."""
    txn = F.col("event_type") == "transaction"
    comm = F.col("event_type").isin(*CALL_TYPES) | (F.col("event_type") == "ip_session")
    amount, us = F.col("amount"), F.col("us")
    day, hour = 86_400_000_000.0, 3_600_000_000.0
    base = events.groupBy("entity_id").agg(
        F.count_if(txn).alias("n"),
        ((F.max(F.when(txn, us)) - F.min(F.when(txn, us)))).alias("span"),
        F.sum(F.when(txn & (amount > 0), F.round(amount * 10_000).cast("bigint"))).alias("inn"),
        F.sum(F.when(txn & (amount < 0), F.round(-amount * 10_000).cast("bigint"))).alias("out"),
        F.count_if(comm).alias("comms"),
        F.count(us).alias("rows"),
        (F.max(us) - F.min(us)).alias("all_span"),
    )
    parties = (
        events.where(txn & F.col("counterparty").isNotNull())
        .select("entity_id", "counterparty")
        .distinct()
        .groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("parties"))
    )
    one = F.lit(1.0)
    zero = F.lit(0)
    return base.join(parties, "entity_id", "left").select(
        "entity_id",
        F.when(F.col("n") > 1, F.col("n") / F.greatest(F.col("span") / day, one)).otherwise(F.col("n").cast("double")).alias("txn_velocity"),
        F.when(F.col("n") > 1, F.col("span") / hour / (F.col("n") - 1)).otherwise(0.0).alias("avg_hold_hours"),
        F.when(
            F.col("n") > 0,
            (F.coalesce("inn", zero) / 10_000) / F.greatest(F.coalesce("out", zero) / 10_000, one),
        ).otherwise(1.0).alias("in_out_ratio"),
        F.coalesce("parties", zero).cast("double").alias("unique_counterparties"),
        F.when(F.col("rows") > 1, F.col("comms") / F.greatest(F.col("all_span") / day, one)).otherwise(F.col("comms").cast("double")).alias("comms_per_day"),
    )


FEATURES = ("txn_velocity", "avg_hold_hours", "in_out_ratio", "unique_counterparties", "comms_per_day")


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(rows: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    """Append the nodes of one isolation tree; returns the index of its root."""
    at = len(nodes)
    lo, hi = rows.min(axis=0), rows.max(axis=0)
    free = np.flatnonzero(hi > lo)
    if depth >= limit or len(rows) <= 1 or len(free) == 0:
        nodes.append((-1, 0.0, -1, -1, depth + _average_path(len(rows))))
        return at
    f = int(rng.choice(free))
    cut_at = float(rng.uniform(lo[f], hi[f]))
    left = rows[:, f] < cut_at
    if not left.any() or left.all():
        cut_at = float(hi[f])
        left = rows[:, f] < cut_at
    nodes.append((f, cut_at, -1, -1, 0.0))
    a = _grow(rows[left], rng, depth + 1, limit, nodes)
    b = _grow(rows[~left], rng, depth + 1, limit, nodes)
    nodes[at] = (f, cut_at, a, b, 0.0)
    return at


TREE_SCHEMA = "tree int, node int, feature int, split double, lo int, hi int, depth double"


def isolation_flags(
    features: DataFrame,
    contamination: float = 0.1,
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
) -> DataFrame:
    """(entity_id, score, ml_anomaly): an isolation forest over the entity features.

    Each tree gets the ``sample`` entities with the smallest hash of (entity, tree), so
    the draw does not depend on partitioning. Trees grow side by side in groups of at
    most ``sample`` rows; the forest (at most 2 * sample nodes per tree, whatever the
    data size) goes to all tasks, which score entities in Arrow batches.
    """
    spark = features.sparkSession
    features = cut(features.select("entity_id", *FEATURES), "features")
    total = features.count()
    if total < 5:
        return features.select("entity_id", F.lit(0.0).alias("score"), F.lit(False).alias("ml_anomaly"))
    size = min(sample, total)
    # Draw a little more than needed by hash, then keep exactly the smallest.
    share = min(1.0, (sample * 1.5 + 64) / total)
    floor, width = -(2**63), 2.0**64
    top = int(min(floor + share * width, 2.0**63 - 1025)) if share < 1.0 else 2**63 - 1
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    if share < 1.0:
        tree = F.explode(
            F.filter(
                F.sequence(F.lit(0), F.lit(trees - 1)),
                lambda t: F.xxhash64("entity_id", t, F.lit(seed)) < top,
            )
        )
    drawn = features.select("*", tree.alias("tree")).withColumn("_h", F.xxhash64("entity_id", "tree", F.lit(seed)))
    drawn = top_per_key(drawn, ["tree"], [F.asc("_h"), F.asc("entity_id")], size, "_k")
    limit = max(1, math.ceil(math.log2(size)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        t = int(pdf["tree"].iloc[0])
        nodes: list = []
        _grow(pdf[list(FEATURES)].to_numpy(dtype=float), np.random.default_rng([seed, t]), 0, limit, nodes)
        out = pd.DataFrame(nodes, columns=["feature", "split", "lo", "hi", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", t)
        return out

    forest = drawn.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).toPandas()
    grown = spark.sparkContext.broadcast(
        [g.sort_values("node")[["feature", "split", "lo", "hi", "depth"]].to_numpy() for _, g in forest.groupby("tree")]
    )
    scale = _average_path(size) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        x = np.column_stack([a, b, c, d, e]).astype(float)
        depth = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in grown.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = t[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                go_lo = x[rows, np.where(inner, f, 0)] < t[at, 1]
                step = np.where(go_lo, t[at, 2], t[at, 3]).astype(int)
                at = np.where(inner, step, at)
            depth += t[at, 4]
        return pd.Series(np.power(2.0, -depth / len(grown.value) / scale))

    scored = cut(features.select("entity_id", score(*FEATURES).alias("score")), "scores")
    at = (1.0 - contamination) * (total - 1)
    low = order_statistic(scored, "score", math.floor(at))
    high = order_statistic(scored, "score", math.ceil(at))
    return scored.withColumn("ml_anomaly", F.col("score") > low + (high - low) * (at - math.floor(at)))


def order_statistic(df: DataFrame, column: str, rank: int, bins: int = 1024) -> float:
    """The value of ``rank`` (from 0) in ascending order, exactly.

    The range that holds it is narrowed to one of ``bins`` parts by counting until one value is
    left, so at most ``bins`` rows reach the driver, whatever the size of the data.
    """
    c = F.col(column).cast("double")
    low, high = df.agg(F.min(c), F.max(c)).first()
    while low < high:
        part = F.least(F.floor((c - low) / (high - low) * bins), F.lit(bins - 1))
        counts = df.where((c >= low) & (c <= high)).groupBy(part.alias("part"))
        parts = counts.agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
        for r in parts.agg(F.array_sort(F.collect_list(F.struct("part", "n", "lo", "hi")))).first()[0]:
            if rank < r["n"]:
                low, high = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return low


def combine_scores(firings: DataFrame, flags: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Every entity with its tier and, kept apart from it, the anomaly flag."""
    out = risk_tiers(firings)
    if flags is not None:
        out = out.join(flags.select("entity_id", "ml_anomaly"), "entity_id", "full")
    else:
        out = out.withColumn("ml_anomaly", F.lit(False))
    if entities is not None:
        out = out.join(entities.select("entity_id").distinct(), "entity_id", "full")
    none = F.array().cast("array<string>")
    return out.select(
        "entity_id",
        F.coalesce("risk_tier", F.lit("LOW")).alias("risk_tier"),
        F.coalesce("n_rules", F.lit(0)).cast("bigint").alias("n_rules"),
        F.coalesce("rules_fired", none).alias("rules_fired"),
        "rule_severities",
        F.coalesce("ml_anomaly", F.lit(False)).alias("ml_anomaly"),
    )


def tier_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if("ml_anomaly").alias("ml_flagged")
    )
