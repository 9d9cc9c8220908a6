"""Importance resampling: planes against plain sums, and the whole query against a plain rendering of the rule."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from evifuse.llm import importance as m
from evifuse.llm.queries import QUERIES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, max_n=1):
    w = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)


def plain(docs, target, percent=10, min_words=20, max_n=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [features(t, max_n) for _, t in docs]
    s = Counter(bucket(f) for fs, _ in found for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, max_n)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (doc_id, _), (fs, words) in zip(docs, found, strict=True):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    order = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0]))
    drawn = {id(r): k for k, r in enumerate(order[:len(order) * percent // 100], 1)}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])


def test_plane_sums_are_dot_products():
    rng = np.random.default_rng(1)
    for buckets in (1, 63, 64, 1000):
        gains = rng.integers(-9000, 9000, buckets).tolist()
        counts = rng.integers(0, 9, (5, buckets)) * rng.integers(0, 2, (5, buckets))
        counts[1] = 0
        counts[2, 0] = 1_000_003
        keys = np.flatnonzero(counts.ravel())
        planes, values = m.gain_planes(gains)
        assert (m.plane_sums(keys, counts.ravel()[keys], 5, buckets, planes, values) == counts @ np.array(gains)).all()
    planes, values = m.gain_planes([-1, 0, -1])
    assert m.plane_sums(np.array([0, 2]), np.array([3, 4]), 1, 3, planes, values).tolist() == [-7]


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert keyed(QUERIES["op12_importance_resampling"](spark, sf).collect()) == keyed(plain(docs, target))


def test_odd_rows_ties_and_longer_features(spark):
    rows = [(1, None), (2, ""), (3, "É1 É2 " * 30), (4, "Ab-cd " * 12), (5, "ab cd " * 12), (6, "word " * 200_000), (7, "x" * 3_000_000), (None, "aa bb " * 15)]
    rows += [(k % 7, "same words in every one of these rows and a few more to be long enough for any draw at all") for k in range(40)]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id bigint, text string, score double, n_words int").repartition(3)
    goal = spark.createDataFrame([("ab cd",), (None,), ("word in the long draw",)], "text string")
    for percent, max_n in ((10, 1), (60, 2), (100, 3)):
        got = m.resample(df, goal, percent=percent, max_n=max_n, buckets=97).collect()
        assert keyed(got) == keyed(plain(rows, ["ab cd", None, "word in the long draw"], percent, 20, max_n, 97))
    assert m.resample(df.limit(0), goal).count() == 0
    assert [r["rank"] for r in m.resample(df.where("doc_id < 3 and length(text) < 9"), goal.limit(0)).collect()] == [None]


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(m, "RANGE_ROWS", 50)
    rows = spark.range(4000).selectExpr("id as doc_id", "20 + id % 3 as n_words", "id % 11 as score")
    got = m.top_ranks(rows, 1234, "doc_id", "n_words >= 21").collect()
    order = sorted(((-(d % 11), d) for d in range(4000) if 20 + d % 3 >= 21))[:1234]
    assert {r["doc_id"]: r["rank"] for r in got if r["rank"]} == {d: k for k, (_, d) in enumerate(order, 1)} and len(got) == 4000
