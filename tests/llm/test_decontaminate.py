"""Contaminated documents against every window of every document."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from evifuse.llm import decontaminate as d
from evifuse.llm.queries import QUERIES


def words(text):
    return (text or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if (text or "").strip() else []


def bag(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, threshold=0.8):
    """{(document, item): (start, similarity)} of the most similar passages, the first if equal."""
    out = {}
    for i, t in items:
        iw = [x for x in words(t) if x]
        n, k = len(iw), min(5, len(iw))
        want = bag(iw, k) if n else None
        for doc, text in docs:
            w = [x for x in words(text) if x]
            at = [j for j in range(len(w) - k + 1) if n and tuple(w[j:j + k]) in want]
            for s in range(max(0, at[0] - n), min(max(1, len(w) - n + 1), at[-1] + 1)) if at else ():
                if w[s:s + n] and len(w[s:s + n]) >= k:
                    have = bag(w[s:s + n], k)
                    both = sum((have & want).values())
                    x = both / (sum(have.values()) + sum(want.values()) - both)
                    if both and x >= threshold - 1e-9 and x > out.get((doc, i), (0, 0))[1]:
                        out[doc, i] = (s, x)
    return out


def test_query_matches_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = QUERIES["op6_benchmark_decontamination"](spark, sf).collect()
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in rows}
    shared = {x for _, t in items for x in bag(words(t), 5)}
    some = [(i, t) for i, t in docs if shared & set(bag(words(t), 5))]
    assert got and len(rows) == len(got) and got == brute(some, items)


def test_edited_passages(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 9, 15, 28, 60, 100, 200, 400])))) for i in range(60)]
    docs = []
    for n in range(600):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(1 + len(w) // 25)):
            k = rng.randrange(len(w))
            w[k:k + rng.randrange(2)] = [f"x{rng.random()}"] * rng.randrange(2)
        if rng.random() < 0.4:
            w = w[rng.randrange(3):]
        docs.append((n, " ".join(rng.choices(vocabulary, k=rng.randrange(80)) + w + rng.choices(vocabulary, k=rng.randrange(80))).upper()))
    rows = d.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in rows}
    assert got == brute(docs, items)


def test_the_first_of_two_equally_similar_passages(spark):
    item = " ".join(f"w{i}" for i in range(30))
    near = item.replace("w29", "other")
    docs = [(1, f"a b {near} c {near} d"), (2, f"{near} x {item} y {item}")]
    rows = d.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in rows} == brute(docs, [(7, item)])
    assert sorted(r["start"] for r in rows) == [1, 31]  # a word before and the last word after cost the same


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    a = d.Anchors(base, np.arange(300), np.zeros(300, int), 3)
    fp = base[rng.integers(0, 300, 4000)]
    for _ in range(5):
        flip = rng.random(4000) < 0.7
        fp = np.where(flip, fp ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)), fp)
    w, i = a.near(fp, np.ones(4000, bool))
    want = {(x, y) for x in range(4000) for y in np.flatnonzero(d.hamming(base, np.full(300, fp[x])) <= 3)}
    assert set(zip(w.tolist(), i.tolist())) == want and len(want) > 1000


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(500)}" for _ in range(30))) for i in range(25)]
    docs = [(n, " ".join(f"v{rng.randrange(500)}" for _ in range(70)) + " " + items[n % 25][1] + " tail " * 40) for n in range(50)]
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(tuple(r) for r in d.contaminated(a, b).collect())
    texts = pa.array([t for _, t in docs])
    index = d.build_index(pa.array([t for _, t in items]))
    plain = d.find_matches(texts, index, 0.8)
    monkeypatch.setattr(d, "BLOCK_WORDS", 64)
    monkeypatch.setattr(d, "PASS_ITEMS", 10)
    assert d.find_matches(texts, index, 0.8) == plain and len(want) == 50
    assert sorted(tuple(r) for r in d.contaminated(a, b).collect()) == want
    assert d.drop_contaminated(a, b).count() == 0


def test_odd_rows(spark):
    item = "one two three four five six seven eight"
    rows = [(1, None, 5), (None, f"x {item} y", 6), (2, "", 7), (3, item, 8), (3, item, 8), (4, "word " * 50_000 + item, 9)]
    a = spark.createDataFrame(rows, "doc_id bigint, text string, _match_text int")
    b = spark.createDataFrame([(1, item), (2, None), (3, " "), (None, "word")], "item_id bigint, text string")
    got = sorted([(r["doc_id"], r["item_id"], r["start"]) for r in d.contaminated(a, b).collect()], key=str)
    assert got == sorted([(None, 1, 1), (3, 1, 0), (3, 1, 0), (4, 1, 50_000), (4, None, 0)], key=str)
    kept = d.drop_contaminated(a, b)
    assert kept.columns == a.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert d.contaminated(a.limit(0), b).count() == 0 and d.contaminated(a, b.limit(0)).count() == 0
    assert d.drop_contaminated(a, b.limit(0)).count() == 6
