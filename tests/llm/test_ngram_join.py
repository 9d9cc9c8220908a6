"""Near-duplicate classes and links against all pairs."""
import random

from evifuse.llm import ngram_join as j
from evifuse.llm.queries import QUERIES


def shingles(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """{position: (class members, links)} over all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                parent[find(x)] = find(y)
    return [find(x) for x in range(len(rows))], links


def check(spark, rows):
    got = {r["doc_id"]: r for r in j.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    group, links = brute(rows)
    smallest = {}
    for g, (d, _) in zip(group, rows):
        smallest[g] = min(smallest.get(g, d), d)
    for (d, _), g, n in zip(rows, group, links):
        assert (got[d]["class_id"], got[d]["n_links"]) == (smallest[g], n), d
    assert len(got) == len(rows)


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.random()}"
    return " ".join(w)


def test_query_matches_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op7_ngram_jaccard_join"](spark, sf).collect()}
    group, links = brute(rows)
    smallest = {}
    for g, (d, _) in zip(group, rows):
        smallest[g] = min(smallest.get(g, d), d)
    assert {d: (r["class_id"], r["n_links"]) for d, r in got.items()} == {d: (smallest[g], n) for (d, _), g, n in zip(rows, group, links)}


def test_a_large_group_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_NODES", 20)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(base, rng.randrange(7), rng)) for i in range(150)]
    rows += [(1000 + i, " ".join(f"v{i}_{k}" for k in range(40))) for i in range(40)]
    check(spark, rows)


def test_blocks_without_members(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_SHINGLES", 20)
    rng = random.Random(6)
    rows = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(120)]
        rows += [(10 * g + i, edited(base, i % 3, rng)) for i in range(2 + g % 4)]
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one "), (6, "two words"), (7, "two  words"), (8, long), (9, long + " more"), (10, "a b c d e"), (11, "a b c d f")]
    check(spark, rows)


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(None, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "a b c d e f", 3), (8, None, 4), (8, None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k1 int")
    got = sorted([tuple(r) for r in j.near_duplicates(df).collect()], key=str)
    assert got == sorted([(None, None, 2), (7, None, 2), (7, None, 2), (8, 8, 0), (8, 8, 0)], key=str)
    kept = j.drop_near_duplicates(df).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in kept], key=str) == sorted([(None, "a b c d e f"), (8, None)], key=str)
    assert j.drop_near_duplicates(df).columns == ["doc_id", "text", "k1"]
    assert j.near_duplicates(df.limit(0)).count() == 0


def test_band_choice():
    for t in (0.5, 0.8, 0.9):
        b, r = j.choose_bands(t, 0.998)
        assert 1 - (1 - t**r) ** b >= 0.998 and b * r <= j.MAX_HASHES
