"""Document rules and the likelihood ratio against plain Python."""
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evifuse.llm import quality_rules as q
from evifuse.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    words = WORD.findall(text or "")
    wins = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if wins[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n_dup = len(lines) - len(set(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), n_dup, len(covered), failed


def grams(text):
    tokens = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text or "")
    return [(t,) for t in tokens] + list(zip(tokens, tokens[1:]))


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, sf).collect()}
    assert len(got) == len(docs)
    good = set(labels[labels.quality == 1].doc_id)
    per_doc = {d: grams(t) for d, t in zip(docs.doc_id, docs.text)}
    every = sorted({g for gs in per_doc.values() for g in gs})
    ones = spark.createDataFrame([(list(g),) for g in every], "g array<string>")
    hashed = ones.select("g", F.when(F.size("g") == 1, F.pmod(F.hash(F.col("g")[0]), F.lit(q.BUCKETS))).otherwise(F.pmod(F.hash(F.col("g")[0], F.get("g", F.lit(1))), F.lit(q.BUCKETS))).alias("b"))
    bucket = {tuple(r["g"]): r["b"] for r in hashed.collect()}
    raw, target = Counter(), Counter()
    for d, gs in per_doc.items():
        for g in gs:
            raw[bucket[g]] += 1
            target[bucket[g]] += d in good
    r, t = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log((target[b] + 1) / (t + q.BUCKETS)) - math.log((raw[b] + 1) / (r + q.BUCKETS))
    for d, text in zip(docs.doc_id, docs.text):
        x, want = got[d], rules(text)
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == want, d
        score = sum(ratio(bucket[g]) for g in per_doc[d]) / len(per_doc[d]) if per_doc[d] else 0.0
        assert x["kept"] == (not want[-1] and score >= q.THRESHOLD), (d, score)
    kept = {d for d in got if got[d]["kept"]}
    low = set(labels[labels.quality == 0].doc_id)
    long_good = {d for d in good if rules(docs.text[docs.doc_id == d].iloc[0])[0] >= 50}
    assert len(kept & low) == 0 and len(long_good - kept) <= 0.02 * len(long_good)


@pytest.mark.parametrize("text", [None, "", "   \n\t", "a b a b a b a", "x\nx\n\nx \n", "a\x0bb\x0cc a\tb\rc a", "é  ß k 😀", "w " * 200, "#*$ %&| <>"])
def test_rule_columns_of_odd_texts(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    x = q.document_rules(df).first()
    assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == rules(text)


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(None, "word other " * 40, "k", "r"), (1, None, None, None), (1, None, None, None), (2, " ".join(f"w{i}" for i in range(60)), "k", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _words string, kept string")
    good = spark.createDataFrame([(2,), (2,), (None,)], "doc_id bigint")
    out = q.quality_rules(df, good).collect()
    assert len(out) == 4 and {r["_words"] for r in out} == {"k", None}
    assert [r["kept"] for r in out if r["doc_id"] == 2] == [True]
    assert q.quality_rules(df.limit(0), good).count() == 0
    assert q.quality_rules(df, good.limit(0)).where("kept").count() == 1


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 30_000}" for i in range(60_000))
    x = q.document_rules(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert x["n_words"] == 60_000 and x["n_repeat_words"] == 60_000
