"""Each stage of the pipeline against brute force on what the stage before kept."""
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from evifuse.llm.common import tokenizer_path
from evifuse.session import cut
from tests.llm import test_decontaminate, test_line_dedup, test_ngram_join, test_quality_rules


@pytest.fixture(scope="module")
def steps(spark, sf):
    frames = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in p.STAGES:
        frames.append(cut(stage(spark, frames[-1], sf)))
    return frames


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_names_and_columns(steps):
    assert len(p.STAGES) == 5
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_quality_stage(steps, spark, sf):
    before, after = texts(steps[0]), texts(steps[1])
    low = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    kept = {d for d, _ in after}
    assert set(after) <= set(before) and not kept & low
    fine = [d for d, t in before if not test_quality_rules.rules(t)[-1] and d not in low]
    assert kept <= set(fine) and len(kept) > 0.85 * len(fine)


def test_line_stage(steps):
    want = {d: t for d, t in test_line_dedup.brute(texts(steps[1])).items() if t.strip()}
    assert dict(texts(steps[2])) == want
    for r in steps[2].collect():
        assert r["n_chars"] == len(r["text"])


def test_near_duplicate_stage(steps):
    before = texts(steps[2])
    group, _ = test_ngram_join.brute(before)
    first = {}
    for g, (d, _) in zip(group, before, strict=True):
        first[g] = min(first.get(g, d), d)
    assert {d for d, _ in texts(steps[3])} == set(first.values())


def test_benchmark_stage(steps, spark, sf):
    before = texts(steps[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {d for d, _ in test_decontaminate.brute(before, items)}
    assert texts(steps[4]) == [(d, t) for d, t in before if d not in held]


def check_packing(rows, docs):
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[d, k] = (at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(places) <= 1.02 * total / 4096 + 1


def test_packing_stage(steps):
    check_packing(steps[5].collect(), texts(steps[4]))


def test_run_gives_the_last_stage(steps, spark, sf):
    a, b = p.run(spark, sf), steps[5]
    assert a.columns == b.columns and a.drop("sequence_id", "offset").exceptAll(b.drop("sequence_id", "offset")).isEmpty() and a.count() == b.count()


def test_stages_take_empty_and_odd_tables(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "w " * 70, None, None, None)], schema)
    for name, stage in p.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0, name
        stage(spark, odd, sf).collect()
