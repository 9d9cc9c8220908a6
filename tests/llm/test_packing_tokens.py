"""Packing plan and places, word ids and pre-tokens against the libraries."""
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evifuse.llm import packing, tokens
from evifuse.llm.common import tokenizer_path
from evifuse.llm.queries import QUERIES
from tests.llm.test_pipeline import check_packing

WORDS, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
PARTS = [*"abcdeABC  \n\n\t\r.,,..!é€▁ <>s/01xÀÉ", "<s>", "<unk>", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "'s", "\x1c", "\x85", "ǅ", "́", "中", "😀", "ß", "ſ", "K", "the", "\x00", "<0x0A>"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(20))) for _ in range(n)]


def test_word_ids_match_the_library(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 800)
    tokenizer, texts = Tokenizer.from_file(WORDS), odd_texts(4000, 1)
    for t, ids in zip(texts, packing.WordIds(WORDS).texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_piece_lengths_match_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 500)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lengths = tokens.PieceLengths(PIECES, {"the": 1})
    for t in odd_texts(4000, 2):
        assert sum(map(lengths.__getitem__, tokens.pretokens(t))) == len(model.encode(t)), repr(t)


def test_token_count_query(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in QUERIES["op10_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, n = got[d["doc_id"]], len(model.encode(d["text"]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(d["text"].encode()), n, n > 4096)


def test_frequent_pretokens_come_from_all_partitions(spark):
    rows = [(f"first{i} first{i}",) for i in range(60)] + [("common words",)] * 180
    texts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "text string")
    assert set(tokens.frequent_lengths(texts, PIECES, 2, sample_rows=80)) == {"common", "words"}


def test_token_counts_of_odd_rows(spark):
    rows = [(None, "a b", 1), (1, None, 2), (2, "", 3), (3, "x", 4), (3, "x", 4), (4, "w " * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted([tuple(r) for r in tokens.token_counts(df, PIECES).collect()], key=str)
    assert got == sorted([(None, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 1, 1, False), (3, 1, 1, False), (4, 200_000, 100_001, True)], key=str)
    assert tokens.token_counts(df.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("capacity", [1, 10, 64, 4096])
def test_plan_places_every_piece_once(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        counts = {rng.randint(1, capacity): rng.randint(1, 150) for _ in range(rng.randrange(50))}
        rows, bins = packing.plan_packing(counts, capacity)
        seen, filled = set(), {}
        for size, lo, hi, per, first, at in rows:
            for r in range(lo, hi):
                seen.add((size, r))
                filled.setdefault(first + (r - lo) // per, []).append((at + (r - lo) % per * size, size))
        assert seen == {(s, r) for s, n in counts.items() for r in range(n)} and len(filled) == bins
        for parts in filled.values():
            end = 0
            for at, size in sorted(parts):
                assert at == end
                end += size
            assert end <= capacity and sum(3 * s > capacity for _, s in parts) <= 2


def test_packing_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packing(QUERIES["op8_best_fit_packing"](spark, sf).collect(), docs)


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 2)
    rows = [(None, "a b", 1), (1, None, 2), (2, "", 3), *[(n, "same", n) for n in range(10, 60)], (4, "w " * 20_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    check_packing(packing.pack_documents(df, WORDS).collect(), [(d, t) for d, t, _ in rows])
    two = packing.pack_documents(spark.createDataFrame([(3, "x"), (3, "x")], "doc_id bigint, text string"), WORDS).collect()
    assert len(two) == 2 and len({(r["sequence_id"], r["offset"]) for r in two}) == 2
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0
