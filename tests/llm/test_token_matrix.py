"""Packed matrices: round trip, segment bounds, position resets, and the tree against a plain search."""
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from evifuse.llm import token_matrix as m
from evifuse.llm.common import tokenizer_path
from evifuse.llm.queries import QUERIES

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


def unpack(rows, capacity):
    """{document: text} from the matrices, checking bounds and positions."""
    pieces = {}
    for r in rows:
        ids, positions = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4")
        cu = r["cu_seqlens"]
        assert len(ids) == len(positions) == capacity and cu[0] == 0 and cu[-1] == r["n_tokens"] <= capacity
        assert len(cu) == r["n_segments"] + 1 and (ids[cu[-1]:] == m.END_ID).all() and (positions[cu[-1]:] == 0).all()
        for lo, hi, doc, piece, start in zip(cu[:-1], cu[1:], r["doc_ids"], r["pieces"], r["starts"], strict=True):
            assert (positions[lo:hi] == np.arange(hi - lo)).all()
            pieces.setdefault(doc, []).append((piece, start, ids[lo:hi]))
    enc = m.byte_encoder(PATH, public_tokenizers.PATTERN)
    out = {}
    for doc, parts in pieces.items():
        parts.sort(key=lambda x: x[0])
        assert [p[0] for p in parts] == list(range(len(parts))) and all(p[1] == k * capacity for k, p in enumerate(parts))
        ids = np.concatenate([p[2] for p in parts])
        assert ids[-1] == m.END_ID
        out[doc] = enc.decode(ids[:-1].tolist())
    return out


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = m.pack_matrix(docs, PATH, public_tokenizers.PATTERN, capacity=512).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert unpack(rows, 512) == {r["doc_id"]: r["text"] for r in docs.collect()}
    total = sum(r["n_tokens"] for r in rows)
    assert len(rows) <= 1.05 * total / 512 + 4


def test_query_keeps_every_segment(spark, sf):
    rows = QUERIES["op9_token_matrix"](spark, sf).collect()
    assert sorted({d for r in rows for d in r["doc_ids"]}) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_tree_is_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([1, 7, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(60))]
        bins, free = m.best_fit_decreasing(lengths, capacity), []
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(capacity - n)
        assert sorted(capacity - sum(lengths[i] for i in b) for b in bins) == sorted(free)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))


def test_odd_rows_blocks_and_files(spark, monkeypatch, tmp_path):
    rows = [(1, None, 1), (2, "", 2), (None, "x퟿ <|endoftext|> é", 3), (3, "same", 4), (4, "word " * 40_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(3)
    got = m.pack_matrix(df, PATH, public_tokenizers.PATTERN).collect()
    assert unpack(got, m.CAPACITY) == {d: t or "" for d, t, _ in rows}
    assert m.pack_matrix(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    m.write_packed(m.pack_matrix(df, PATH, public_tokenizers.PATTERN, capacity=64), f"{tmp_path}/packed")
    assert unpack(spark.read.parquet(f"{tmp_path}/packed").collect(), 64) == {d: t or "" for d, t, _ in rows}
    two = spark.createDataFrame([(5, "a"), (5, "a")], "doc_id bigint, text string")
    assert m.pack_matrix(two, PATH, public_tokenizers.PATTERN).select(F.sum("n_segments")).first()[0] == 2
