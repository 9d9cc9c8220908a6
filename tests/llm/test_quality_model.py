"""The byte network: gradients, held-out accuracy, whole texts, odd rows."""
import zlib

import numpy as np
import pytest

from evifuse.llm import quality_model as m
from evifuse.llm.queries import QUERIES


def test_gradients_match_differences():
    rng = np.random.Generator(np.random.PCG64(3))
    texts = [m.blocks_of(rng.integers(97, 105, n).astype(np.uint8)) for n in (40, 300, 900)]
    y = np.array([0.0, 1.0, 1.0])
    net = m.Network.start(1)
    for k in net.parts:
        setattr(net, k, getattr(net, k).astype(np.float64))

    def loss():
        starts = np.cumsum([0, *[len(p) // m.BLOCK for p in texts[:-1]]])
        top = np.maximum(m.convolve(net, np.concatenate(texts)).max(axis=1), 0)
        p, _ = m.probability(net, m.combine(top, starts, np.array([np.count_nonzero(t) for t in texts]))[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = m._gradients(net, texts, y)
    for k in net.parts:
        w, g = getattr(net, k), grads[k]
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in w.shape) if k != "table" else (rng.integers(m.WIDTH), rng.integers(97, 105), rng.integers(m.FILTERS))
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 2e-4, (k, at)


def plain_score(net, text):
    """Forward pass in loops, one text alone."""
    data = [max(b, 1) for b in text]
    n_blocks = -(-(max(len(data), 1) + m.WIDTH - 1) // m.BLOCK)
    tops = []
    for block in range(n_blocks):
        top = [0.0] * m.FILTERS
        for at in range(block * m.BLOCK, min((block + 1) * m.BLOCK, len(data))):
            for f in range(m.FILTERS):
                z = float(net.bias[f])
                for w in range(m.WIDTH):
                    if at + w < len(data):
                        z += float(net.table[w, data[at + w], f])
                top[f] = max(top[f], z)
        tops.append(top)
    chunks = [[max(a, b) for a, b in zip(tops[k], tops[min(k + 1, n_blocks - 1)], strict=True)] for k in range(n_blocks)]
    doc = [sum(c[f] for c in chunks) / n_blocks for f in range(m.FILTERS)] + [max(c[f] for c in chunks) for f in range(m.FILTERS)]
    doc += [min(len(data) / (2 * m.BLOCK), 1), np.log1p(len(data)) / 8]
    hidden = [np.tanh(sum(x * float(net.dense[i, j]) for i, x in enumerate(doc)) + float(net.dense_bias[j])) for j in range(m.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(h * float(net.out[j]) for j, h in enumerate(hidden)) + float(net.out_bias[0]))))


def test_scores_match_a_forward_pass_in_loops(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(9))
    net = m.Network.start(4)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 5, 120, 121, 122, 127, 128, 129, 255, 256, 400, 1000)]
    want = [plain_score(net, t.tolist()) for t in texts]
    assert np.allclose(m.scores(net, texts), want, atol=1e-5)
    assert np.allclose(m.scores(net, texts[::-1])[::-1], want, atol=1e-5)  # neighbours don't matter
    monkeypatch.setattr(m, "SCORE_BYTES", 2 * m.BLOCK)
    assert np.allclose(m.scores(net, texts), want, atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(rows[d]["predicted"], y) for d, y in labels.items() if d in rows and rows[d]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_a_long_text_is_scored_whole(monkeypatch):
    net = m.Network.start(2)
    rng = np.random.Generator(np.random.PCG64(4))
    long = rng.integers(1, 255, 50_000).astype(np.uint8)
    texts = [long, long[:100], np.zeros(0, np.uint8), long[:-1]]
    whole = m.scores(net, texts)
    monkeypatch.setattr(m, "SCORE_BYTES", 1024)
    assert np.allclose(m.scores(net, texts), whole, atol=1e-5)
    changed = long.copy()
    changed[-300:] = 33
    assert m.scores(net, [changed])[0] != whole[0]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, ""), (3, "\x00b"), (4, "c")], "doc_id bigint, text string").selectExpr("*", "1 as score")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, None), (None, 1), (4, 1), (4, 5)], "doc_id bigint, quality int")
    got = m.score_quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert m.score_quality(docs.limit(0), labels).count() == 0
    none = m.score_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129])
def test_blocks(n):
    b = m.blocks_of(np.full(n, 7, np.uint8))
    assert len(b) % m.BLOCK == 0 and len(b) >= m.BLOCK and np.count_nonzero(b) == n
