"""SimHash links: fingerprints by definition, the grid against all pairs, and components against a plain search."""
import re

import numpy as np
import pytest
import xxhash

from evifuse.llm import simhash_links as m
from evifuse.llm.bytewords import SPACE_BYTES, lowered
from evifuse.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text, size=4):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(fps, radius):
    """Smallest index connected to each."""
    fps, left, out = np.array(fps, np.uint64), set(range(len(fps))), [0] * len(fps)
    while left:
        group, edge = set(), {min(left)}
        while edge:
            group |= edge
            near = {int(j) for i in edge for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius)}
            edge = near - group
        for i in group:
            out[i] = min(group)
        left -= group
    return out


def close_prints(n, seed=0):
    """Fingerprints in clusters, at the distances that matter."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)
    out = [*base, np.uint64(0), np.uint64(2**64 - 1)]
    while len(out) < n:
        x = out[rng.integers(len(out))]
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= np.uint64(1 << int(b))
        out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_every_close_pair_shares_a_cell(radius):
    fps = close_prints(600, radius)
    index, cell = m.cells(fps, radius)
    shared = {}
    for i, c in zip(index.tolist(), cell.tolist(), strict=True):
        shared.setdefault(c, []).append(i)
    met = {(i, j) for members in shared.values() for i in members for j in members}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    assert near.sum() > (1.2 * len(fps) if radius else 0)
    assert all((i, j) in met for i, j in zip(*np.nonzero(near), strict=True) if i != j)
    assert radius < 4 or len(index) < 45 * len(fps)


def test_cell_links_of_small_and_large_cells():
    rng = np.random.default_rng(2)
    fps = close_prints(500)
    for groups in (3, 120):
        group, slot = np.sort(rng.integers(0, groups, len(fps))), rng.integers(0, 3, len(fps))
        for across in (False, True):
            src, dst = m.cell_links(fps, group, slot, np.full(len(fps), across), 4)
            near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
            near &= group[:, None] == group[None, :]
            if across:
                near &= slot[:, None] != slot[None, :]
            want = m.forest(*(fps[x] for x in np.nonzero(near)))
            assert len(src) < len(fps) and dict(zip(src.tolist(), dst.tolist(), strict=True)) == dict(zip(want[0].tolist(), want[1].tolist(), strict=True))


def test_fingerprints_of_any_length():
    table = lowered(SPACE_BYTES)
    for text in (None, "", " \n", "One", "one TWO three", "a b c d", "Ä b\x0bc d É", "q w e r " * 40, "many words here " * 90_000):
        want = plain_print(text) if text is None or len(text) < 10_000 else None
        got = m.fingerprint((text or "").encode(), table, 4)
        assert want is None or got == want
    import evifuse.llm.bytewords as bw

    text = "some words and 12 Others\tof different length " * 30
    whole = [g for block in bw.gram_blocks(text.encode(), table, 4) for g in block]
    parts = [g for block in bw.gram_blocks(text.encode(), table, 4, block=7) for g in block]
    assert whole == parts and len(whole) == len(text.split()) - 3


def test_query(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [plain_print(t) for _, t in docs]
    want = {d: (f"{f:016x}", docs[g][0]) for (d, _), f, g in zip(docs, fps, plain_groups(fps, 4), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op13_simhash_near_dedup"](spark, sf).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(got)


def test_odd_rows_and_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(m, "SLOT", 3)  # every cluster is cut into slots
    base = [f"w{k}" for k in range(300)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, "lonely words that nobody else has"), (4, "Tiny"), (5, "tiny"), (5, "tiny"), (6, "long text " * 100_000)]
    for k in range(60):
        words = list(base)
        words[k % 40] = f"edit{k}"
        rows.append((100 + k, " ".join(words)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, fp string")
    fps = [plain_print(t) for _, t in rows]
    first = {}
    for (d, _), g in zip(rows, plain_groups(fps, 4), strict=True):
        first[g] = min((x for x in (first.get(g), d) if x is not None), default=None)
    want = sorted((d is not None, d, f"{f:016x}", first[g]) for (d, _), f, g in zip(rows, fps, plain_groups(fps, 4), strict=True))
    got = m.simhash_components(df).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert m.simhash_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        m.simhash_components(df, radius=5)
