"""SimHash near duplicates: fingerprints as points of bit counts, a grid join under Manhattan distance, exact verification.

A half of a fingerprint is cut into segments of two bits, and each segment is mapped to its number of set bits. The
Manhattan distance of two such points is never more than the number of differing bits. Two fingerprints
within 4 bits differ by at most 2 in the first half, or by at most 1 in the second (were it 3 and 2, it would be 5).
So each half is a range join of points on the grid of whole numbers:

* reach 2: two points within distance 2 share a grid cell within distance 1 of both, so every
  point goes to its own cell and to the neighbours, 25 on average;
* reach 1: one of two neighbours has an odd coordinate sum, so only odd points go to neighbour cells, too.

Members of a cell are compared with each other on all 64 bits, and a cell reports only as many links as connect
what it found. A cell that too many fingerprints share is cut into slots, and pairs of slots are compared apart.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.llm.bytewords import SPACE_BYTES, gram_blocks, lowered, word_blocks
from evifuse.operators.resolution import components
from evifuse.session import cut

SHINGLE, RADIUS, SEED = 4, 4, 42
SEGMENTS = 16  # in a half, of two bits each
# Fingerprints of one point, and of one slot of a crowded cell, that are compared in one group.
SLOT = 4096
# Members up to which a cell is compared by shifts along all cells of a batch instead of a matrix of its own.
SMALL = 32
_EVEN = np.uint64(0x55555555)


def fingerprint(data: bytes, table: bytes, size: int) -> int:
    """Majority of the bits of XXH64 over all shingles; a text of fewer words is one shingle, one of none is zero."""
    import xxhash

    hash64, seed = xxhash.xxh64_intdigest, SEED
    ones, n = np.zeros(64, np.int64), 0
    for grams in gram_blocks(data, table, size):
        h = np.fromiter((hash64(g, seed) for g in grams), np.uint64, len(grams))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(grams)
    if not n:
        words = [w for block in word_blocks(data, table) for w in block]
        return hash64(b" ".join(words), seed) if words else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every document; fp is the fingerprint's 64 bits as a signed number."""
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"))
    table = lowered(SPACE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py() or b"", table, size) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return texts.mapInArrow(run, T.StructType([T.StructField(id_col, texts.schema[0].dataType), T.StructField("fp", T.LongType())]))


def reaches(radius: int) -> tuple[int, int]:
    """Distances of the two halves, one of which a pair within ``radius`` keeps (-1: that half is not needed)."""
    if not 0 <= radius <= 4:
        raise ValueError("the grid covers 0 to 4 differing bits")
    return radius // 2, (radius + 1) // 2 - 1


def points(fp: np.ndarray, half: int) -> np.ndarray:
    """The 16 bit counts of a half, two bits each."""
    x = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
    return (x & _EVEN) + ((x >> np.uint64(1)) & _EVEN)


def cells(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fp``, cell) for every grid cell of every fingerprint."""
    index, cell = [], []
    for half, reach in enumerate(reaches(radius)):
        if reach < 0:
            continue
        p, name = points(fp, half), np.uint64(half << 32)
        every = np.arange(len(fp))
        index.append(every)
        cell.append(p | name)
        moving = every if reach == 2 else every[np.bitwise_count(fp >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)) & 1 == 1] if reach == 1 else every[:0]
        for s in range(SEGMENTS):
            one = np.uint64(1 << (2 * s))
            value = (p[moving] >> np.uint64(2 * s)) & np.uint64(3)
            up, down = moving[value < 2], moving[value > 0]
            index += [up, down]
            cell += [(p[up] + one) | name, (p[down] - one) | name]
    return np.concatenate(index), np.concatenate(cell).view(np.int64)


def spread(fps: DataFrame, radius: int) -> DataFrame:
    """(cell, fp, n) for every grid cell of every row (fp, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at:at + 4096]
                index, cell = cells(part.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[index]), pa.array(n[at:at + 4096][index])], names=["cell", "fp", "n"])

    return fps.select("fp", "n").mapInArrow(run, "cell bigint, fp bigint, n bigint")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest connected node) that connect what the pairs (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root != root[root]).any():
            root = root[root]
        left = root[u] != root[v]
        u, v = u[left], v[left]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def cell_links(fp: np.ndarray, group: np.ndarray, slot: np.ndarray, across: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` between members of equal ``group`` (rows are sorted by it), as a forest.

    Where ``across`` is set only members of different slots are compared.
    """
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    sizes = np.diff(edges)
    a, b = [np.zeros(0, fp.dtype)], [np.zeros(0, fp.dtype)]
    rest = np.repeat(edges[1:], sizes) - np.arange(len(fp)) - 1  # later members of the same group
    rest[np.repeat(sizes > SMALL, sizes)] = 0
    for d in range(1, SMALL):
        i = np.flatnonzero(rest >= d)
        if not len(i):
            break
        j = i + d
        hit = close(fp[i], fp[j], radius) & (fp[i] != fp[j]) & (~across[i] | (slot[i] != slot[j]))
        a.append(fp[i[hit]])
        b.append(fp[j[hit]])
    for k in np.flatnonzero(sizes > SMALL):
        lo, hi = edges[k], edges[k + 1]
        x, s, apart = fp[lo:hi], slot[lo:hi], across[lo]
        for at in range(0, hi - lo, 512):
            m = close(x[at:at + 512, None], x[None, at:], radius)
            if apart:
                m &= s[at:at + 512, None] != s[None, at:]
            i, j = np.nonzero(m)
            found = forest(x[at:][i], x[at:][j])  # no more links than members
            a.append(found[0])
            b.append(found[1])
    return forest(np.concatenate(a), np.concatenate(b))


def verified(rows: DataFrame, radius: int) -> DataFrame:
    """(src, dst) links; ``rows`` (cell, lo, hi, slot, fp) is partitioned and sorted by cell, lo and hi."""

    def links(t: pa.Table) -> pa.RecordBatch:
        cell, lo, hi, slot, fp = (t.column(c).to_numpy() for c in range(5))
        group = np.cumsum(np.concatenate([[True], (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        src, dst = cell_links(fp.view(np.uint64), group, slot, lo != hi, radius)
        return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in range(3)])
            last = int(np.argmax((keys == keys[:, -1:]).all(axis=0)))  # where the batch's last group starts
            whole = last > 0 or held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != keys[c, 0] for c in range(3))
            if whole:
                ready = held + ([b.slice(0, last)] if last else [])
                if ready:
                    yield links(pa.Table.from_batches(ready))
                held = []
            held.append(b.slice(last))
        if held:
            yield links(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "src bigint, dst bigint")


def simhash_components(
    docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document with its ``fingerprint`` and the ``component_id`` of what it is linked to.

    Texts are compared with A-Z in lower case, by runs of ``size`` words. Two documents are linked if their
    fingerprints differ in at most ``radius`` (0 to 4) bits; a component's id is its smallest document id, and no
    link is lost. Columns: the id, ``fingerprint`` (16 hexadecimal digits), ``component_id``.

    A null text has no words, like an empty one: fingerprint zero, linked like any other. Null ids are
    in components but do not name them, unless all their ids are null. Repeated rows give a row each, other columns
    are ignored, an empty table gives no rows. Texts of any length are read whole, in blocks.
    """
    reaches(radius)
    rows = cut(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "fingerprint-nodes")
    fps = nodes.select("fp", F.lit(1).cast("bigint").alias("n"))
    # Points that more fingerprints have than one slot holds, and the cells that they crowd.
    half, even = F.array(F.lit(0), F.lit(1)), F.lit(int(_EVEN)).cast("bigint")
    x = F.shiftrightunsigned("fp", 0).bitwiseAND(F.lit(0xFFFFFFFF))
    y = F.shiftrightunsigned("fp", 32)
    point = lambda h: h.bitwiseAND(even) + F.shiftright(h, 1).bitwiseAND(even)
    crowded = (
        fps.withColumn("half", F.explode(half)).withColumn("point", F.when(F.col("half") == 0, point(x)).otherwise(point(y)))
        .groupBy("half", "point").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")).where(F.col("n") > SLOT)
    )
    full = spread(crowded, radius).groupBy("cell").agg((1 + F.floor(F.sum("n") / SLOT)).alias("slots"))
    full = cut(full, "crowded-cells")
    placed = spread(fps, radius).join(full, "cell", "left").select("cell", "fp", F.coalesce("slots", F.lit(1)).cast("int").alias("slots"))
    placed = placed.withColumn("slot", F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    placed = placed.select("cell", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"), "slot", "fp")
    links = verified(placed.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi"), radius)
    groups = components(cut(links.distinct(), "fingerprint-links"))
    groups = groups.select(F.col("identifier").alias("fp"), "component")
    linked = cut(nodes.join(groups.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "fingerprint-groups")
    firsts = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut(linked.join(firsts.hint("merge"), "component").select("fp", "component_id"), "fingerprint-names")
    return rows.join(named.hint("merge"), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
