"""Near-duplicate classes by MinHash banding and verification on full n-gram sets.

Texts with equal shingle sets are one node. Nodes that share a band are candidates; what is
connected by candidates is verified together, every pair in numpy, so no pair is ever emitted. A large
candidate group is cut into blocks and each pair of blocks is a task of its own. Every side of a join
grows with the input, so none may be broadcast.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.llm.common import fresh, row_keys
from evifuse.llm.shingles import SHINGLE, mix, shingle_sets
from evifuse.operators.resolution import components
from evifuse.session import cut

THRESHOLD = 0.8
RECALL = 0.998
# Most hash functions a signature may need.
MAX_HASHES = 320
# Nodes and shingles of one block, on average; a candidate group above either is cut.
BLOCK_NODES = 512
BLOCK_SHINGLES = 1_000_000
COLUMNS = 2_048


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band for which a pair at ``threshold`` shares a band with probability
    ``recall`` within ``max_hashes`` hash functions."""
    best = (1, 1)
    for rows in range(1, max_hashes + 1):
        p = min(threshold**rows, 1 - 1e-12)
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    return rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def band_hashes(shingles: np.ndarray, bands: int, rows: int, fns: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One hash per band of a non-empty shingle set; different bands never compare equal but by chance."""
    a, b = fns
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2_048):
        np.minimum(low, (shingles[None, k:k + 2_048] * a[:, None] + b[:, None]).min(axis=1), out=low)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for part in low.reshape(bands, rows).T:
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + part)
    return h.view(np.int64)


def signatures(keyed: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(_id, _a, _b) of ``keyed`` with k1, k2 (the set's key), n (its size) and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fns = _functions(bands * rows)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                sets = shingle_sets(part.column("_text"), size)
                seed = np.array([mix(s * np.uint64(3) + np.uint64(len(s))).sum(dtype=np.uint64) for s in sets], np.uint64)
                other = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(11))) if len(s) else np.uint64(0) for s in sets], np.uint64)
                hashes = [band_hashes(s, bands, rows, fns) if len(s) else np.zeros(0, np.int64) for s in sets]
                lengths = np.cumsum([0, *map(len, hashes)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_a"), part.column("_b"), pa.array(seed.view(np.int64)), pa.array(other.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(hashes)))],
                    names=["_id", "_a", "_b", "k1", "k2", "n", "bands"],
                )

    fields = [keyed.schema["_id"], *[T.StructField(c, T.LongType()) for c in ("_a", "_b", "k1", "k2")]]
    return keyed.mapInArrow(run, T.StructType([*fields, T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]))


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of ``a`` and ``b`` are similar enough, as a matrix."""
    if len(a) * len(b) <= 16:
        shared = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.float64)
    else:
        every = np.concatenate([*a, *b])
        owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
        _, column, count = np.unique(every, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        several = count[column] > 1
        owner, column = owner[several], number[column[several]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(a), len(b)), np.float64)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            x = np.zeros((len(a) + len(b), COLUMNS), np.float32)
            x[owner[lo:hi], column[lo:hi] - at] = 1
            shared += x[:len(a)] @ x[len(a):].T
    total = np.array([len(x) for x in a])[:, None] + np.array([len(y) for y in b])[None, :]
    return shared >= threshold * (total - shared) - 1e-9


def roots(links: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name connected to each member of a symmetric link matrix."""
    out, left = names.copy(), np.ones(len(names), bool)
    for k in range(len(names)):
        if left[k]:
            group = np.zeros(len(names), bool)
            edge = np.array([k])
            group[k] = True
            while len(edge):
                new = links[edge].any(axis=0) & ~group
                group |= new
                edge = np.flatnonzero(new)
            out[group] = names[group].min()
            left &= ~group
    return out


def verify_group(
    keys: np.ndarray, blocks: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float, lo: int, hi: int
) -> tuple[np.ndarray, np.ndarray]:
    """(root, links) of each member of blocks ``lo`` and ``hi``: if they are one block its members are compared with
    each other, else across only, and an empty block gives no links. Links count the copies of a linked member."""
    n = len(keys)
    links = np.zeros((n, n), bool)
    first, second = np.flatnonzero(blocks == lo), np.flatnonzero(blocks == hi)
    if lo == hi:
        links = linked(sets, sets, threshold)
        np.fill_diagonal(links, False)
    elif len(first) and len(second):
        m = linked([sets[i] for i in first], [sets[i] for i in second], threshold)
        links[np.ix_(first, second)] = m
        links[np.ix_(second, first)] = m.T
    return roots(links, keys), links @ copies


def verified(groups: DataFrame, size: int, threshold: float) -> DataFrame:
    """(k1, k2, root, links) per member of each group; ``groups`` is partitioned and sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def settle() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            _, pick = np.unique(t["k2"].to_numpy() ^ (t["k1"].to_numpy() << 1), return_index=True)  # one row per node
            t = t.take(pa.array(np.sort(pick)))
            k1 = t["k1"].to_numpy()
            root, links = verify_group(k1, t["block"].to_numpy(), t["copies"].to_numpy(), shingle_sets(t["_text"].combine_chunks(), size), threshold, *key[1:])
            return pa.RecordBatch.from_arrays([pa.array(k1), t["k2"].combine_chunks(), pa.array(root), pa.array(links.astype(np.int64))], names=["k1", "k2", "root", "links"])

        for b in batches:
            if not b.num_rows:
                continue
            g = np.stack([b.column(c).to_numpy() for c in ("component", "lo", "hi")])
            edges = [0, *(np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0)) + 1), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(g[:, lo])
                if key is not None and now != key:
                    yield settle()
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield settle()

    return groups.mapInArrow(run, "k1 bigint, k2 bigint, root bigint, links bigint")


def near_duplicate_nodes(
    docs: DataFrame, threshold: float, size: int, recall: float, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows (_id, _a, _b, k1, k2, n) of ``docs``; nodes (k1, k2, first, n_links) with
    the first row (_id, _a, _b) of the node's class."""
    bands, rows = choose_bands(threshold, recall)
    a, b = row_keys(F.col(id_col), F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("_id"), a.alias("_a"), b.alias("_b"), F.col(text_col).cast("string").alias("_text"))
    sigs = cut(signatures(keyed, size, bands, rows), "signatures")
    plain = sigs.drop("bands")
    bandrows = sigs.where("n > 0").select("k1", F.explode("bands").alias("h"))
    # Buckets with two nodes at least, as a star around the smallest; minima combine map-side.
    buckets = cut(bandrows.groupBy("h").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("h", "lo"), "buckets")
    stars = bandrows.join(buckets.hint("merge"), "h").where("k1 <> lo").select(F.col("k1").alias("src"), F.col("lo").alias("dst")).distinct()
    groups = components(stars)
    nodes = cut(
        plain.where("n > 0").groupBy("k1", "k2")
        .agg(F.min(F.struct("_id", "_a", "_b")).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").cast("bigint").alias("n")),
        "nodes",
    )
    members = cut(nodes.join(groups.withColumnRenamed("identifier", "k1").hint("merge"), "k1"), "members")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    blocks = cut(members.groupBy("component").agg(need.alias("blocks")), "blocks")
    members = members.join(blocks.hint("merge"), "component").select(
        "component", "blocks", F.pmod(F.xxhash64("k1", "k2"), "blocks").alias("block"), "k1", "k2", "copies",
        F.col("first._a").alias("_a"), F.col("first._b").alias("_b"),
    )
    members = cut(members, "members")
    texts = keyed.drop("_id").join(members.hint("merge"), ["_a", "_b"]).dropDuplicates(["_a", "_b"])
    every = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    every = every.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "blocks", "k1", "k2", "copies", "_text")
    found = cut(
        verified(every.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi"), size, threshold), "verified"
    )
    # A group of one block is settled; what several blocks found is joined by their common members.
    whole = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("root").alias("top"))
    whole = cut(whole, "links")
    joined = components(found.where("k1 <> root").select(F.col("k1").alias("src"), F.col("root").alias("dst")))
    joined = cut(joined.select(F.col("identifier").alias("k1"), F.col("component").alias("root")), "classes")
    classed = cut(nodes.join(whole.select("k1", "k2", "links").hint("merge"), ["k1", "k2"], "left").join(joined.hint("merge"), "k1", "left").select(
        "k1", "k2", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "root"
    ), "classed")
    firsts = cut(classed.where("root is not null").groupBy("root").agg(F.min("first").alias("class_first")), "firsts")
    out = classed.join(firsts.hint("merge"), "root", "left").select("k1", "k2", F.coalesce("class_first", "first").alias("first"), "n_links")
    return plain, cut(out, "near-nodes")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: the id, ``class_id``, ``n_links``.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is ``threshold``
    or more; a text of fewer words is one shingle. ``class_id`` is the smallest id of those connected by links,
    ``n_links`` the number of documents linked directly, copies included. A pair at the threshold is a
    candidate with probability ``recall`` at least, more similar ones with nearly 1; links are exact.

    Null and empty texts have no links and are classes of their own. Repeated rows are copies of each
    other, null ids are the smallest, other columns are ignored, an empty table gives no rows.
    """
    rows, nodes = near_duplicate_nodes(docs, threshold, size, recall, id_col, text_col)
    return rows.join(nodes.hint("merge"), ["k1", "k2"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("first").isNull(), F.col("_id")).otherwise(F.col("first._id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def drop_near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each class of ``near_duplicates``: the one with the smallest id.

    Null and empty texts stay. Of repeated rows (equal id and text) one stays.
    """
    rows, nodes = near_duplicate_nodes(docs, threshold, size, recall, id_col, text_col)
    first = nodes.select(F.col("first._a").alias("_a"), F.col("first._b").alias("_b")).distinct()
    a, b = fresh(docs, "_a", "_b")
    keep = cut(first.unionByName(rows.where("n = 0").select("_a", "_b").distinct()), "kept").select(F.col("_a").alias(a), F.col("_b").alias(b))
    ka, kb = row_keys(F.col(id_col), F.col(text_col))
    return docs.withColumn(a, ka).withColumn(b, kb).join(keep.hint("merge"), [a, b]).dropDuplicates([a, b]).select(*docs.columns)
