"""Benchmark decontamination: SimHash windows, Hamming search by blocks, exact verification.

Every benchmark item is represented by windows of about its own length and by short tiles along it,
every document by all its windows of the same lengths. Windows are compared by the SimHash of
their shingles. A fingerprint is split into one block more than the radius, so two within the radius
agree on a block at least, and looking blocks up finds all of them. What is found is verified on the
weighted shingles of the whole item. A passage as similar as asked has a tile without an edit, and that
tile's fingerprint is equal, so the tiles keep edited passages from being missed.

Tasks read documents in blocks of words; only the benchmark, in slices of bounded size, is sent to them.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.llm.common import fresh
from evifuse.llm.shingles import SHINGLE, shingle_hashes, word_hashes

THRESHOLD = 0.8
RADIUS = 3
# Window lengths in words; an item takes the longest that is no longer than itself.
SIZES = (5, 8, 12, 18, 27, 40, 60, 90, 128)
TILE = 12
# Items and bytes of benchmark text of one pass over the documents.
PASS_ITEMS = 5_000
PASS_BYTES = 64 << 20
BLOCK_WORDS = 1 << 16
ROWS = 500

_LANES = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)
_HIGH = np.uint64(0x8080808080808080)
_ONES = 0x0101010101010101
_GATHER = np.uint64(0x0102040810204080)
_POP = np.array([bin(v).count("1") for v in range(1 << 16)], np.uint8)


def shingle_run(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, as ``shingle_hashes`` gives them for a text of at least ``k``."""
    return shingle_hashes(words, k) if len(words) >= k else np.zeros(0, np.uint64)


def lane_sums(shingles: np.ndarray) -> list[np.ndarray]:
    """Running sums of each bit of the hashes, eight to a number: the difference of two entries
    holds the counts between them exactly, as long as they stay below 256."""
    out = []
    for k in range(8):
        s = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(_LANES[(shingles >> np.uint64(8 * k)) & np.uint64(255)], out=s[1:])
        out.append(s)
    return out


def simhashes(sums: list[np.ndarray], m: int) -> np.ndarray:
    """SimHash of every run of ``m`` shingles: a bit is set if more than half of them have it."""
    fp = np.zeros(max(0, len(sums[0]) - m), np.uint64)
    lift = np.uint64((127 - m // 2) * _ONES)
    for k, s in enumerate(sums):
        bits = ((s[m:] - s[:-m] + lift) & _HIGH) >> np.uint64(7)
        fp |= ((bits * _GATHER) >> np.uint64(56)) << np.uint64(8 * k)
    return fp


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(_POP[(x >> np.uint64(16 * j)) & np.uint64(0xFFFF)].astype(np.int64) for j in range(4))


@dataclass
class Anchors:
    """Item windows of one length: fingerprints, items and places in them, and their block index."""

    fp: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    radius: int

    def __post_init__(self):
        edges = [64 * j // (self.radius + 1) for j in range(self.radius + 2)]
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            shift, mask = np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)
            value = (self.fp >> shift) & mask
            order = np.argsort(value, kind="stable")
            seen = np.zeros(1 << min(16, hi - lo), bool)
            seen[value & np.uint64(len(seen) - 1)] = True
            self.blocks.append((shift, mask, seen, value[order], order))

    def near(self, fp: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, anchor) pairs within the radius."""
        windows, anchors = [], []
        for shift, mask, seen, values, order in self.blocks:
            part = (fp >> shift) & mask
            w = np.flatnonzero(seen[part & np.uint64(len(seen) - 1)] & valid)
            if len(w):
                lo, hi = np.searchsorted(values, part[w]), np.searchsorted(values, part[w], "right")
                n = hi - lo
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                windows.append(np.repeat(w, n))
                anchors.append(order[np.repeat(lo, n) + step])
        if not windows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, a = np.concatenate(windows), np.concatenate(anchors)
        ok = hamming(fp[w], self.fp[a]) <= self.radius
        return w[ok], a[ok]


@dataclass
class Index:
    """Anchors by (shingle words, window words), and each item's length and weighted shingles."""

    anchors: dict[tuple[int, int], Anchors]
    lengths: list[int]
    shingles: list[tuple[np.ndarray, np.ndarray]]


def anchor_places(n: int) -> list[tuple[int, int]]:
    """(window words, offset) of an item of ``n`` words: its length class at both ends and its tiles."""
    if n < SHINGLE:
        return [(n, 0)] if n else []
    whole = max(s for s in SIZES if s <= n)
    tile = max(s for s in SIZES if s <= min(TILE, max(SHINGLE, n // 3)))
    step = tile - SHINGLE + 1
    places = {(whole, 0), (whole, n - whole), (tile, n - tile)} | {(tile, at) for at in range(0, n - tile + 1, step)}
    return sorted(places)


def build_index(texts: pa.Array, radius: int = RADIUS) -> Index:
    words, at = word_hashes(pc.utf8_lower(texts))
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    lengths, shingles = [], []
    for item, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
        w, n = words[lo:hi], int(hi - lo)
        k = min(SHINGLE, max(n, 1))
        h = shingle_run(w, k)
        sums = lane_sums(h)
        for size, offset in anchor_places(n):
            fp = simhashes([s[offset:offset + size - k + 2] for s in sums], size - k + 1)[0]
            found.setdefault((k, size), []).append((int(fp), item, offset))
        lengths.append(n)
        shingles.append(np.unique(h, return_counts=True))
    anchors = {}
    for key, rows in found.items():
        fp, item, offset = zip(*rows, strict=True)
        anchors[key] = Anchors(np.array(fp, np.uint64), np.array(item), np.array(offset), radius)
    return Index(anchors, lengths, shingles)


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the shingle counts of an item and of shingles ``h``."""
    keys, counts = np.unique(h, return_counts=True)
    at = np.searchsorted(a[0], keys)
    at[at == len(a[0])] = 0
    both = np.minimum(counts, a[1][at])[a[0][at] == keys].sum() if len(keys) and len(a[0]) else 0
    total = counts.sum() + a[1].sum() - both
    return float(both / total) if total else 0.0


def best_passage(words: np.ndarray, starts: np.ndarray, item: int, index: Index, threshold: float, any_will_do: bool = False) -> tuple[int, float] | None:
    """(start, similarity) of the most similar passage of the item's length, if it is similar enough; the first if equal.

    A similar passage has an equal tile, so its start is one of ``starts`` or off by no more than the edits before the tile.
    All of these are compared, but for a passage that is equal already, and if ``any_will_do``, one of ``starts`` that is similar enough.
    """
    n, weights = index.lengths[item], index.shingles[item]
    k, slack = min(SHINGLE, n), n // 9 + 1
    last = max(0, len(words) - n)

    def score(places: set[int], best: tuple[int, float] | None) -> tuple[int, float] | None:
        for s in sorted(places):
            x = weighted_similarity(weights, shingle_run(words[s:s + n], k))
            if x >= threshold - 1e-9 and (best is None or (x, -s) > (best[1], -best[0])):
                best = (s, x)
                if x == 1:
                    break
        return best

    places = {min(max(int(s), 0), last) for s in starts}
    best = score(places, None)
    if best and (best[1] == 1 or any_will_do):
        return best
    return score({min(max(s + d, 0), last) for s in places for d in range(-slack, slack + 1)} - places, best)


def find_matches(texts: pa.Array, index: Index, threshold: float, any_will_do: bool = False) -> list[tuple[int, int, int, int, float]]:
    """(row, item, start, words, similarity) of the best passage (or any) of every item that a row holds."""
    words, at = word_hashes(pc.utf8_lower(texts))
    if not len(words) or not index.anchors:
        return []
    ends = np.repeat(at[1:], np.diff(at))
    longest = max(size for _, size in index.anchors)
    hits: dict[tuple[int, int], set[int]] = {}
    for lo in range(0, len(words), BLOCK_WORDS):
        part = words[lo:lo + BLOCK_WORDS + longest - 1]
        end = ends[lo:lo + len(part)] - lo
        for k in {k for k, _ in index.anchors}:
            sums = lane_sums(shingle_run(part, k))
            for (k_, size), anchors in index.anchors.items():
                if k_ != k:
                    continue
                fp = simhashes(sums, size - k + 1)[:BLOCK_WORDS]
                w, a = anchors.near(fp, np.arange(len(fp)) + size <= end[:len(fp)])
                if len(w):
                    row = np.searchsorted(at, w + lo, "right") - 1
                    for r, i, s in zip(row.tolist(), anchors.item[a].tolist(), (w + lo - at[row] - anchors.offset[a]).tolist(), strict=True):
                        hits.setdefault((r, i), set()).add(s)
    out = []
    for (r, i), starts in sorted(hits.items()):
        if best := best_passage(words[at[r]:at[r + 1]], np.array(sorted(starts)), i, index, threshold, any_will_do):
            out.append((r, i, best[0], min(index.lengths[i], int(at[r + 1] - at[r])), best[1]))
    return out


def benchmark_slices(items: DataFrame, id_col: str, text_col: str) -> Iterator[pa.Table]:
    """The benchmark in slices of at most about PASS_ITEMS items and PASS_BYTES of text."""
    it = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n, size = it.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // PASS_ITEMS), -(-size // PASS_BYTES))
    slices = F.pmod(F.xxhash64("item", "text"), F.lit(passes))
    for p in range(passes):
        yield it.where(slices == p).toArrow()


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item it holds: the id, the item's id, ``start``, ``n_words``, ``similarity``.

    A document holds an item if a passage of as many words (or the document, if it is shorter) has a weighted
    similarity of ``threshold`` or more: sum of minima over sum of maxima of the counts of five-word shingles; shorter items
    are one shingle. Words are compared in lower case. The most similar passage is given, the first if equal.

    Null and empty texts hold nothing and null or wordless items are never held; null ids stay null,
    repeated rows give rows each, other columns are ignored, an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    item_type = items.schema[item_id].dataType
    name = item_id if item_id != id_col else f"benchmark_{item_id}"
    schema = T.StructType([
        T.StructField(id_col, d.schema[0].dataType), T.StructField(name, item_type), T.StructField("start", T.LongType()),
        T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType()),
    ])
    out = None
    for table in benchmark_slices(items, item_id, item_text):
        sent = spark.sparkContext.broadcast((build_index(table["text"].combine_chunks(), radius), table["item"].combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, ids = sent.value
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    if rows := find_matches(part.column(1), index, threshold):
                        r, i, *rest = (list(x) for x in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), ids.take(pa.array(i)), *map(pa.array, rest)], names=schema.names)

        found = d.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS,
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` without the documents that ``contaminated`` finds; columns and all other rows stay as they are."""
    spark = docs.sparkSession
    columns = docs.columns
    (name,) = fresh(docs, "_match_text")
    for table in benchmark_slices(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(build_index(table["text"].combine_chunks(), radius))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, *_ in find_matches(part.column(name), sent.value, threshold, any_will_do=True)]] = False
                    yield part.filter(pa.array(keep)).select(columns)

        docs = docs.withColumn(name, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
    return docs
