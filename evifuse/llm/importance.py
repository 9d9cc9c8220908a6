"""Importance resampling towards a target: hashed-feature gains summed over bit planes, Gumbel draws, exact ranks.

A document's bucket counts are cut into planes: plane j has a bit for each bucket, the j-th bit of its count. The gains
of all buckets are cut alike, in two's complement, whose last plane counts negative. The sum of
count times gain over all buckets is then the sum over pairs of planes of 2^(j+k) times the number of bits both have set.
All of it is whole numbers, so weights are exact in any order.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.llm.bytewords import gram_blocks, lowered
from evifuse.session import cut

BUCKETS = 10_000
# Bytes that end a word: ASCII other than letters and digits.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
# Documents and features whose counts a task holds at once.
GROUP_DOCS, GROUP_FEATURES = 256, 400_000
CACHE_ENTRIES = 500_000
# Drawn rows that one window group ranks, on average, and ranges at least.
RANGE_ROWS, LEAST_RANGES = 200_000, 32


class Buckets(dict):
    """Bucket of a feature; a bounded cache of the worker."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def feature_blocks(data: bytes, table: bytes, max_n: int, look: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """(words of a feature, buckets) of all features of a text, block by block."""
    for size in range(1, max_n + 1):
        for grams in gram_blocks(data, table, size):
            yield size, np.fromiter(map(look.__getitem__, grams), np.int64, len(grams))


def gathered(df: DataFrame, *cols: str) -> list:
    """The rows of a small aggregate, as one cell; callers state the bound."""
    return df.agg(F.collect_list(F.struct(*cols))).first()[0]


def bucket_counts(texts: DataFrame, buckets: int, max_n: int) -> np.ndarray:
    """How many features of all rows fall into each bucket: one row per task and bucket is shuffled."""
    table = lowered(SEPARATORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, seen = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for data in b.column(0):
                for _, ids in feature_blocks(data.as_py() or b"", table, max_n, look):
                    seen += np.bincount(ids, minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    found = texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in gathered(found, "bucket", "n"):
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of the ratio of the smoothed shares of target and corpus."""
    b, all_c, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return [
        math.floor(1000 * math.log(float((t + 1) * (all_c + b)) / float((s + 1) * (all_t + b))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ]


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64)


def gain_planes(gains: list[int]) -> tuple[np.ndarray, list[int]]:
    """Planes of signed whole numbers in two's complement, and the value of a bit of each."""
    width = max(max(g, ~g).bit_length() for g in gains)
    g = np.array(gains, np.int64)
    bits = np.stack([(g >> k) & 1 for k in range(width + 1)]).astype(bool)
    return packed(bits), [*(1 << k for k in range(width)), -(1 << width)]


def plane_sums(keys: np.ndarray, counts: np.ndarray, docs: int, buckets: int, planes: np.ndarray, values: list[int]) -> np.ndarray:
    """Sum of count times gain for each document; a key is document * buckets + bucket, each once."""
    total = np.zeros(docs, np.int64)
    doc, bucket = np.divmod(keys, buckets)
    for j in range(int(counts.max()).bit_length() if len(counts) else 0):
        has = (counts >> j) & 1 == 1
        rows, at = np.unique(doc[has], return_inverse=True)
        bits = np.zeros((len(rows), buckets), bool)
        bits[at, bucket[has]] = True
        plane = packed(bits)
        for gain, value in zip(planes, values, strict=True):
            total[rows] += (value << j) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
    return total


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(keys), np.concatenate(counts)
    unique, at = np.unique(every, return_inverse=True)
    return unique, np.bincount(at, weights=n, minlength=len(unique)).astype(np.int64)


def gumbel(seed: int, doc_id: str | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: list[int], max_n: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document."""
    texts = docs.select(
        F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_name"), F.col(text_col).cast("string").cast("binary").alias("_text")
    )
    table, buckets = lowered(SEPARATORS), len(gains)
    planes, values = gain_planes(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Buckets(buckets)

        def group(ids: pa.Array, names: list[str | None], texts: list[bytes]) -> pa.RecordBatch:
            words, features = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for k, data in enumerate(texts):
                for size, found in feature_blocks(data, table, max_n, look):
                    keys.append(found + k * buckets)
                    counts.append(np.ones(len(found), np.int64))
                    features[k] += len(found)
                    words[k] += len(found) if size == 1 else 0
                    held += len(found)
                    if held > GROUP_FEATURES:
                        keys, counts = [[x] for x in merged(keys, counts)]
                        held = 0
            total = plane_sums(*merged(keys, counts), len(texts), buckets, planes, values)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            score = weight + np.array([gumbel(seed, x) for x in names], np.int64)
            return pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (words, features, weight, score))], names=[id_col, "n_words", "n_features", "weight", "score"]
            )

        for b in batches:
            for at in range(0, b.num_rows, GROUP_DOCS):
                part = b.slice(at, GROUP_DOCS)
                yield group(part.column(0), part.column(1).to_pylist(), [x.as_py() or b"" for x in part.column(2)])

    schema = T.StructType(
        [T.StructField(id_col, texts.schema["_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")]
    )
    return texts.mapInArrow(run, schema)


def top_ranks(rows: DataFrame, n: int, id_col: str, eligible: str) -> DataFrame:
    """``rows`` with ``rank``: 1 to ``n`` by score, ties to smaller ids, for those that are ``eligible``; else null.

    A histogram of the scores (whole numbers in a fixed span, so of bounded size) gives the lowest score drawn; only
    rows at or above it are sorted, in ranges that are ranked one by one.
    """
    histogram = rows.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    counts = sorted(gathered(histogram, "score", "n"), reverse=True)
    least, drawn = None, 0
    for score, k in counts:
        if drawn >= n:
            break
        least, drawn = score, drawn + k
    no_rank = F.lit(None).cast("bigint").alias("rank")
    if least is None:
        return rows.select("*", no_rank)
    in_draw = F.expr(eligible) & (F.col("score") >= least)
    ranges = max(LEAST_RANGES, -(-drawn // RANGE_ROWS))
    order = [F.desc("score"), F.asc(id_col)]
    dealt = cut(rows.where(in_draw).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "draw")
    sizes = dict(gathered(dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")), "_range", "n"))
    before, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _before bigint"))
    rank = (F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")).cast("bigint")
    ranked = dealt.join(start, "_range").withColumn("rank", rank)
    return ranked.select(*rows.columns, F.when(F.col("rank") <= n, F.col("rank")).alias("rank")).unionByName(
        rows.where(~in_draw).select("*", no_rank)
    )


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 1, buckets: int = BUCKETS, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Every document with its importance weight and its place in a draw of ``percent`` of all eligible ones.

    Columns: the id, ``n_features``, ``weight`` (floored mean gain of its features; none: 0), ``score`` (weight
    and Gumbel noise from the id, so that the highest scores are a draw without replacement), ``rank`` (1 is the
    highest score; null: not drawn). Documents of fewer than ``min_words`` words are not drawn.

    A null text has no words, a null id draws as an empty one and goes first in ties, repeated rows are documents each,
    other columns are ignored. An empty target gives gains by the corpus alone, an empty table no rows. Texts of any
    length are counted whole, in blocks.
    """
    binary = F.col(text_col).cast("string").cast("binary")
    corpus = bucket_counts(docs.select(binary), buckets, max_n)
    wanted = bucket_counts(target.select(F.col(target_col).cast("string").cast("binary")), buckets, max_n)
    rows = cut(scored(docs, bucket_gains(corpus, wanted), max_n, seed, id_col, text_col), "scored")
    eligible = f"n_words >= {min_words}"
    n = rows.where(eligible).count() * percent // 100
    return top_ranks(rows, n, id_col, eligible).select(id_col, "n_features", "weight", "score", "rank")


# crc32 has no SQL function: it is computed byte by byte, with bit steps, for every different word.
ORACLE = r"""
with recursive crc_table as (
  select b, list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from (select unnest(range(256))::bigint as b)
), crc as (select list(v order by b) as t from crc_table
), lowered as (
  select 'd' as kind, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
  union all
  select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
), words as (
  select kind, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from lowered
), counted as (select kind, id, w, count(*) as k from words group by all
), hashed as (
  select w, xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) % 10000 as bucket
  from (select distinct w, hex(encode(w)) as h from counted), crc
), sums as (
  select b.bucket, coalesce(sum(k) filter (kind = 'd'), 0) as s, coalesce(sum(k) filter (kind = 'b'), 0) as t
  from (select unnest(range(10000)) as bucket) b left join (counted join hashed using (w)) c on b.bucket = c.bucket group by 1
), gains as (
  select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + 10000))::double / ((s + 1) * (sum(t) over () + 10000))::double))::bigint as gain from sums
), weights as (
  select id, sum(k)::bigint as n, floor(sum(k * gain)::double / sum(k)::double)::bigint as weight
  from counted join hashed using (w) join gains using (bucket) where kind = 'd' group by id
), scores as (
  select d.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents d left join weights w on d.doc_id = w.id
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scores where n_features >= 20
)
select s.doc_id, s.n_features, s.weight, s.score, case when r <= (10 * n) // 100 then r end as rank
from scores s left join ranked using (doc_id)
"""
