"""Token counts by a two-tier table of pre-token lengths; no pre-token is shuffled.

A text is cut where the model can never merge: before a space that follows something else,
and on both sides of a line break. Its token count is the sum over these pre-tokens. Tasks
look their lengths up in a broadcast table of frequent pre-tokens first, made from a bounded sample of rows, and encode the rest
through a cache of the worker, so no pre-token leaves its task.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python workers hold one cache per model; past this many entries it starts anew from the
# frequent table. Results don't depend on it.
CACHE_ENTRIES = 300_000


class PieceLengths(dict):
    """Token count of a pre-token by one sentencepiece model."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.frequent = frequent

    def __missing__(self, key: str) -> int:
        # A line break in front keeps the model's own leading space apart: two tokens more.
        raw = key if key[0] in " \n" else " " + key
        n = len(self.model.encode("\n" + raw)) - 2
        if len(self) >= CACHE_ENTRIES + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        self[key] = n
        return n


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text: ``w`` stands for a space and a word, a leading line break or
    spaces stand for themselves."""
    if not text:
        return []
    parts = text.replace("▁", " ").replace("\n", " \n").split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for p in parts:
        if not p:
            spaces += 1
        elif not spaces or p[0] == "\n":
            if spaces:
                out.append(" " * spaces)
            out.append(p)
            spaces = 0
        else:
            out.append(" " * (spaces + 1) + p)
            spaces = 0
    if spaces:
        out.append(" " * spaces)
    return out


_lengths: dict[str, PieceLengths] = {}


def _worker_lengths(path: str, frequent: dict[str, int]) -> PieceLengths:
    if path not in _lengths:
        _lengths[path] = PieceLengths(path, frequent)
    return _lengths[path]


def frequent_lengths(texts: DataFrame, path: str, entries: int, sample_rows: int) -> dict[str, int]:
    """Lengths of the ``entries`` most frequent pre-tokens of about ``sample_rows`` rows.

    The rows are drawn by a hash of their place, from all partitions alike. Tasks count the pre-tokens of the rows drawn and send
    ``entries`` each at most, so what reaches the driver is bounded by the sample. Only the speed depends on this table.
    """
    every = max(1, texts.count() // sample_rows)
    drawn = texts.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(pretokens(t.as_py() or ""))
        top = seen.most_common(entries)
        if top:
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in top], "n": [n for _, n in top]}, schema=pa.schema([("key", pa.string()), ("n", pa.int64())]))

    found: Counter[str] = Counter()
    for b in drawn.mapInArrow(count, "key string, n bigint").toArrow().to_batches():
        for key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found[key] += n
    lengths = PieceLengths(path, {})
    return {key: lengths[key] for key, _ in found.most_common(entries)}


def token_counts(
    docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    entries: int = 20_000, sample_rows: int = 2_000,
) -> DataFrame:
    """Bytes and tokens of every text by the sentencepiece model at ``path``.

    Columns: the id, ``n_bytes``, ``n_tokens``, ``over_limit``. A null text is empty (no bytes,
    no tokens), a null id stays null, repeated rows give a row each, other columns are ignored,
    an empty table gives no rows. A text of any length is counted whole.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sent = spark.sparkContext.broadcast(frequent_lengths(texts.select("_text"), path, entries, sample_rows))
    id_type = texts.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _worker_lengths(path, sent.value)
        look = lengths.__getitem__
        for b in batches:
            text = b.column(1)
            n = [sum(map(look, pretokens(t.as_py() or ""))) for t in text]
            tokens = pa.array(n, pa.int64())
            size = pc.fill_null(pc.binary_length(text).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), size, tokens, pc.greater(tokens, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return texts.mapInArrow(run, schema)
