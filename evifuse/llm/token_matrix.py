"""Packed token-id matrices: best-fit decreasing with a segment tree over free capacities.

Every task packs the documents it reads in blocks of bounded size, so nothing is shuffled and a lost
task is done again alone. A row of the result is a row of the matrix with its segment bounds and the
positions that start anew in every segment.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 4096
END_ID = 50_256
# Tokens that a task holds and packs at a time.
BLOCK_TOKENS = 4 << 20
# Sequences of one output batch.
ROWS = 256


class CapacityTree:
    """Open bins by free capacity: a tree of counts finds the least capacity that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        k = free + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, bin) of a bin with the least free capacity of at least ``need``, no longer open."""
        k = need + self.leaves
        while not self.count[k]:
            while k & 1:  # a right child: nothing to the right below this parent
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        free = k - self.leaves
        while k:
            self.count[k] -= 1
            k >>= 1
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items are taken longest first, equal ones in order."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            bins.append([i])
            free, b = capacity, len(bins) - 1
        else:
            free, b = found
            bins[b].append(i)
        if free > lengths[i]:
            tree.add(free - lengths[i], b)
    return bins


_encoders: dict[tuple[str, str], object] = {}


def byte_encoder(path: str, pattern: str):
    """The worker's byte-level encoder for the rank file at ``path``."""
    import tiktoken

    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def pack_matrix(
    docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per packed sequence of ``capacity`` token ids.

    Columns: ``sequence_id`` (unique), ``n_tokens``, ``n_segments``, ``ids`` and ``positions`` (little-endian unsigned
    32-bit, ``capacity`` of each, padded with ``pad_id`` and 0), ``cu_seqlens`` (0 and the end of every segment) and, per
    segment, ``doc_ids``, ``pieces`` and ``starts`` (its first token's place in the document). A document is its byte-level
    tokens and then ``end_id``; one longer than ``capacity`` is cut into full pieces and a rest, so that its pieces
    laid end to end are the document.

    A null text is empty (only ``end_id``), null ids stay null, repeated rows are packed each, other columns are
    ignored, an empty table gives no rows.
    """
    d = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    id_type = d.schema[0].dataType
    schema = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_segments", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("positions", T.BinaryType()), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path, pattern)
        first = TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # (id, piece, start, ids)
        tokens = 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal first
            bins = best_fit_decreasing([len(x[3]) for x in held], capacity)
            for at in range(0, len(bins), ROWS):
                rows: list[tuple] = []
                for b in bins[at:at + ROWS]:
                    parts = [held[i] for i in b]
                    sizes = [len(x[3]) for x in parts]
                    n = sum(sizes)
                    ids, positions = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4")
                    ids[:n] = np.concatenate([x[3] for x in parts])
                    positions[:n] = np.concatenate([np.arange(s) for s in sizes])
                    rows.append((first, n, len(b), ids.tobytes(), positions.tobytes(), [0, *np.cumsum(sizes).tolist()], [x[0] for x in parts], [x[1] for x in parts], [x[2] for x in parts]))
                    first += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

        for b in batches:
            id_type = b.schema.field(0).type
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int64())]
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.append(encoder.encode_to_numpy(text.as_py() or "", disallowed_special=()), np.uint32(end_id))
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    held.append((doc.as_py(), piece, at, ids[at:at + capacity]))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield from settle()
                    held, tokens = [], 0
        if held:
            yield from settle()

    return d.mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows of ``pack_matrix``; a file's ``ids`` laid end to end are its id matrix."""
    packed.write.mode("errorifexists").parquet(path)
