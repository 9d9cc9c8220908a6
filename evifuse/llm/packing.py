"""Packing of all documents into as few token sequences as possible.

The packing problem depends only on how many pieces have each length, and there are no more
lengths than a sequence has tokens. So Spark counts the lengths, the driver plans on that
bounded histogram (large-item matching, then best fit), and every piece finds its place by its
rank within its length.
"""
from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.session import cut

CAPACITY = 4096
# Entries of each generation of a worker's cache of word ids. Results don't depend on it.
CACHE_ENTRIES = 500_000
# Characters of text whose words are looked up at once.
GROUP_CHARS = 4 << 20
# Pre-tokens that are encoded as one text.
JOINED_PARTS = 2_000
# The pre-tokenizer pattern that WordIds can follow itself, and the same on words of plain letters in lower case, ASCII digits
# and ASCII signs (no special string among them).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-z\u00df-\u00f6\u00f8-\u024f"
PLAIN_WORD = re.compile(f"[!-@\\[-~{LETTERS}]+")
PLAIN_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+")
# Letters whose lower case Python and the tokenizers might not agree on.
NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
# Rows of one length that one window group may rank, on average.
RANK_ROWS = 50_000


class WordIds(dict):
    """Token ids of words as little-endian unsigned 32-bit bytes, encoded by the library in batches.

    White space ends every pre-token of these tokenizers and is dropped, so the ids of a text are those
    of its space-separated parts. A plain word is cut into its pre-tokens (a run of letters, a digit, a run of signs), which
    repeat more than words do. Letters are lower-cased by the tokenizer; where that can't depend on context or on special
    strings it is done first, so that more words are alike. Two generations keep what is in use within a fixed size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        self.tokenizer = Tokenizer.from_file(path)
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("A") == "a"
        with open(path, encoding="utf-8") as f:
            parts = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.cuts = self.lowers and parts[0].get("pattern", {}).get("Regex") == PRETOKENS
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.old[word]
        return ids

    def encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (x.ids for x in found)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of strings that are one pre-token each: many are encoded as one text, and its ids cut behind every
        token that ends a word."""
        out: list[bytes] = []
        texts = [parts[at:at + JOINED_PARTS] for at in range(0, len(parts), JOINED_PARTS)]
        found = self.tokenizer.encode_batch_fast([" ".join(x) for x in texts], add_special_tokens=False)
        for given, ids in zip(texts, (np.array(x.ids, np.uint32) for x in found), strict=True):
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(given):
                out += self.encode(given)
                continue
            raw = ids.astype("<u4").tobytes()
            out += [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]
        return out

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        old = self.old.get
        new: list[str] = []
        for w in words:
            if (ids := old(w)) is None:
                new.append(w)
            else:
                self[w] = ids
        if not self.cuts:
            self.update(zip(new, self.encode(new), strict=True))
            return
        plain = PLAIN_WORD.fullmatch
        whole = [w for w in new if not plain(w) or "<|" in w or w != w.lower()]
        self.update(zip(whole, self.encode(whole), strict=True))
        letters, mixed = [], []
        for w in new:
            if w not in self:
                (letters if w.isalpha() else mixed).append(w)
        cut = [PLAIN_PART.findall(w) for w in mixed]
        need = list({x for found in cut for x in found}.difference(self).union(letters))
        self.update(zip(need, self.encode_parts(need), strict=True))
        for w, found in zip(mixed, cut, strict=True):
            if len(found) > 1:
                self[w] = b"".join([self[x] for x in found])

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; nulls are empty."""
        words: list[list[str]] = []
        held = 0
        for t in texts:
            t = (t or "").replace("\n", " ")
            if self.lowers and "<|" not in t and not NOT_PLAIN.search(t):
                t = t.lower()
            words.append(t.split(" "))
            held += len(t)
            if held > GROUP_CHARS:
                yield from self.joined(words)
                words, held = [], 0
        yield from self.joined(words)

    def joined(self, words: list[list[str]]) -> Iterator[bytes]:
        """Ids of texts given as words: one look-up for each word, then what is new is learned together."""
        ids = [list(map(self.get, w)) for w in words]
        gaps = [n for n, found in enumerate(ids) if None in found]
        self.learn({x for n in gaps for x, i in zip(words[n], ids[n], strict=True) if i is None})
        for n in gaps:
            ids[n] = [self[x] if i is None else i for x, i in zip(words[n], ids[n], strict=True)]
        yield from map(b"".join, ids)


_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder for the tokenizer at ``path``."""
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of a document; only one above the capacity has several."""
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        yield piece, at // 4, ids[at:at + 4 * capacity]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for b in batches:
            rows: list[tuple] = []
            for n, ids in enumerate(encoder.texts(b.column(1).to_pylist())):
                ids += end
                rows += [(n, k, at, len(part) // 4, zlib.crc32(part)) for k, at, part in cut_pieces(ids, capacity)]
            if rows:
                n, *cols = zip(*rows, strict=True)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(n, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, types, strict=True)]],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    schema = T.StructType(
        [T.StructField(id_col, texts.schema[0].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )
    return texts.mapInArrow(run, schema)


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for ``counts[length]`` pieces of each length, and the number of sequences.

    Returns rows (length, first rank, end rank, pieces per sequence, first sequence, offset): the
    piece of rank r lies in sequence ``first + (r - first rank) // per`` at
    ``offset + (r - first rank) % per * length``. Pieces above a third of the capacity are
    matched largest first, each with the largest partner that fits; smaller ones go, longest
    first, to the sequence with the least room that takes them. Equal sequences are held as one
    run, so the work depends on the number of lengths only.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    given = dict.fromkeys(left, 0)
    bins = 0
    # gap -> runs; a run is [first bin, bins, entries], an entry (length, per bin, first rank, offset)
    room: dict[int, list[list]] = {}
    gaps: list[int] = []
    done: list[list] = []

    def take(s: int, n: int) -> int:
        first = given[s]
        given[s] += n
        left[s] -= n
        return first

    def put(run: list, gap: int) -> None:
        if gap == 0:
            done.append(run)
            return
        if gap not in room:
            room[gap] = []
            insort(gaps, gap)
        room[gap].append(run)

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect_left(large, capacity - a + 1) - 1
            while k >= 0 and not left[large[k]]:
                k -= 1
            b = large[k] if k >= 0 else None
            if b == a and left[a] == 1:
                k -= 1
                while k >= 0 and not left[large[k]]:
                    k -= 1
                b = large[k] if k >= 0 else None
            m = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            if b == a:
                put([bins, m, [(a, 2, take(a, 2 * m), 0)]], capacity - 2 * a)
            elif b is None:
                put([bins, m, [(a, 1, take(a, m), 0)]], capacity - a)
            else:
                put([bins, m, [(a, 1, take(a, m), 0), (b, 1, take(b, m), a)]], capacity - a - b)
            bins += m

    def split(run: list, m: int) -> tuple[list, list]:
        first, n, entries = run
        return [first, m, entries], [first + m, n - m, [(s, k, r + k * m, at) for s, k, r, at in entries]]

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            g = bisect_left(gaps, s)
            if g == len(gaps):
                k = capacity // s
                put([bins, n := -(-left[s] // k), []], capacity)
                bins += n
                continue
            gap = gaps[g]
            run = room[gap].pop()
            if not room[gap]:
                del room[gap]
                gaps.pop(g)
            k = min(gap // s, left[s])
            m = min(run[1], left[s] // k)
            filled, rest = split(run, m)
            put([filled[0], m, [*filled[2], (s, k, take(s, k * m), capacity - gap)]], gap - k * s)
            if rest[1]:
                put(rest, gap)
    for runs in room.values():
        done += runs
    rows = [(s, r, r + k * m, k, first, at) for first, m, entries in done for s, k, r, at in entries]
    return rows, bins


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A document is its tokens by the tokenizer file at ``path`` and then ``end_id``. One longer than
    ``capacity`` is cut into pieces of that length and a rest. Columns: the id, ``piece``,
    ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``. A null text is empty (one piece
    with only ``end_id``), null ids stay null, repeated rows are packed each, other columns are ignored,
    an empty table gives no rows. Within a length, pieces are ranked by id and piece.
    """
    spark = docs.sparkSession
    p = cut(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    # At most ``capacity`` rows, whatever the size of the input.
    lengths = p.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = dict(lengths.agg(F.collect_list(F.struct("length", "n"))).first()[0])
    rows, _ = plan_packing(counts, capacity)
    plan = spark.createDataFrame(
        rows, "_length bigint, _from bigint, _to bigint, _per bigint, _first bigint, _at bigint"
    )
    salts = max(1, -(-max(counts.values(), default=0) // RANK_ROWS), 16)
    order = [F.col(c) for c in (id_col, "piece", "ids_crc32")]
    p = p.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    ranked = p.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    # One row per length and salt: what the salts before hold.
    before = (
        p.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .select("length", "_salt", "_before")
    )
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_r", F.col("_before") + F.col("_rank"))
    placed = ranked.join(
        F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))
    )
    turn = F.col("_r") - F.col("_from")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("_first") + F.floor(turn / F.col("_per"))).cast("bigint").alias("sequence_id"),
        (F.col("_at") + turn % F.col("_per") * F.col("length")).cast("bigint").alias("offset"),
    )
