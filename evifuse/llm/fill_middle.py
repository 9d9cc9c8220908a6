"""Fill-in-the-middle: cut a text at two line ends and move its middle to the end.

The line ends of a text are a set of byte positions in the manner of Roaring bitmaps: one container for every
65,536 positions, held as a sorted array, a bitmap or runs, whichever is smallest, and the cumulative cardinalities of
the containers. The end of the k-th line is a search among the cumulative cardinalities and a select inside one
container.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINELS = ("<P>", "<S>", "<M>")
CONTAINER = 1 << 16
BITMAP_BYTES = CONTAINER // 8
OUT_BYTES = 8 << 20


class ArrayContainer:
    """Sorted members."""

    def __init__(self, members: np.ndarray):
        self.members = members.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.members[k])


class BitmapContainer:
    """One bit for each position, with the number of members before every word."""

    def __init__(self, members: np.ndarray):
        bits = np.zeros(CONTAINER, bool)
        bits[members] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.words[w:w + 1].view(np.uint8), bitorder="little")
        return 64 * w + int(np.flatnonzero(bits)[k - self.before[w]])


class RunContainer:
    """First member of every run, with the number of members before it."""

    def __init__(self, members: np.ndarray):
        first = run_starts(members)
        self.starts = members[first].astype(np.uint16)
        self.before = first

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[r]) + k - int(self.before[r])


def run_starts(members: np.ndarray) -> np.ndarray:
    """Indexes of the members that do not follow their predecessor directly."""
    return np.concatenate([[0], np.flatnonzero(np.diff(members) != 1) + 1])


def container(members: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form: two bytes a member, 8,192 bytes, or four bytes a run."""
    sizes = (2 * len(members), BITMAP_BYTES, 4 * len(run_starts(members)))
    return (ArrayContainer, BitmapContainer, RunContainer)[sizes.index(min(sizes))](members)


class LineEnds:
    """The last byte of every unit of a text; a unit is a line with its line break, or the rest after the last one."""

    def __init__(self, data: bytes):
        whole = np.frombuffer(data, np.uint8)
        self.bases: list[int] = []
        self.containers: list = []
        self.before = [0]
        for base in range(0, len(whole), CONTAINER):
            piece = whole[base:base + CONTAINER]
            members = np.flatnonzero(piece == 10)
            if base + len(piece) == len(whole) and piece[-1] != 10:
                members = np.append(members, len(piece) - 1)
            if len(members):
                self.bases.append(base)
                self.containers.append(container(members))
                self.before.append(self.before[-1] + len(members))

    def __len__(self) -> int:
        return self.before[-1]

    def end_of(self, units: int) -> int:
        """Bytes of the first ``units`` units."""
        if units == 0:
            return 0
        c = int(np.searchsorted(self.before, units - 1, side="right")) - 1
        return self.bases[c] + self.containers[c].select(units - 1 - self.before[c]) + 1


def code_points(data: bytes) -> int:
    if data.isascii():
        return len(data)
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def draws(seed: int, doc_id: str | None) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return tuple(int(digest[at:at + 8], 16) for at in range(0, 32, 8))


def fill_middle(
    docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Each document with its middle moved to the end: the id, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``n`` counts the units. Two draws from the id choose the unit ends where prefix and middle end, a third (in
    percent, ``rate``) whether the text is rearranged at all and a fourth (``spm_rate``) between the forms psm
    (prefix, suffix, middle) and spm (suffix, prefix, middle). An empty text, and one that holds a
    sentinel, is plain: ``output`` is the text and the two lengths are null.

    A null text is empty, a null id draws as an empty one, repeated rows give equal rows, other columns are
    ignored, an empty table gives no rows. A text of any length is cut whole; one line without a break is one unit.
    """
    texts = docs.select(
        F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_name"), F.col(text_col).cast("string").cast("binary").alias("_text")
    )
    marks = tuple(s.encode() for s in sentinels)

    def rearranged(name: str | None, data: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        ends = LineEnds(data)
        n = len(ends)
        h1, h2, h3, h4 = draws(seed, name)
        if not data or any(m in data for m in marks) or h3 % 100 >= rate:
            return n, "plain", None, None, data
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = ends.end_of(low), ends.end_of(high)
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        p, s, m = marks
        spm = h4 % 100 < spm_rate
        out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
        return n, "spm" if spm else "psm", code_points(prefix), code_points(middle), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

        def batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            *cols, out = zip(*rows)
            whole = pa.array(out, pa.binary()).view(pa.string())
            return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)], whole], names=names)

        for b in batches:
            rows, held, first = [], 0, 0
            for k in range(b.num_rows):
                rows.append(rearranged(b.column(1)[k].as_py(), b.column(2)[k].as_py() or b""))
                held += len(rows[-1][-1])
                if held > OUT_BYTES:
                    yield batch(b.column(0).slice(first, len(rows)), rows)
                    rows, held, first = [], 0, k + 1
            if rows:
                yield batch(b.column(0).slice(first, len(rows)), rows)

    schema = T.StructType(
        [T.StructField(id_col, texts.schema["_id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")] + [T.StructField("output", T.StringType())]
    )
    return texts.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_middle`` rearranged, from its output and form alone.

    A rearranged text holds no sentinel, so its output has exactly the three that were put in.
    """
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


ORACLE = """
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as h from documents
), u as (
  select *, string_split(text, chr(10)) as parts,
    case when text = '' then 0 else len(string_split(text, chr(10))) - (case when ends_with(text, chr(10)) then 1 else 0 end) end as n,
    ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 25, 8))::bigint as h4
  from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from u
), p as (
  select *,
    case when a = 0 then '' when a = n then text else array_to_string(parts[1:a], chr(10)) || chr(10) end as head,
    case when b = 0 then '' when b = n then text else array_to_string(parts[1:b], chr(10)) || chr(10) end as head2
  from c
), q as (
  select *, length(head) as pc, length(head2) - length(head) as mc,
    substring(text, length(head) + 1, length(head2) - length(head)) as middle, substring(text, length(head2) + 1) as tail
  from p
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then pc::bigint end as prefix_chars, case when form <> 'plain' then mc::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || middle
    else '<S>' || tail || '<P>' || head || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from q
"""
