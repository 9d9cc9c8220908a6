"""Fill-in-the-middle: containers against plain lists, exact round trip, and a plain rendering of the rule."""
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from evifuse.llm import fill_middle as m
from evifuse.llm.queries import QUERIES


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the words of the contract."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
    if not text or any(s in text for s in m.SENTINELS):
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_containers_select_every_member():
    rng = np.random.default_rng(3)
    kinds = set()
    for density in (0.0005, 0.05, 0.5, 0.999):
        members = np.flatnonzero(rng.random(m.CONTAINER) < density)
        for sub in (members, np.arange(700, 9000), np.concatenate([np.arange(50), np.arange(60_000, 65_536)])):
            c = m.container(sub)
            kinds.add(type(c).__name__)
            for k in {0, len(sub) - 1, *rng.integers(0, len(sub), 200).tolist()}:
                assert c.select(k) == sub[k]
    assert kinds == {"ArrayContainer", "BitmapContainer", "RunContainer"}


def test_line_ends_of_long_texts():
    rng = random.Random(5)
    for text in ("a" * 200_000, "\n" * 200_000, "\n".join("x" * rng.randrange(3) for _ in range(90_000)), "\n".join("y" * rng.randrange(4000) for _ in range(90)) + "\n"):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        ends = m.LineEnds(text.encode())
        assert len(ends) == len(units)
        edges = np.cumsum([0] + [len(u) for u in units])
        for k in {0, 1, len(units), *(rng.randrange(len(units) + 1) for _ in range(100))}:
            assert ends.end_of(k) == edges[k]


def test_odd_rows_and_round_trip(spark):
    rows = [
        (1, None), (2, ""), (3, "one line"), (4, "a\nb\nc\n"), (5, "\n\n\n"), (6, "has <S> inside\nx"), (7, "ends with <P"), (8, "é\nß😀\n\nz\r\n"),
        (9, "line of text\n" * 30_000 + "<"), (4, "a\nb\nc\n"), (None, "null id\nhere"), (10, "<\nS>\n<M\n>"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, form string, n int")
    out = m.fill_middle(df).withColumn("back", m.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is not None, r[0], r[1] or "")
    got = sorted([(r["doc_id"], r["back"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out], key=key)
    assert got == sorted([(d, t or "", *plain(d, t)) for d, t in rows], key=key)
    assert m.fill_middle(df.limit(0)).count() == 0


def test_rates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    forms = {r["form"]: r["count"] for r in m.fill_middle(docs, rate=40, spm_rate=100).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 0.25 < forms["spm"] / docs.count() < 0.55


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in QUERIES["op11_fill_in_middle"](spark, sf).collect():
        n, form, p, k, out = plain(r["doc_id"], docs.pop(r["doc_id"]))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, p, k, sha(out))
    assert not docs
