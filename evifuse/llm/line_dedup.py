"""Removal of repeated line runs by hashes of whole windows, with DataFrame functions only.

Lines are hashed. A window is a shortest run of lines that holds ``min_words`` words, counted
forwards from a line or backwards from it; its smallest line hash is its fingerprint. Every
repeated run of at least ``min_words`` words holds whole windows, so its copies share a fingerprint,
whatever surrounds them. Both windows of every line are written, not only selected minima. Those whose fingerprint
occurs elsewhere are grouped by the hash of the whole window; positions are not joined and no match is extended.
The fingerprint only leaves out windows that cannot repeat; results do not depend on it.
A line is deleted if a window that covers it has an earlier copy, which is the case for exactly
the lines of later runs of that many words. Every side of a join grows with the input, so none may
be broadcast.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.llm.common import SPACE, WORD, fresh, let, row_keys, text_of
from evifuse.session import cut

MIN_WORDS = 50


def line_windows(text: Column, min_words: int) -> Column:
    """Windows of a text: array of (first, last, fp, at, k1, k2), with 0-based line numbers.

    ``fp`` is the smallest line hash, ``at`` its line, ``k1`` and ``k2`` 128 bits of the contents. Lines without
    a word take no part. A line has at least one word, so no window is longer than ``min_words`` lines.
    """
    lines = F.transform(
        F.split(text, "\n"),
        lambda x, i: let(F.btrim(x, F.lit(SPACE)), lambda t: F.struct(
            i.alias("i"), F.xxhash64(t).alias("h"), F.xxhash64(F.lit("b"), t).alias("g"), F.regexp_count(t, F.lit(WORD)).alias("n"),
        )),
    )

    def reach(part: Column) -> Column:
        """How many of the lines are needed for ``min_words``; null if all are too few."""
        step = lambda acc, x: F.when(acc["w"] >= min_words, acc).otherwise(F.struct((acc["w"] + x["n"]).alias("w"), (acc["c"] + 1).alias("c")))
        return F.aggregate(part, F.struct(F.lit(0).alias("w"), F.lit(0).alias("c")), step, lambda acc: F.when(acc["w"] >= min_words, acc["c"]))

    def window(s: Column) -> Column:
        low = F.array_min(F.transform(s, lambda x: F.struct(x["h"].alias("h"), x["i"].alias("i"))))
        return F.struct(
            s[0]["i"].alias("first"), F.element_at(s, -1)["i"].alias("last"), low["h"].alias("fp"), low["i"].alias("at"),
            F.xxhash64(F.transform(s, lambda x: x["h"])).alias("k1"), F.xxhash64(F.lit("b"), F.transform(s, lambda x: x["g"])).alias("k2"),
        )

    def all_windows(ls: Column) -> Column:
        n = F.size(ls)
        ahead = F.transform(ls, lambda x, k: let(
            reach(F.slice(ls, k + 1, F.lit(min_words))), lambda c: F.when(c.isNotNull(), let(F.slice(ls, k + 1, c), window))
        ))
        back = F.transform(ls, lambda x, k: let(
            reach(F.reverse(F.slice(ls, F.greatest(k + 2 - min_words, F.lit(1)), F.least(k + 1, F.lit(min_words))))),
            lambda c: F.when(c.isNotNull(), let(F.slice(ls, k + 2 - c, c), window)),
        ))
        found = F.array_distinct(F.filter(F.concat(ahead, back), lambda x: x.isNotNull()))
        return F.when(n > 0, found)

    return let(F.filter(lines, lambda x: x["n"] > 0), all_windows)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(_a, _b, lines): numbers of the lines to delete, for each document (by its row keys) that loses any."""
    a, b = row_keys(F.col(id_col), F.col(text_col))
    d = docs.select(F.col(id_col).alias("_id"), a.alias("_a"), b.alias("_b"), text_of(text_col).alias("_text"))
    windows = cut(d.select("_id", "_a", "_b", F.explode(line_windows(F.col("_text"), min_words)).alias("w")).select("_id", "_a", "_b", "w.*"), "windows")
    # Fingerprints that lie at two places at least; places are told apart by a hash, so that one
    # fingerprint on a third of all lines combines map-side.
    place = F.xxhash64("_a", "_b", "at")
    shared = cut(
        windows.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("fp"), "fingerprints"
    )
    joined = windows.join(shared.hint("merge"), "fp").select("_id", "_a", "_b", "first", "last", "k1", "k2")
    order = F.struct("_id", "_a", "_b", "first")
    earliest = cut(
        joined.groupBy("k1", "k2").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo < hi").select("k1", "k2", "lo"), "runs"
    )
    later = joined.join(earliest.hint("merge"), ["k1", "k2"]).where(order > F.col("lo"))
    return (
        later.select("_a", "_b", F.explode(F.sequence("first", "last")).alias("line"))
        .groupBy("_a", "_b").agg(F.collect_set("line").alias("lines"))
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies of line runs of at least ``min_words`` words, and ``n_removed`` lines.

    Lines are split at line feeds and compared without white space around them. The copy that
    starts first, by id (null first) and line, stays; a run may repeat within its own document. Lines without a word
    neither make nor break a run, and go if they lie inside a deleted window. A null text stays null.
    Rows with equal id and text are one document: each gets the same result. Texts with the same id are
    ordered by their hash. Other columns pass through, an existing ``n_removed`` is replaced, and an
    empty table gives no rows.
    """
    gone = cut(repeated_lines(docs, id_col, text_col, min_words), "repeated")
    a, b, drop = fresh(docs, "_a", "_b", "_lines")
    gone = gone.select(F.col("_a").alias(a), F.col("_b").alias(b), F.col("lines").alias(drop))
    ka, kb = row_keys(F.col(id_col), F.col(text_col))
    d = docs.withColumn(a, ka).withColumn(b, kb).join(gone.hint("merge"), [a, b], "left")

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
        return F.array_join(F.transform(stay, lambda i: lines[i]), "\n")

    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(let(F.split(F.col(text_col), "\n"), rest))
    out = d.withColumn(text_col, text).withColumn("n_removed", F.coalesce(F.size(drop), F.lit(0)).cast("bigint"))
    keep = [c for c in docs.columns if c.lower() != "n_removed"]
    return out.select(*keep, "n_removed")


ORACLE = r"""
WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
l AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b, len(regexp_extract_all(line, '[^ \t-\r]+')) AS n FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l WHERE n > 0),
f AS (SELECT x.doc_id, x.i AS a, min(y.i) AS z FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.c - x.c + x.n >= 50 GROUP BY 1, 2),
g AS (SELECT x.doc_id, max(y.i) AS a, x.i AS z FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.k <= x.k AND x.c - y.c + y.n >= 50 GROUP BY x.doc_id, x.i),
w AS (SELECT * FROM f UNION SELECT * FROM g),
q AS (SELECT w.doc_id, a, z, string_agg(b, chr(10) ORDER BY i) AS body FROM w JOIN k ON k.doc_id = w.doc_id AND i BETWEEN a AND z GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS nth FROM q),
x AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM o WHERE nth > 1),
t AS (SELECT u.doc_id, coalesce(string_agg(line, chr(10) ORDER BY u.i) FILTER (WHERE x.i IS NULL), '') AS text, count(x.i) AS n_removed FROM u LEFT JOIN x ON u.doc_id = x.doc_id AND u.i = x.i GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN t.text END AS text, coalesce(t.n_removed, 0) AS n_removed FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""
