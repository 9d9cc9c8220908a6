"""Repeated line runs against a search of every earlier run."""
import random

from evifuse.llm import line_dedup as m
from evifuse.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def n_words(line):
    for c in SPACE[1:]:
        line = line.replace(c, " ")
    return len([w for w in line.split(" ") if w])


def wordless(run, min_words):
    """Line numbers inside the shortest pieces of a run that have ``min_words`` words."""
    out = set()
    for part in (run, run[::-1]):
        for k in range(len(part)):
            n = 0
            for j in range(k, len(part)):
                n += part[j][2]
                if n >= min_words:
                    out |= set(range(min(part[k][0], part[j][0]), max(part[k][0], part[j][0]) + 1))
                    break
    return out


def brute(docs, min_words=50):
    """{id: text}: a line goes if a run of ``min_words`` words around it starts earlier elsewhere."""
    out, seen = {}, []
    for d, t in sorted(docs):
        ls = [(i, x.strip(SPACE), n_words(x)) for i, x in enumerate(t.split("\n")) if n_words(x)]
        seen.append((d, [x for _, x, _ in ls]))
        gone = set()
        for d2, other in seen:
            same = {}
            for a in range(len(ls)):
                for b in range(len(other)):
                    if ls[a][1] == other[b] and (d2 != d or b < a):
                        same[a, b] = 1
            for a, b in sorted(same):
                if (a - 1, b - 1) not in same:
                    n = 0
                    while (a + n, b + n) in same:
                        n += 1
                    run = ls[a:a + n]
                    if sum(w for _, _, w in run) >= min_words:
                        gone |= {i for i, _, _ in run} | wordless(run, min_words)
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def run(spark, rows, **kw):
    return {r["doc_id"]: r["text"] for r in m.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), **kw).collect()}


def test_query_matches_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["doc_id"]: r["text"] for r in QUERIES["op2_line_dedup"](spark, sf).collect()} == brute(docs)


def test_random_runs(spark):
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.choice([1, 4, 9, 30]))) for _ in range(14)] + ["", "  "]
    for words in (1, 12, 40):
        rows = [(n, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for n in range(60)]
        assert run(spark, rows, min_words=words) == brute(rows, words)


def test_surroundings_do_not_hide_a_passage(spark):
    passage = "\n".join(f"line {i} of ten words a b c d e f" for i in range(6))
    rows = [(n, f"head {n}\n" * (n % 3) + passage + f"\ntail {n}") for n in range(20)]
    got = run(spark, rows)
    assert got[0].startswith("line 0") and all("line" not in got[n] for n in range(1, 20))


def test_odd_rows(spark):
    long = "\n".join(f"l{i} " + "w " * 60 for i in range(3000))
    df = spark.createDataFrame(
        [(None, "a " * 60, "x"), (1, "a " * 60, "y"), (1, "a " * 60, "z"), (2, None, None), (3, "", "n"), (4, long, "p"), (5, long, "q"), (6, "\n \n", "r")],
        "doc_id bigint, text string, _lines string",
    )
    got = sorted([(r["doc_id"], r["_lines"], r["text"], r["n_removed"]) for r in m.dedup_lines(df).collect()], key=str)
    want = [(None, "x", "a " * 60, 0), (1, "y", "", 1), (1, "z", "", 1), (2, None, None, 0), (3, "n", "", 0), (4, "p", long, 0), (5, "q", "", 3000), (6, "r", "\n \n", 0)]
    assert got == sorted(want, key=str)
    assert m.dedup_lines(df.limit(0)).count() == 0
