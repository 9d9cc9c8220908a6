"""Url rules, reputation and dialogues on hand-made rows; the queries have SQL beside them."""
import duckdb
import pytest

from evifuse.llm import chat, url_filters
from evifuse.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op2_line_dedup", "op4_url_filters", "op5_chat_perspectives"])
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(tuple(None if v is None or v != v else v for v in r) for r in df[columns].astype(object).itertuples(index=False))

    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))


def verdicts(spark, urls, bad=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    outcomes = spark.createDataFrame(list(bad) or [(None, None)], "page_id bigint, bad int")
    return {r["page_id"]: r for r in url_filters.filter_urls(pages, outcomes).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://Example.COM/en/x?y#z": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://a.www.example.com/en/1": ("a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://x.org?q=http://y.com/": ("x.org", "", None, "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "ftp://a.net/fr/": ("a.net", "/fr/", "net/fr/", "block"),
        "https://ä.É.net/es/": ("ä.É.net", "/es/", "net/es/", "block"),
        "https://com": ("com", "", None, "allow"),
        "://h/p#f": ("h", "/p", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    got = verdicts(spark, list(cases))
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for _, r in sorted(got.items())] == list(cases.values())


def test_reputation_shrinks_and_blocks(spark):
    urls = [f"https://bad.one.org/{i}" for i in range(60)] + [f"https://good.two.org/{i}" for i in range(60)] + ["https://new.one.org/", "https://rare.three.org/"]
    urls += [f"https://h.d{i % 10}.org/{i}" for i in range(300)]
    bad = [(i, 1) for i in range(55)] + [(i, 0) for i in range(60, 120)] + [(i, 0) for i in range(122, 422)] + [(121, 1), (121, 1), (None, 1), (5, None)]
    got = verdicts(spark, urls, bad)
    assert got[0]["verdict"] == "block" and got[60]["verdict"] == "allow" and got[121]["verdict"] == "allow"
    assert got[60]["bad_bound"] < got[121]["bad_bound"] < got[0]["bad_bound"]


def test_hosts_at_the_base_rate_stay(spark):
    # 40 hosts with 10 bad pages of 40 each, and one with 38 bad.
    urls = [f"https://h{i % 40}.d{i % 40}.org/{i}" for i in range(1600)] + [f"https://bad.bad.org/{i}" for i in range(40)]
    outcomes = spark.createDataFrame([(i, int(i // 40 < 10)) for i in range(1600)] + [(1600 + i, int(i < 38)) for i in range(40)], "page_id bigint, bad int")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = url_filters.filter_urls(pages, outcomes).collect()
    assert {r["host"] for r in got if r["verdict"] == "block"} == {"bad.bad.org"}
    even = url_filters.filter_urls(pages.where("page_id < 1600"), outcomes).collect()
    assert len(even) == 1600 and {r["verdict"] for r in even} == {"allow"}


def test_url_tables_that_are_empty_or_odd(spark):
    pages = spark.createDataFrame([(1, "https://a.org/"), (1, "https://a.org/"), (None, "https://a.org/")], "page_id bigint, url string").selectExpr("*", "'x' as host", "2 as bad")
    outcomes = spark.createDataFrame([(1, 1)], "page_id bigint, bad int")
    assert url_filters.filter_urls(pages, outcomes).count() == 3
    assert url_filters.filter_urls(pages.limit(0), outcomes).count() == 0
    assert {r["verdict"] for r in url_filters.filter_urls(pages, outcomes.limit(0)).collect()} == {"allow"}


TURNS = [("c", 0, "system", "be kind"), ("c", 1, "ann", "hi <|end|>"), ("c", 2, "bob", None), ("c", 2, "ann", "é😀"), ("c", 5, None, "who"), ("c", None, "bob", "first"), (None, 0, "ann", "lost"), ("s", 0, "system", "alone"), ("c", 1, "ann", "hi <|end|>")]


def test_every_participant_has_its_view(spark):
    df = spark.createDataFrame(TURNS, "conv_id string, turn int, role string, text string").selectExpr("*", "1 as speaker", "2 as part")
    for part_turns in (1000, 2):
        rows = chat.rotate_perspectives(df, part_turns=part_turns).collect()
        assert {(r["conv_id"], r["speaker"]) for r in rows} == {("c", "ann"), ("c", "bob"), (None, "ann")}
        for speaker in ("ann", "bob"):
            mine = sorted([r for r in rows if r["conv_id"] == "c" and r["speaker"] == speaker], key=lambda r: r["part"])
            own = [x for c, t, x, y in sorted(TURNS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")) if c == "c"]
            learned = [r["text"][s["start"]:s["start"] + s["length"]] for r in mine for s in r["spans"]]
            want = {"ann": ["hi < |end|><|end|>", "hi < |end|><|end|>", "é😀<|end|>"], "bob": ["first<|end|>", "<|end|>"]}[speaker]
            assert learned == want and sum(r["n_turns"] for r in mine) == len(own) == 7
            text = "".join(r["text"] for r in mine)
            assert text.count("<|start|>assistant\n") == len(want) and text.count("<|start|>system\n") == 1 and "user:unknown" in text
            assert all(r["n_chars"] == len(r["text"]) for r in mine)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_parts_are_bounded_whatever_the_turns(spark):
    turns = [("equal", 3, "ann", f"t{i:04}") for i in range(250)] + [("null", None, "ann", f"t{i:04}") for i in range(120)]
    turns += [(None, i % 5, "ann", f"t{i:04}") for i in range(230)] + [("same", 1, "ann", "again")] * 130
    turns += [("plain", i, "ann", f"t{i:04}") for i in range(90, 110)] + [("plain", None, "ann", "t")]
    rows = chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string"), part_turns=100).collect()
    sizes = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        sizes.setdefault(r["conv_id"], []).append((r["part"], r["n_turns"]))
    assert sizes == {
        "equal": [(0, 100), (1, 100), (2, 50)], "null": [(0, 100), (1, 20)], None: [(0, 100), (1, 100), (2, 30)], "same": [(0, 100), (1, 30)],
        "plain": [(0, 21)],
    }
    for conv in ("equal", "null", None):
        text = "".join(r["text"] for r in sorted(rows, key=lambda r: r["part"]) if r["conv_id"] == conv)
        want = [x for c, t, _, x in sorted(turns, key=lambda r: (r[1] or 0, r[3])) if c == conv]
        assert [x.split("<|end|>")[0] for x in text.split("<|start|>assistant\n")[1:]] == want


def test_very_long_urls_and_turns(spark):
    got = verdicts(spark, ["https://a.net/fr/" + "x/" * 500_000, "https://" + "h." * 100_000 + "org/p", "z" * 1_000_000])
    assert (got[0]["host"], len(got[0]["path"]), got[0]["rule"], got[0]["verdict"]) == ("a.net", 1_000_004, "net/fr/", "block")
    assert len(got[1]["host"]) == 200_003 and got[1]["path"] == "/p" and got[1]["verdict"] == "allow" and got[2]["host"] == ""
    long = "word " * 400_000
    rows = [("c", 1, "ann", long + "b"), ("c", 1, "ann", long + "a"), ("c", 2, "bob", "short")]
    (ann,) = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).where("speaker = 'ann'").collect()
    learned = [ann["text"][s["start"]:s["start"] + s["length"]] for s in ann["spans"]]
    assert sorted(learned) == [long + "a<|end|>", long + "b<|end|>"] and ann["n_chars"] == len(ann["text"])


def test_a_bound_at_the_limit_allows(spark):
    pages = spark.createDataFrame([(n, f"https://h{n % 4}.org/{n}") for n in range(40)], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(40)], "page_id bigint, bad int")
    bound = {r["host"]: r["bad_bound"] for r in url_filters.filter_urls(pages, outcomes).collect()}["h0.org"]
    for margin, verdict in ((bound - 0.25, "allow"), (bound - 0.25 - 1e-9, "block")):
        got = {r["host"]: r["verdict"] for r in url_filters.filter_urls(pages, outcomes, margin=margin).collect()}
        assert got["h0.org"] == verdict and got["h1.org"] == "allow"
