"""BM25 against SQLite's own FTS5 index, and the stated query rules."""

import re
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from excerpta.functions import query as q, text as tx
from excerpta.operators import bm25
from excerpta.plans import operations, semantic
from excerpta.session import settle

ROWS = [
    (1, "Shannon entropy quantifies uncertainty in a probability distribution. entropy entropy"),
    (2, "The observation was found during review under identifier GRID-CAL-2048."),
    (3, "NEBULA appears in an astronomy note. The code was NOT assigned. A sample was FOUND under row 999."),
    (4, "配电网 谐波 监测 使用 电压 频谱 识别 非线性 负载。"),
    (5, "alpha_library_marker shared calibration"),
    (6, "a a a b a a"),
    (7, "Café naïve ÉCOLE Straße café ΣΊΣΥΦΟΣ İstanbul"),
    (8, "calibrationmarker balanced evidence sentence"),
    (9, "calibrationmarker balanced evidence sentence"),
]
QUERIES = [
    "What is Shannon entropy?",
    "entropy",
    "entropy entropy calibration",
    "GRID-CAL-2048",
    "PHANTOM-ALPHA-FOUND-777",
    "NEBULA-NOT-FOUND-999",
    "配电网 谐波 监测",
    "配电网谐波监测",
    "alpha_library_marker",
    "a_a",
    "the of",
    "calibrationmarker",
    "CAFÉ ecole",
    "istanbul σίσυφος",
    "_",
    "quasarxylophone",
]


def expression(query):
    return " OR ".join('"' + " ".join(p) + '"' for p in q.phrases(query))


def fts(rows, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize='unicode61')")
    con.executemany("insert into f(rowid, t) values (?, ?)", rows)
    if not expression(query):
        return {}
    return dict(con.execute("select rowid, bm25(f) from f where f match ?", (expression(query),)))


@pytest.mark.parametrize("query", QUERIES)
def test_scan_equals_fts5(spark, query):
    corpus = spark.createDataFrame(ROWS, "id long, t string")
    got = {r["id"]: r["score"] for r in bm25.score_scan(corpus, query, key="id", text="t").collect()}
    want = fts(ROWS, query)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_postings_equal_scan_for_a_table_of_queries(spark):
    corpus = spark.createDataFrame(ROWS, "id long, t string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    lens = bm25.lengths(corpus, key="id", text="t")
    scored = bm25.score_postings(
        bm25.postings(corpus, key="id", text="t"),
        bm25.corpus_stats(lens),
        q.query_words(queries, "query_id", "query"),
        key="id",
    )
    got = {(r["query_id"], r["id"]): r["score"] for r in scored.collect()}
    want = {(i, k): v for i, query in enumerate(QUERIES) for k, v in fts(ROWS, query).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_documents_of_the_driver_equal_fts5(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for query in ("erthly thand", "über sch nicht", "with the", "elle_la"):
        got = {r["doc_id"]: r["score"] for r in bm25.score_scan(docs, query, key="doc_id", text="text").collect()}
        want = fts(rows, query)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-10) for k in want)


def test_every_code_point_is_split_and_folded_as_by_fts5(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b" for c in codes]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize='unicode61')")
    con.execute("create virtual table v using fts5vocab(f, 'instance')")
    con.executemany("insert into f(rowid, t) values (?, ?)", zip(codes, texts))
    want = {}
    for code, term in con.execute("select doc, term from v order by doc, offset"):
        want.setdefault(code, []).append(term)
    made = spark.createDataFrame(pd.DataFrame({"code": codes, "t": texts})).repartition(8)
    got = made.select("code", F.array_join(tx.index_tokens("t"), "\0").alias("w"), tx.count_tokens(tx.fold("t")).alias("n")).toPandas()
    wrong = [(hex(c), want[c], w, n) for c, w, n in zip(got["code"], got["w"], got["n"]) if w.split("\0") != want[c] or n != len(want[c])]
    assert wrong == []


# A vowel sign that became a letter, symbols and capitals of later Unicode versions, a byte order mark, a final sigma.
SCRIPTS = ["tha \u19b3 i", "ab\U0001f9ea cd", "\u13a0\u13a1 \ua7aex", "one\ufefftwo", "ΟΔΟΣ ab", "\u13a1ΟΔΟΣ\u13a0 Ab"]


@pytest.mark.parametrize("query", ["\u13a0\u13a1", "ab", "i", "two", "οδοσ", "\ua7aeX", "\u13a1οδος\u13a0", "one-two-1"])
def test_scripts_of_later_unicode_versions_equal_fts5(spark, query):
    rows = [*enumerate(SCRIPTS), (50, "one\u20bdtwo 1"), (51, "one\u20b9two 1")]
    corpus = spark.createDataFrame(rows, "id long, t string")
    got = {r["id"]: r["score"] for r in bm25.score_scan(corpus, query, key="id", text="t").collect()}
    want = fts(rows, query)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_group_statistics_are_separate(spark):
    rows = [("x", *r) for r in ROWS] + [("y", i, t) for i, t in ROWS if i < 3]
    corpus = spark.createDataFrame(rows, "lib string, id long, t string")
    got = {
        (r["lib"], r["id"]): r["score"]
        for r in bm25.score_scan(corpus, "entropy", key="id", text="t", groups=["lib"]).collect()
    }
    assert got[("x", 1)] == pytest.approx(fts(ROWS, "entropy")[1])
    assert got[("y", 1)] == pytest.approx(fts(ROWS[:2], "entropy")[1])


def test_one_scan_feeds_statistics_and_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    top = bm25.top_k(bm25.score_scan(docs, "thand", key="doc_id", text="text"), 5, key="doc_id")
    top.collect()
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_query_expressions():
    assert q.phrases("GRID-CAL-2048") == [["grid", "cal", "2048"]]
    assert q.phrases("How does Shannon entropy relate to energy systems?") == [
        ["does"], ["shannon"], ["entropy"], ["relate"], ["energy"], ["systems"],
    ]
    assert q.phrases("the of") == [["the"], ["of"]]
    assert q.phrases("well-known fact") == [["well"], ["known"], ["fact"]]


@pytest.mark.parametrize("bad", ["", "   ", "x" * 401, "a\x00b", 5, None])
def test_refused_queries(bad):
    with pytest.raises(q.SearchInputError):
        q.checked_query(bad)


def test_column_and_string_validation_agree(spark):
    samples = ["", "  ", "x" * 401, "x" + " " * 500, "a\x00b", " ok  go ", "a\tb"]
    got = [
        r[0] for r in spark.createDataFrame([(s,) for s in samples], "s string").select(q.checked_query_column("s")).collect()
    ]

    def one(sample):
        try:
            return q.checked_query(sample)
        except q.SearchInputError:
            return None

    assert got == [one(s) for s in samples]


def test_vocabulary_equals_fts5(spark):
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x370, 0x374), *range(0x391, 0x3CA), *range(0x1E00, 0x1F00))]
    rows = [(i, f"x{c}y") for i, c in enumerate(letters)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize='unicode61')")
    con.execute("create virtual table v using fts5vocab(f, 'instance')")
    con.executemany("insert into f(rowid, t) values (?, ?)", rows)
    want = {}
    for term, doc in con.execute("select term, doc from v order by doc, offset"):
        want.setdefault(doc, []).append(term)
    frame = spark.createDataFrame(rows, "id long, t string").select("id", tx.index_tokens("t").alias("w"))
    got = {r["id"]: r["w"] for r in frame.collect()}
    assert {letters[i]: (got[i], want[i]) for i in got if got[i] != want[i]} == {}


@pytest.mark.parametrize("where", ["bm25_query_table", "eval_cases", "eval_metrics", "search_stored", "search_stored_phrase"])
def test_postings_are_counted_where_their_documents_are_dealt(spark, sf, monkeypatch, where):
    """No count, vote or sum of a document meets before a shuffle: what a task holds follows the number of tasks, not files."""
    plans, dealt = [], []
    string = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(semantic, "settle", lambda df, name: plans.append(string(df)) or settle(df, name))
    monkeypatch.setattr(bm25, "WORDS_PER_TASK", 500, raising=False)
    repartition = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *a: dealt.append(a) or repartition(self, *a))
    plans.append(string(entry.queries()[where](spark, sf)))
    assert not [p for p in plans if re.search(r"hashpartitioning\(doc_id#\d+L?, (?:length|term|query_id|item_id)#", p)]
    most = max(a[0] for a in dealt if a[1:] == ("doc_id",))
    assert most > 4 or where == "search_stored"


def test_stored_postings_are_cut_once_and_by_size(spark, sf, monkeypatch):
    """Texts are split into words once: no pass looks for ranges and none for lengths."""
    plans = {}
    string = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(operations, "settle", lambda df, name: plans.update({name: string(df)}) or settle(df, name))
    entry.queries()["search_stored"](spark, sf)
    assert list(plans) == ["postings"]
    assert "REBALANCE_PARTITIONS_BY_COL" in plans["postings"] and "rangepartitioning" not in plans["postings"]
