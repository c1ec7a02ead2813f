import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import text as X
from lanternfish.operators import bm25

CASES = {"getHTTPClient": ["get", "http", "client", "gethttpclient"], "get_http_client": ["get", "http", "client", "get_http_client"], "utf8Decode": ["utf8", "decode", "utf8decode"], "plain words plain": ["plain", "words"], "__": [], "": [], "a.b(c)": ["a", "b", "c"]}


def test_query_tokens(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string")
    got = {r[0]: r[1] for r in df.select("t", X.query_tokens(F.col("t"))).collect()}
    assert got == CASES
    assert {k: X.tokenize_query(k) for k in CASES} == CASES


def test_index_tokens(spark):
    texts = ["Café au lait", "get_http_client", "a-b c2", "Ünïcode ÀÉ"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.index_tokens(F.col("t"))).collect()]
    assert got == [X.tokenize_index(t) for t in texts] == [["cafe", "au", "lait"], ["get", "http", "client"], ["a", "b", "c2"], ["unicode", "ae"]]


def test_phrases(spark):
    df = spark.createDataFrame([(["a", "a", "a", "b"],), (["x"],), ([],)], "t array<string>")
    count = lambda *p, prefix=False: [r[0] for r in df.select(X.phrase_count(F.col("t"), list(p), prefix)).collect()]
    assert count("a", "a") == [2, 0, 0]
    assert count("a", "b") == [1, 0, 0]
    assert count("a", "", prefix=True) == [3, 0, 0]
    assert count("x", prefix=True) == [0, 1, 0]


@pytest.mark.parametrize("glob,path,fits", [("*.go", "a/b.go", True), ("a/*.go", "a/b/c.go", False), ("a/?.go", "a/b.go", True), ("[a-c].md", "b.md", True), ("[^a].md", "a.md", False)])
def test_globs(spark, glob, path, fits):
    assert spark.createDataFrame([(path,)], "p string").select(X.matches_glob(F.col("p"), glob)).first()[0] is fits


ROWS = [
    (1, "s", "retry with fixed delay and retry again", "go", "function_declaration", "Store.Retry"),
    (2, "s", "open the store with getHTTPClient", "go", "function_declaration", "Store.Open"),
    (3, "t", "retrying is not a retry", "rust", "function_item", "fetch"),
    (4, "t", "nothing here", "markdown", "section", ""),
    (5, "t", "delay fixed", "python", "section", "x"),
    (6, "t", "the other text of no use", "python", "section", "y"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, "rowid long, source string, chunk_text string, language string, chunk_kind string, symbol string")


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(chunk_text, language, chunk_kind, symbol)")
    db.executemany("INSERT INTO f(rowid, chunk_text, language, chunk_kind, symbol) VALUES (?, ?, ?, ?, ?)", [(r[0], *r[2:]) for r in ROWS])
    return db


@pytest.mark.parametrize(
    "match,phrases,keep",
    [
        ('"retry" OR "delay"', [bm25.phrase("retry"), bm25.phrase("delay")], bm25.any_of(2)),
        ('"retry" AND "delay"', [bm25.phrase("retry"), bm25.phrase("delay")], bm25.all_of(2)),
        ('"retr"* OR "fix"*', [bm25.phrase("retr", prefix=True), bm25.phrase("fix", prefix=True)], bm25.any_of(2)),
        ('"fixed delay"', [bm25.phrase("fixed delay")], bm25.any_of(1)),
        ('("retry") AND language:"go"', [bm25.phrase("retry"), bm25.phrase("go", "language")], bm25.all_of(2)),
        ('symbol:"open"', [bm25.phrase("open", "symbol")], bm25.any_of(1)),
    ],
)
def test_bm25_equals_fts5(chunks, fts, match, phrases, keep):
    want = {r[0]: r[1] for r in fts.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
    got = {r["rowid"]: r["rank"] for r in bm25.score(bm25.index(chunks), phrases, keep).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_staged(chunks):
    index = bm25.index(chunks)
    got = bm25.staged(index, "retry delay", 10).collect()
    assert [(r["rowid"], r["stage"]) for r in got][0] == (1, 1)
    assert {r["rowid"]: r["stage"] for r in got} == {1: 1, 3: 2, 5: 2}
    assert [r["rowid"] for r in bm25.staged(index, "retry delay", 1).collect()] == [1]
    assert [r["rowid"] for r in bm25.staged(index, "", 5, bm25.filter_phrases(languages=["rust"])).collect()] == [3]
    assert [r["rowid"] for r in bm25.staged(index, "retry delay", 5, bm25.filter_phrases(languages=["rust"])).collect()] == [3]
    leaky = {r["rowid"] for r in bm25.staged(index, "retry nothing", 5, bm25.filter_phrases(languages=["markdown"]), compat_filter_precedence=True).collect()}
    assert leaky == {1, 3, 4}
    assert bm25.staged(index, "zzz", 5).count() == 0


def test_statistics(chunks):
    index = bm25.index(chunks)
    assert bm25.corpus_stats(index).first()["n"] == 6
    assert {r["term"]: r["df"] for r in bm25.vocabulary(index).collect()}["retry"] == 2
    p = bm25.postings(index).filter("term = 'retry' AND rowid = 1 AND col = 'chunk_text'").first()
    assert p["positions"] == [0, 5]
