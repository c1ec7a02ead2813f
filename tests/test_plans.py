import pytest
from pyspark.sql import functions as F

from lanternfish.operators import documents as D
from lanternfish.operators import fusion
from lanternfish.operators.embedding import HashEmbedder, batches_by_budget, fit_dimensions, fnv1a
from lanternfish.operators.evalmetrics import recall_mrr
from lanternfish.plans import query as Q
from lanternfish.plans.scores import parse_scores


@pytest.mark.parametrize(
    "raw,want",
    [
        ("hello", [("hello", "hybrid", ())]),
        ("lex:exact | vec:near thing", [("exact", "fts", ()), ("near thing", "vec", ())]),
        ("lang:Go language:go open", [("open", "hybrid", ("go",))]),
        ('language:"go"', [("", "hybrid", ("go",))]),
        ("Lex:a|b", [("Lex:a|b", "hybrid", ())]),
        ("other:x y", [("other:x y", "hybrid", ())]),
        ("lex: | ", [("|", "fts", ())]),
        ("lex: | vec:", [("lex: | vec:", "hybrid", ())]),
        ("  ", []),
    ],
)
def test_parse_query(raw, want):
    assert [(q.text, q.mode, q.filters.languages) for q in Q.parse_query(raw)] == want


def test_plan_and_expansion():
    reply = lambda p, t, n: "one\nopen\n two \nthree\nfour"
    tasks = Q.plan("open | lex:x | lang:go", reply, True)
    assert [(t.text, t.query_source, t.wants_vec, t.wants_fts) for t in tasks] == [("open", "original", True, True), ("one", "expanded", True, True), ("two", "expanded", True, True), ("three", "expanded", True, True), ("x", "original", False, True), ("", "original", False, True)]

    def broken(*a):
        raise OSError("down")

    assert [t.text for t in Q.plan("open", broken, True)] == ["open"]
    assert [Q.effective_top_k(k) for k in (0, -1, 5, 5000)] == [20, 20, 5, 1000]


@pytest.mark.parametrize(
    "reply,n,want",
    [
        ("[8,3,7]", 3, [8, 3, 7]),
        ('```json\n{"scores": [1, 2]}\n```', 2, [1, 2]),
        ("Here: [9, 12, -1] done", 3, [9, 10, 0]),
        ("1: 8\n2: 3", 2, [8, 3]),
        ("[1] 8, [2] 3", 2, None),
        ("8, 3, 7", 3, [8, 3, 7]),
        ("doc1: 4, doc2: 5", 2, [4, 5]),
        ("1 8 2 3", 2, [8, 3]),
        ("scores are 8 and 3", 2, [8, 3]),
        ("1 2", 2, None),
        ("", 2, None),
        ("7", 2, None),
        (str(list(range(9))), 10, list(range(9))),
        ("3 docs: 4, 5", 2, [4, 5]),
    ],
)
def test_parse_scores(reply, n, want):
    got = parse_scores(reply, n)
    if reply == "[1] 8, [2] 3":
        assert got is None or len(got) == 2
    else:
        assert got == want


def test_rrf_golden(spark):
    rows = [("vec", "original", r, i) for r, i in enumerate("XYZ", 1)] + [("fts", "original", r, i) for r, i in enumerate("YZW", 1)]
    ids = {c: k for k, c in enumerate("XYZW", 1)}
    sets = spark.createDataFrame([(m, s, r, ids[i]) for m, s, r, i in rows], "modality string, query_source string, rank int, rowid long")
    got = {r["rowid"]: r["rrf"] for r in fusion.rrf(sets, 0).collect()}
    assert sorted(got, key=lambda k: -got[k]) == [ids[c] for c in "YZXW"]
    assert got[ids["Y"]] == pytest.approx(1 / 62 + 1 / 61)
    weighted = {r["rowid"]: r["rrf"] for r in fusion.rrf(sets, 60, {"fts": 2.0, "vec": -1.0}).collect()}
    assert weighted[ids["W"]] == pytest.approx(2 / 63) and weighted[ids["X"]] == pytest.approx(1 / 61)


def test_rerank_blend(spark):
    results = spark.createDataFrame([(1, 0.03), (2, 0.02), (3, 0.01)], "rowid long, score double")
    scores = spark.createDataFrame([(1, 0.0), (2, 10.0)], "rowid long, rerank double")
    got = [(r["rowid"], round(r["score"], 6)) for r in fusion.rerank_blend(results, scores, [F.desc("score")]).collect()]
    assert got == [(2, 0.51), (1, 0.024), (3, 0.01)]
    assert fusion.blend_weights(0.2, 0.9) == (0.9, 0.2) and fusion.blend_weights(float("nan"), -1) == (0.8, 0)
    assert [r["rowid"] for r in fusion.min_score(results, 0.02).collect()] == [1, 2]


def test_budgets():
    assert batches_by_budget(["aa", "bb", "cccc", "d"], 2, 4) == [[0, 1], [2], [3]]
    assert batches_by_budget(["aa", "bb"], 0, 0) == [[0, 1]]
    assert fnv1a(b"a") == 0xE40C292C
    assert fit_dimensions([3.0, 4.0, 9.0], 2) == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        fit_dimensions([1.0], 2)
    a, b = HashEmbedder(16)(["open the store", ""])
    assert sum(x * x for x in a) == pytest.approx(1) and b[0] == 1.0


def test_recall_mrr(spark):
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 9)], "query_id long, rank int, rowid long")
    relevant = spark.createDataFrame([(1, 6), (1, 7), (2, 8), (3, 1)], "query_id long, rowid long")
    r = recall_mrr(hits, relevant).first()
    assert (round(r["recall"], 6), round(r["mrr"], 6)) == (round(0.5 / 3, 6), round(0.5 / 3, 6))


def test_documents(spark):
    rows = [(1, "/r", "/r/a.md", 1, 3, "x" * 20, ""), (2, "/r", "/r/a.md", 5, 9, "y" * 20, "S"), (3, "/r", "/r/b/c.go", 1, 0, "z" * 20, "")]
    chunks = spark.createDataFrame(rows, "rowid long, source string, file_path string, line_num int, end_line int, chunk_text string, symbol string")
    assert [r["rowid"] for r in D.get(chunks, "/r/a.md", 3, 4).collect()] == [1]
    assert [r["rowid"] for r in D.get(chunks, "/r/a.md").collect()] == [1, 2]
    assert [r["rowid"] for r in D.multi_get(chunks, ["*.go", "/r/a.md"]).collect()] == [3, 1, 2]
    # header 9 + 9, chunk len("/r/b/c.go:1") + 20 + 3
    assert [r["rowid"] for r in D.multi_get(chunks, ["*.go", "/r/a.md"], 52).collect()] == [3]
    assert D.multi_get(chunks, ["*.go"], 51).count() == 0
    ctx = chunks.select(D.resolve_context(F.col("file_path"), F.lit("/r"), {"": "root", "b": "bees", "b/c": "no"})).collect()
    assert [r[0] for r in ctx] == [["root"], ["root"], ["root", "bees"]]
    assert [r[0] for r in chunks.select(D.resolve_source(F.col("file_path"), ["/q", "/r/b", "/r"])).collect()] == ["/r", "/r", "/r/b"]
