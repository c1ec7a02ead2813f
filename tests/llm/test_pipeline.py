"""The pipeline's stages, each held against a slow version on the input that it had, and the registered SQL."""

import os

import duckdb
import pytest
from helpers import SF, brute_components, brute_removed, documents, prose, split
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lanternfish.llm import mixing, near_dedup, quality_rules, registry
from lanternfish.llm.sentencepiece_codec import MODEL
from lanternfish.llm.token_counts import tokenizer_path

tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage over the whole small table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


@tables
def test_stages_keep_the_columns(steps):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(s.columns == steps[0].columns for s in steps[:-1])


@tables
def test_quality_stage(steps):
    kept = {r["doc_id"] for r in quality_rules.score(steps[0]).filter("kept").collect()}
    assert {r["doc_id"] for r in steps[1].select("doc_id").collect()} == kept
    assert 0 < len(kept) < steps[0].count()


@tables
def test_near_duplicate_stage(steps):
    groups = brute_components([(r["doc_id"], r["text"]) for r in steps[1].collect()])
    assert {r["doc_id"] for r in steps[2].collect()} == {c for _, c in groups.values()}


@tables
def test_near_duplicate_stage_at_80_percent(steps):
    groups = brute_components([(r["doc_id"], r["text"]) for r in steps[1].collect()], percent=80)
    assert {r["doc_id"] for r in steps[2].collect()} == {c for _, c in groups.values()}


def test_near_duplicate_stage_links_from_80_percent(spark):
    """Pairs between 0.80 and 0.85 lose a document in the stage, though not in op3's query."""
    rows = []
    for k in range(6):
        ws = prose(300 + k, 250, 50_000).split(" ")
        rows += [(10 * k, " ".join(ws)), (10 * k + 1, " ".join("changed" if i in (25, 75, 125, 175, 225) else w for i, w in enumerate(ws)))]
        rows.append((10 * k + 2, " ".join("other" if i in range(20, 240, 25) else w for i, w in enumerate(ws))))
    want = {c for _, c in brute_components(rows, percent=80).values()}
    assert want < {c for _, c in brute_components(rows).values()}
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


@pytest.mark.parametrize("percent", [80, 85])
def test_bands_find_pairs_at_the_threshold(percent):
    bands, n = near_dedup.banding(percent)
    assert (1 - (percent / 100) ** n) ** bands <= 3e-7
    keys = near_dedup.band_keys(near_dedup.signature(near_dedup.shingles(prose(1, 50))), percent)
    assert len(keys) == len(set(keys)) == bands


@tables
def test_substring_stage(steps):
    want = brute_removed([(r["doc_id"], r["text"]) for r in steps[2].collect()])
    rows = steps[3].collect()
    assert {r["doc_id"]: split(r["text"]) for r in rows} == {i: kept for i, (_, kept) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


@tables
def test_mixture_stage(steps):
    size = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    targets = {r["source"]: r["target"] for r in mixing.source_targets(steps[3].select("source", size.alias("size"))).collect()}
    longest = steps[3].agg(F.max(size).alias("n")).first()["n"]
    for r in steps[4].groupBy("source").agg(F.sum(size).alias("n")).collect():
        assert abs(r["n"] - targets[r["source"]]) <= longest
    assert steps[4].join(steps[3], "doc_id", "left_anti").count() == 0
    assert steps[4].groupBy("doc_id").count().filter("count > 2").count() == 0


@tables
def test_encoding_stage(steps):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert r["token_ids"] == model.encode(texts[r["doc_id"]]) and r["decoded"] == model.decode(r["token_ids"])


@tables
def test_run_equals_the_stages(spark, steps):
    a, b = (d.groupBy("doc_id", "n_tokens").count().collect() for d in (corpus_pipeline.run(spark, SF), steps[5]))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_planted_cases(spark, tmp_path):
    """Copies, near copies and repeated passages go; clean documents stay as they are."""
    text, passage = prose(1, 200, 50_000), prose(2, 55, 50_000)
    ws = text.split(" ")
    clean = {i: prose(100 + i, 150, 50_000) for i in range(30, 40)}
    rows = [(1, text), (2, text), (3, " ".join([*ws[:50], "other", *ws[51:]])), (4, f"{prose(5, 80, 50_000)} {passage} {prose(6, 50, 50_000)}"), (5, f"{prose(7, 60, 50_000)} {passage} {prose(8, 90, 50_000)}"), (6, "too short"), *clean.items()]
    documents(spark, [(i, t, "s") for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == {1, 4, 5, *clean}
    assert passage in got[4] and got[5] == rows[4][1].replace(passage + " ", "")
    assert all(got[i] == t for i, t in clean.items())


@tables
@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF), db.sql(registry.ORACLES[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    at = [want.columns.index(c) for c in order]
    assert sorted(repr([plain(r[c]) for c in order]) for r in got.collect()) == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())


@tables
@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_query_covers_its_table(spark, name):
    got = registry.QUERIES[name](spark, SF)
    key = got.columns[0]
    whole = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert got.count() == whole.count() == got.select(key).distinct().count()


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in registry.QUERIES}
    assert "pipeline" in entry.queries() and set(registry.QUERIES) < set(entry.queries())
