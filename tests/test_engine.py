import os
import time

import pytest

from lanternfish import config
from lanternfish.operators.index import Meta
from lanternfish.plans.engine import Engine
from lanternfish.sources.files import ignored, wanted
from lanternfish.streaming.watch import stream, watch


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "src"
    (root / "vendor").mkdir(parents=True)
    (root / "a.md").write_text("# Store\n\nhow to open the store and read from it\n\n# Retry\n\nretry with a fixed delay\n")
    (root / "b.py").write_text("def fetch_user(name):\n    return lookup(name, retries=3)\n")
    (root / "vendor" / "c.md").write_text("# vendored text that stays outside the index\n\nof no use at all\n")
    return root


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('[search]\nrrf_k = 0\n[index]\ninclude_patterns = ["*.md"]\n[[folders]]\npath = "/tmp"\ndescription = "d"\n[folders.context]\n"" = "root"\n')
    s = config.load(str(tmp_path / "c.toml"))
    assert s.rrf_k == 0 and s.include_patterns == ("*.md",) and s.folders[0].context == {"": "root"}
    for bad in ({"rrf_k": -1}, {"dimensions": 0}, {"similarity_threshold": 2.0}, {"quantization": "int4"}, {"unknown": 1}):
        with pytest.raises(ValueError):
            config.from_dict({"search": bad})
    assert s.for_folder(config.Folder("/x", include_patterns=(), max_file_size_kb=3)) == {"exclude": s.exclude_patterns, "include": (), "max_kb": 3}


def test_file_filters(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.md", 10), ("vendor/x.md", 10), ("sub/b.GO", 10), ("big.md", 4000), ("x.bin", 1), ("logs/y.md", 1)], "p string, n long")
    keep = lambda **k: [r[0] for r in df.filter(wanted(F.col("p"), F.col("n"), **k)).collect()]
    assert keep(exclude=("vendor",), max_kb=2, ignore="logs/\n") == ["a.md", "sub/b.GO"]
    assert keep(include=("*.bin",)) == ["x.bin"]
    assert [r[0] for r in df.filter(ignored(F.col("p"), "*.md\n!a.md\n")).collect()] == ["vendor/x.md", "big.md", "logs/y.md"]


def test_index_search_and_change(spark, folder, tmp_path):
    s = config.Settings(folders=(config.Folder(str(folder), context={"": "root", "b.py": "code"}),), similarity_threshold=0.1)
    e = Engine(spark, str(tmp_path / "ix"), s)
    assert e.index()[str(folder)] | {} == {"processed": 2, "skipped": 0, "deleted": 0, "chunks": 3, "errors": 0}
    assert e.index()[str(folder)]["skipped"] == 2
    top = e.search("retry delay", 5).results.collect()
    assert top[0]["symbol"] == "# Retry" and top[0]["context"] == ["root"]
    code = e.search("lang:python fetchUser").results.collect()
    assert [r["symbol"] for r in code] == ["fetch_user"] and code[0]["context"] == ["root", "code"]
    assert e.search("lex:store").results.count() == 1
    assert e.search("vec:open the store").results.first()["symbol"] == "# Store"
    assert e.search("").results.count() == 0
    assert e.status().first()["chunks"] == 3
    assert [r["line_num"] for r in e.get(str(folder / "a.md")).collect()] == [3, 7]
    assert e.multi_get("*.py").count() == 1
    with pytest.raises(ValueError):
        e.get("/elsewhere/x.md")

    time.sleep(0.01)
    (folder / "a.md").write_text("# Store\n\nhow to close the store after use\n")
    os.remove(folder / "b.py")
    assert e.index()[str(folder)] == {"processed": 1, "skipped": 0, "deleted": 1, "chunks": 1, "errors": 0}
    assert [r["chunk_text"] for r in e.store.table("chunks").collect()] == ["# Store\n\nhow to close the store after use"]
    assert e.store.table("vectors").count() == 1 and e.store.table("files").count() == 1
    with pytest.raises(ValueError):
        e.reindex("/none")


def test_rebuild_prune_and_failures(spark, folder, tmp_path):
    class Failing:
        dimensions = 64

        def __call__(self, texts):
            raise OSError("no network")

    root, f = str(tmp_path / "ix"), config.Folder(str(folder))
    failing = Engine(spark, root, config.Settings(folders=(f,)), Failing())
    assert failing.index()[str(folder)]["errors"] == 2
    found = failing.search("retry")
    assert found.warnings and found.results.count() == 0
    good = Engine(spark, root, config.Settings(folders=(f,)))
    assert good.index()[str(folder)]["processed"] == 2
    assert failing.search("retry").results.count() >= 1  # keywords go on without vectors
    assert good.store.needs_rebuild(str(folder), Meta("other", 64))
    wide = Engine(spark, root, config.Settings(folders=(f,), quantization="float32"))
    assert wide.index()[str(folder)]["processed"] == 2 and wide.store.table("vectors").count() == 3
    assert watch(Engine(spark, root, config.Settings()), cycles=1) == [{}]
    assert good.store.sources() == []


def test_rerank(spark, folder, tmp_path):
    s = config.Settings(folders=(config.Folder(str(folder)),), similarity_threshold=0.0)
    e = Engine(spark, str(tmp_path / "ix"), s, completer=lambda p, t, n: "[0, 10]" if "[2]" in p and "[3]" not in p else "[0, 10, 0]")
    e.index()
    plain = Engine(spark, str(tmp_path / "ix"), s).search("retry store").results.collect()
    got = e.search("retry store").results.collect()
    assert got[0]["rowid"] == plain[1]["rowid"] and got[0]["score"] > 0.3


def test_stream_once(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "ix"), config.Settings(folders=(config.Folder(str(folder)),)))
    q = stream(e, str(folder), str(tmp_path / "ckpt"), once=True)
    q.awaitTermination(120)
    assert e.store.table("chunks").count() == 3


def test_the_engine_reads_the_root_gitignore(spark, folder, tmp_path):
    (folder / ".gitignore").write_text("b.py\nlogs/\n")
    (folder / "logs").mkdir()
    (folder / "logs" / "d.md").write_text("# A log\n\nthat is of no interest to anybody\n")
    engine = Engine(spark, str(tmp_path / "index"), config.from_dict({"folders": [{"path": str(folder), "exclude_patterns": ["vendor"]}]}))
    engine.index()
    assert [os.path.basename(r["file_path"]) for r in engine.store.table("files").collect()] == ["a.md"]


def test_search_reads_written_postings(spark, folder, tmp_path):
    from lanternfish.operators import bm25

    e = Engine(spark, str(tmp_path / "ix"), config.Settings(folders=(config.Folder(str(folder)),)))
    e.index()
    stored, scanned = e.store.keywords(), bm25.index(e.store.table("chunks"))
    facts = bm25.corpus_stats(scanned).first()
    assert (stored.documents, stored.tokens) == (facts["n"], facts["n"] * facts["avgdl"])
    phrases = [bm25.phrase("the store"), bm25.phrase("ret", prefix=True), bm25.phrase("to open th", prefix=True), bm25.phrase("python", "language"), bm25.phrase("none")]
    rows = lambda found: sorted((r["rowid"], round(r["rank"], 9), tuple(r["tf"])) for r in found.collect())
    assert rows(bm25.score(stored, phrases)) == rows(bm25.score(scanned, phrases)) != []
    for text in ("store retry", "stor", "nothing"):
        assert bm25.staged(stored, text, 3).collect() == bm25.staged(scanned, text, 3).collect()


def test_a_run_that_stops_leaves_the_old_rows(spark, folder, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "ix"), config.Settings(folders=(config.Folder(str(folder)),)))
    e.index()
    before = {n: sorted(map(repr, e.store.table(n).collect())) for n in ("chunks", "vectors", "files", "postings")}
    (folder / "a.md").write_text("# Other\n\nnone of the words that stood here before\n")

    def stops(state):
        raise OSError("lost")

    monkeypatch.setattr(e.store, "_commit", stops)
    with pytest.raises(OSError):
        e.index()
    assert {n: sorted(map(repr, e.store.table(n).collect())) for n in before} == before
    failed = e.status().first()
    assert failed["state"] == "failed" and "lost" in failed["error"]
    monkeypatch.undo()
    assert e.index()[str(folder)]["processed"] == 1
    done = e.status().first()
    assert (done["state"], done["percent"], done["error"]) == ("done", 100.0, None)
    assert e.search("lex:delay").results.count() == 0 and e.search("lex:words").results.count() == 1


def test_tables_of_old_commits_go(spark, folder, tmp_path):
    store = Engine(spark, str(tmp_path / "ix"), config.Settings(folders=(config.Folder(str(folder)),))).store
    row = "SELECT 1L AS rowid, 's' AS source, 'f' AS file_path, 0 AS ordinal, 1 AS line_num, 2 AS end_line, 'a b' AS chunk_text, 's' AS folder, 'x' AS language, '' AS chunk_kind, '' AS symbol"
    for n in range(4):
        chunks = spark.sql(row)
        vectors = spark.sql("SELECT 1L AS rowid, 's' AS source, X'0102' AS embedding")
        store.replace_files(chunks, chunks, vectors, spark.sql(f"SELECT 's' AS source, 'f' AS file_path, {n}L AS mtime"))
    assert len(os.listdir(tmp_path / "ix" / "commits")) in (2, 4)  # with or without checksums of the local file system
    live = [d for d in os.listdir(tmp_path / "ix" / "data") if os.listdir(tmp_path / "ix" / "data" / d)]
    assert len(live) == 2 and store.table("files").collect() == [("s", "f", 3)] and store.keywords().tokens == 3


def test_tables_in_partitions_are_moved(spark, folder, tmp_path):
    root = str(tmp_path / "old")
    chunks = spark.sql("SELECT 1L AS rowid, 's' AS source, 'f' AS file_path, 0 AS ordinal, 1 AS line_num, 2 AS end_line, 'open store' AS chunk_text, 's' AS folder, 'go' AS language, '' AS chunk_kind, '' AS symbol")
    vectors = spark.sql("SELECT id AS rowid, 's' AS source, array(1Y, -2Y) AS embedding FROM range(1, 3)")
    for name, rows in (("chunks", chunks), ("vectors", vectors), ("files", spark.sql("SELECT 's' AS source, 'f' AS file_path, 5L AS mtime")), ("meta", spark.sql("SELECT 's' AS source, 'hash' AS model, 2 AS dimensions, 'int8' AS quantization, 8192 AS max_input_bytes"))):
        rows.write.partitionBy("source").parquet(f"{root}/{name}")
    spark.sql("SELECT 2 AS version").write.json(f"{root}/version")
    from lanternfish.operators.index import IndexStore

    store = IndexStore(spark, root)
    store.migrate()
    assert store.version() == 3 and store.meta("s") == Meta("hash", 2, "int8", 8192)
    assert [(r["rowid"], bytes(r["embedding"])) for r in store.table("vectors").collect()] == [(1, b"\x01\xfe")]  # row 2 had no chunk
    assert {r["term"] for r in store.table("postings").collect()} == {"open", "store", "go"}
