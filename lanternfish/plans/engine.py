"""The engine: index folders, search them, read them back."""

from __future__ import annotations

import concurrent.futures
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.config import Folder, Settings
from lanternfish.functions import vectors as V
from lanternfish.operators import bm25, documents, fusion, knn
from lanternfish.operators import index as I
from lanternfish.operators.chunking import chunk_table
from lanternfish.operators.embedding import HashEmbedder, embed, fit_dimensions
from lanternfish.plans import query as Q
from lanternfish.plans.scores import parse_scores
from lanternfish.sources import files

RERANK = "Rate from 0 to 10 how well each document answers the query. Reply with a JSON list of numbers in order.\nQuery: {query}\nDocuments:\n{docs}"
RESULT = ("file_path", "line_num", "end_line", "chunk_text", "score", "folder", "language", "chunk_kind", "symbol", "context", "rowid")


@dataclass
class Found:
    """Results of a search, and what went wrong without stopping it."""

    results: DataFrame
    warnings: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings, embedder: Q.Embedder | None = None, completer: Q.Completer | None = None):
        self.spark, self.settings, self.completer = spark, settings, completer
        self.embedder = embedder or HashEmbedder(settings.dimensions)
        self.store = I.IndexStore(spark, root)
        self.store.migrate()
        self.store.drop_other_vectors(self._meta())

    # ------------------------------------------------------------ index

    def _meta(self) -> I.Meta:
        s = self.settings
        return I.Meta(s.model, s.dimensions, s.quantization, s.max_input_bytes)

    def _quantized(self, rows: DataFrame) -> DataFrame:
        v = F.col("embedding")
        return rows.withColumn("embedding", V.pack(V.quantize_int8(v) if self.settings.quantization == "int8" else v))

    def reindex(self, folder: str, force: bool = False) -> dict:
        """Index one configured folder: changed files anew, deleted ones out; counts of both and of failures."""
        found = next((f for f in self.settings.folders if f.path == folder), None)
        if found is None:
            raise ValueError(f"{folder} is not configured")
        meta = self._meta()
        if force or self.store.needs_rebuild(folder, meta):
            self.store.clear_source(folder)
        self.store.set_meta(folder, meta)  # first, so that a run that stops is resumed and not begun anew
        try:
            out = self._index(found)
        except Exception as e:
            self.store.set_progress(folder, "failed", 0, 0, f"{type(e).__name__}: {e}"[:500])
            raise
        total = out["processed"] + out["skipped"]
        self.store.set_progress(folder, "done", total, total - out["errors"], f"{out['errors']} files failed" if out["errors"] else None)
        return out

    def _index(self, folder: Folder) -> dict:
        scanned = files.scan(self.spark, folder.path, **self.settings.for_folder(folder), ignore=files.root_ignore(self.spark, folder.path))
        tracked = self.store.table("files").filter(F.col("source") == folder.path)
        status = self.store._snapshot(I.diff(tracked, scanned.select("source", "file_path", "mtime")))
        tally = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        work = status.filter("status <> 'unchanged'")
        todo = scanned.join(status.filter("status IN ('new', 'changed')").select("source", "file_path"), ["source", "file_path"], "left_semi")
        out = {"processed": tally.get("new", 0) + tally.get("changed", 0), "skipped": tally.get("unchanged", 0), "deleted": tally.get("deleted", 0), "chunks": 0, "errors": 0}
        if out["processed"] + out["deleted"] == 0:
            return out
        s = self.settings
        self.store.set_progress(folder.path, "indexing", out["processed"] + out["skipped"], out["skipped"])
        made = self.store._snapshot(embed(chunk_table(todo, s.max_input_bytes), self.embedder, max_count=s.batch_size, max_bytes=s.batch_max_bytes))
        failed = made.filter("error IS NOT NULL OR embed_error IS NOT NULL").select("source", "file_path").distinct()
        good = made.join(failed, ["source", "file_path"], "left_anti").withColumn("rowid", I.rowid()).withColumn("folder", F.col("source"))
        names = [f.split()[0] for f in I.CHUNKS.split(", ")]
        mtimes = todo.select("source", "file_path", "mtime").join(failed, ["source", "file_path"], "left_anti")
        self.store.replace_files(work, good.select(*names), self._quantized(good.select("rowid", "source", "embedding")), mtimes)
        return out | {"chunks": good.count(), "errors": failed.count()}

    def index(self) -> dict[str, dict]:
        """Index every configured folder and drop those that are configured no longer."""
        configured = {f.path for f in self.settings.folders}
        for source in self.store.sources():
            if source not in configured:
                self.store.clear_source(source)
        return {f.path: self.reindex(f.path) for f in self.settings.folders}

    # ------------------------------------------------------------ search

    def _embedded(self, texts: list[str], warnings: list[str]) -> list[list[float]] | None:
        pool = concurrent.futures.ThreadPoolExecutor(1)
        try:
            return [fit_dimensions(v, self.settings.dimensions) for v in pool.submit(self.embedder, texts).result(self.settings.embedding_timeout)]
        except Exception as e:
            warnings.append(f"vector search is off: {type(e).__name__}: {e}")
            return None
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def search(self, query: str, top_k: int = 0, folders: Sequence[str] | None = None) -> Found:
        """The best chunks for a query, best first, of all folders or those named."""
        s, warnings = self.settings, []
        k = Q.effective_top_k(top_k, s.default_top_k)
        tasks = Q.plan(query, self.completer, s.query_expansion)
        chunks = self.store.table("chunks")
        if not tasks:
            return Found(self._finished(chunks.limit(0).withColumn("score", F.lit(0.0)), k), warnings)
        asked = list(dict.fromkeys(t.text for t in tasks if t.wants_vec))
        vectors = self._embedded(asked, warnings) if asked else None
        by_text = dict(zip(asked, vectors, strict=True)) if vectors else {}
        if asked and not by_text and not any(t.wants_fts for t in tasks):
            raise RuntimeError("; ".join(warnings))
        indexed = self.store.keywords()
        sets = []
        for n, t in enumerate(tasks):
            f = t.filters
            if t.wants_fts:
                hits = bm25.staged(indexed, t.text, k, bm25.filter_phrases(f.languages, f.kinds, f.symbols), folders or ())
                sets.append(fusion.ranked(hits, ["stage", "rank", "rowid"], 2 * n, "fts", t.query_source))
            if t.wants_vec and t.text in by_text:
                hits = knn.search_vectors(self.store.table("vectors"), chunks, by_text[t.text], k, s.similarity_threshold, folders or (), f.languages, f.kinds, f.symbols)
                sets.append(fusion.ranked(hits.select("rowid", "score"), [F.desc("score"), "rowid"], 2 * n + 1, "vec", t.query_source))
        fused = fusion.rrf(fusion.union_all(sets), s.rrf_k, {"vec": s.vec_weight, "fts": s.fts_weight}, {"original": s.original_query_weight, "expanded": s.expanded_query_weight})
        hits = fused.withColumnRenamed("rrf", "score").join(chunks, "rowid").orderBy(*fusion.final_order())
        if s.rerank and self.completer is not None:
            hits = self._reranked(query, hits, warnings)
        return Found(self._finished(fusion.min_score(hits, s.min_score), k), warnings)

    def _reranked(self, query: str, hits: DataFrame, warnings: list[str]) -> DataFrame:
        """hits blended with the model's scores of the first rerank_top_n, which are all that is collected."""
        s = self.settings
        top = hits.limit(s.rerank_top_n).select("rowid", "file_path", "line_num", F.when(F.length("chunk_text") > 500, F.concat(F.left("chunk_text", F.lit(500)), F.lit("..."))).otherwise(F.col("chunk_text")).alias("t")).collect()
        if not top:
            return hits
        docs = "\n".join(f"[{i}] {r['file_path']}:{r['line_num']} {r['t']}" for i, r in enumerate(top, 1))
        try:
            scores = parse_scores(self.completer(RERANK.format(query=query, docs=docs), 0.0, 100), len(top))
        except Exception as e:
            warnings.append(f"reranking failed: {e}")
            return hits
        if scores is None:
            warnings.append("the reranker's reply holds too few scores")
            return hits
        given = self.spark.createDataFrame([(r["rowid"], x) for r, x in zip(top, scores, strict=False)], "rowid long, rerank double")
        return fusion.rerank_blend(hits, given, fusion.final_order(), s.rerank_top_n, s.rerank_top_weight, s.rerank_bottom_weight)

    def _finished(self, hits: DataFrame, k: int) -> DataFrame:
        return hits.withColumn("context", self._context()).orderBy(*fusion.final_order()).limit(k).select(*RESULT)

    def _context(self):
        out = F.array().cast("array<string>")
        for f in self.settings.folders:
            if f.context:
                out = F.when(F.col("source") == f.path, documents.resolve_context(F.col("file_path"), F.lit(f.path), f.context)).otherwise(out)
        return out

    # ------------------------------------------------------------ read

    def get(self, file_path: str, start_line: int = 0, end_line: int = 0) -> DataFrame:
        if not any(file_path.startswith(f.path.rstrip("/") + "/") for f in self.settings.folders):
            raise ValueError(f"{file_path} is not under any configured folder")
        return documents.get(self.store.table("chunks"), file_path, start_line, end_line)

    def multi_get(self, paths: str | Sequence[str], max_bytes: int = 0) -> DataFrame:
        patterns = [p.strip() for p in (paths.split(",") if isinstance(paths, str) else paths) if p.strip()]
        return documents.multi_get(self.store.table("chunks"), patterns, max_bytes, self._context())

    def status(self) -> DataFrame:
        """One row for each configured folder: its size, and what its last or present run is at."""
        rows = [(f.path, f.description) for f in self.settings.folders]
        folders = self.spark.createDataFrame(rows, "source string, description string")
        told = folders.join(self.store.status(), "source", "left").join(self.store.progress(), "source", "left")
        return told.select("source", "description", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "model", "dimensions", "quantization", "state", F.coalesce("percent", F.lit(0.0)).alias("percent"), "error").orderBy("source")

    def status_json(self) -> list[str]:
        return [r[0] for r in self.status().select(F.to_json(F.struct("*"))).collect()]

    def render(self, found: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*fusion.final_order()))
        return found.select(nth.alias("n"), F.concat(documents.render(), F.lit("\n"), "chunk_text").alias("line"))
