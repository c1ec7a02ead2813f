"""The index as tables of files that never change, and commits that say which count.

A change of a source writes its tables (chunks, vectors, files, postings) into a
new folder and then adds one small commit file, by a rename: readers see all of
a change or none, and a run that stops midway leaves the old rows. Rows of files
that did not change are copied without being chunked, embedded or tokenized again.
The folders of the last commit but one stay for readers that are still at them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions import vectors as V
from lanternfish.operators import bm25

SCHEMA_VERSION = 3
CHUNKS = "rowid long, source string, file_path string, ordinal int, line_num int, end_line int, chunk_text string, folder string, language string, chunk_kind string, symbol string"
FILES = "source string, file_path string, mtime long"
VECTORS = "rowid long, source string, embedding binary"
POSTINGS = "source string, term string, col string, rowid long, dl int, positions array<int>"
SCHEMAS = {"chunks": CHUNKS, "files": FILES, "vectors": VECTORS, "postings": POSTINGS}
META = "source string, model string, dimensions int, quantization string, max_input_bytes int"
PROGRESS = "source string, state string, total long, processed long, error string, at long"


def diff(tracked: DataFrame, scanned: DataFrame) -> DataFrame:
    """(source, file_path, mtime, status) of both sets of files: new, changed, unchanged or deleted."""
    t, s = tracked.alias("t"), scanned.alias("s")
    both = t.join(s, (F.col("t.source") == F.col("s.source")) & (F.col("t.file_path") == F.col("s.file_path")), "full_outer")
    status = F.when(F.col("s.file_path").isNull(), "deleted").when(F.col("t.file_path").isNull(), "new").when(F.col("t.mtime") == F.col("s.mtime"), "unchanged").otherwise("changed")
    return both.select(F.coalesce("t.source", "s.source").alias("source"), F.coalesce("t.file_path", "s.file_path").alias("file_path"), F.coalesce("s.mtime", "t.mtime").alias("mtime"), status.alias("status"))


def pruned(stored: DataFrame, configured: DataFrame, key: str = "source") -> DataFrame:
    """Stored rows whose key is configured no longer."""
    return stored.join(configured.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def percent(done: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0))


def _folder(source: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, source).hex


def rowid() -> Column:
    """A stable id of a chunk by its place."""
    return F.xxhash64("source", "file_path", "line_num", "ordinal")


@dataclass(frozen=True)
class Meta:
    """What a source was indexed with; any difference means indexing it anew."""

    model: str
    dimensions: int
    quantization: str = "int8"
    max_input_bytes: int = 8192


class IndexStore:
    """The tables of an index under one folder.

    A commit holds, for each source, the folder of each of its tables and the
    numbers of its chunks and tokens, which every ranking needs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ files

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, name: str) -> bool:
        fs, p = self._fs(self._path(name))
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _read_json(self, name: str):
        fs, p = self._fs(self._path(name))
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readNBytes(int(size))).decode())
        finally:
            stream.close()

    def _write_json(self, name: str, value, anew: bool = False) -> None:
        """Write beside the place and rename; anew: nothing may stand there yet."""
        fs, at = self._fs(self._path(name))
        _, made = self._fs(self._path(f"_made/{uuid.uuid4().hex}"))
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        fs.mkdirs(at.getParent())
        if not anew:
            fs.delete(at, False)
        if fs.exists(at) or not fs.rename(made, at):
            fs.delete(made, False)
            raise RuntimeError(f"another writer made {name}")

    # ------------------------------------------------------------ commits

    def _commits(self) -> list[int]:
        fs, p = self._fs(self._path("commits"))
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(p)) if fs.exists(p) else []

    def _state(self) -> dict[str, dict]:
        made = self._commits()
        return self._read_json(f"commits/{made[-1]:010d}.json") if made else {}

    def _commit(self, state: dict[str, dict]) -> None:
        made = self._commits()
        self._write_json(f"commits/{(made[-1] if made else 0) + 1:010d}.json", state, anew=True)
        folders = lambda x: {f for s in x.values() for f in s["tables"].values()}
        used = folders(state) | (folders(self._read_json(f"commits/{made[-1]:010d}.json")) if made else set())
        for n in made[:-1]:
            for f in folders(self._read_json(f"commits/{n:010d}.json")) - used:
                self._delete(self._path(f))
            self._delete(self._path(f"commits/{n:010d}.json"))

    def table(self, name: str, sources: Sequence[str] | None = None) -> DataFrame:
        """A table's rows of all sources, or of those named, whose folders alone are read."""
        if name == "meta":
            return self._meta_table()
        state = self._state()
        paths = [self._path(s["tables"][name]) for k, s in sorted(state.items()) if name in s["tables"] and (sources is None or k in sources)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(T._parse_datatype_string(SCHEMAS[name])).parquet(*paths)

    def keywords(self) -> bm25.Stored:
        """The written inverted index of all sources."""
        state = self._state()
        return bm25.Stored(self.table("postings"), sum(s["chunks"] for s in state.values()), sum(s["tokens"] for s in state.values()))

    def _snapshot(self, rows: DataFrame) -> DataFrame:
        """rows apart from what they were made of, which is dear or may be deleted."""
        if not self.spark.sparkContext.getCheckpointDir():
            self.spark.sparkContext.setCheckpointDir(self._path("_checkpoints"))
        return rows.checkpoint()

    def replace_files(self, changed: DataFrame, chunks: DataFrame, vectors: DataFrame, mtimes: DataFrame) -> None:
        """Replace the rows of changed files (source, file_path) in all tables by one commit; a file without new rows is gone.

        mtimes (source, file_path, mtime) are those to remember; a file that
        failed is left out and so tried again by the next run. Two chunks at one
        place would be one row, so rowids are taken as unique.
        """
        keys = changed.select("source", "file_path").distinct()
        state = self._state()
        for source in sorted(r[0] for r in changed.select("source").distinct().collect()):  # configured folders, a few
            of = lambda rows, source=source: rows.filter(F.col("source") == source)
            old = {n: self.table(n, [source]) for n in SCHEMAS}
            gone = old["chunks"].join(of(keys), ["source", "file_path"], "left_semi").select("rowid")
            fresh = of(chunks)
            state[source] = self._written(
                {
                    "chunks": old["chunks"].join(of(keys), ["source", "file_path"], "left_anti").unionByName(fresh),
                    "vectors": old["vectors"].join(gone, "rowid", "left_anti").unionByName(of(vectors)),
                    "files": old["files"].join(of(keys), ["source", "file_path"], "left_anti").unionByName(of(mtimes)),
                    "postings": old["postings"].join(gone, "rowid", "left_anti").unionByName(bm25.stored_postings(bm25.index(fresh))),
                }
            )
        self._commit({k: s for k, s in state.items() if s["files"]})

    def _written(self, tables: dict[str, DataFrame]) -> dict:
        """A source's entry in a commit, after its tables are written into new folders."""
        folder, out = f"data/{uuid.uuid4().hex}", {}
        for name, rows in tables.items():
            # Sorted by term, so that a search skips the row groups of other terms.
            rows = rows.repartitionByRange("term").sortWithinPartitions("term", "rowid") if name == "postings" else rows
            out[name] = f"{folder}/{name}"
            rows.select(*[f.split()[0] for f in SCHEMAS[name].split(", ")]).write.parquet(self._path(out[name]))
        kept = lambda name: self.spark.read.schema(T._parse_datatype_string(SCHEMAS[name])).parquet(self._path(out[name]))
        tokens = kept("postings").agg(F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()[0]
        return {"tables": out, "files": kept("files").count(), "chunks": kept("chunks").count(), "tokens": tokens}

    def delete_file(self, source: str, file_path: str) -> None:
        keys = self.spark.createDataFrame([(source, file_path)], "source string, file_path string")
        none = [self.spark.createDataFrame([], s) for s in (CHUNKS, VECTORS, FILES)]
        self.replace_files(keys, *none)

    def clear_source(self, source: str) -> None:
        self._commit({k: s for k, s in self._state().items() if k != source})
        self._delete(self._path(f"meta/{_folder(source)}.json"))

    # ------------------------------------------------------------ facts of sources

    def _meta_table(self) -> DataFrame:
        fs, p = self._fs(self._path("meta"))
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return self.spark.createDataFrame([tuple(self._read_json(f"meta/{n}").values()) for n in names], META)

    def set_meta(self, source: str, meta: Meta) -> None:
        self._write_json(f"meta/{_folder(source)}.json", {"source": source, **asdict(meta)})

    def meta(self, source: str) -> Meta | None:
        name = f"meta/{_folder(source)}.json"
        if not self._exists(name):
            return None
        return Meta(**{k: v for k, v in self._read_json(name).items() if k != "source"})

    def drop_other_vectors(self, meta: Meta) -> None:
        """If any source has vectors of another length or kind, drop all vectors and what says that files are indexed."""
        kinds = {(r["dimensions"], r["quantization"]) for r in self._meta_table().select("dimensions", "quantization").distinct().collect()}
        if kinds - {(meta.dimensions, meta.quantization)}:
            self._commit({k: {**s, "tables": {n: f for n, f in s["tables"].items() if n not in ("vectors", "files")}} for k, s in self._state().items()})
            self._delete(self._path("meta"))

    def set_progress(self, source: str, state: str, total: int, processed: int, error: str | None = None) -> None:
        """What a run of a source is at: indexing, done or failed."""
        self._write_json(f"progress/{_folder(source)}.json", [source, state, total, processed, error, int(time.time())])

    def progress(self) -> DataFrame:
        """(source, state, total, processed, percent, error, at)."""
        fs, p = self._fs(self._path("progress"))
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        rows = self.spark.createDataFrame([tuple(self._read_json(f"progress/{n}")) for n in names], PROGRESS)
        return rows.select("source", "state", "total", "processed", percent(F.col("processed"), F.col("total")).alias("percent"), "error", "at")

    def needs_rebuild(self, source: str, meta: Meta) -> bool:
        known = self.meta(source)
        return known is not None and known != meta

    def sources(self) -> list[str]:
        return sorted(r[0] for r in self.table("files").select("source").distinct().collect())

    def version(self) -> int | None:
        return self._read_json("version.json") if self._exists("version.json") else 2 if self._exists("version") else None

    def migrate(self) -> None:
        """Bring the tables to SCHEMA_VERSION: from the partitioned tables before it, else from nothing."""
        have = self.version()
        if have == 2:
            self._from_partitions()
        elif have is not None and have != SCHEMA_VERSION:
            for name in ("commits", "data", "meta"):
                self._delete(self._path(name))
        if have != SCHEMA_VERSION:
            self._write_json("version.json", SCHEMA_VERSION)

    def _from_partitions(self) -> None:
        """Tables in partitions of ``source``, without postings: vectors lose orphans, postings are built."""
        old = {n: self.spark.read.parquet(self._path(n)).withColumn("source", F.col("source").cast("string")) for n in ("chunks", "vectors", "files", "meta") if self._exists(n)}
        metas = old["meta"].collect() if "meta" in old else []
        state = {}
        if {"chunks", "vectors", "files"} <= set(old):
            for r in metas:
                here = {n: rows.filter(F.col("source") == r["source"]) for n, rows in old.items()}
                vectors = here["vectors"].join(here["chunks"].select("rowid"), "rowid", "left_semi").withColumn("embedding", V.pack("embedding"))
                state[r["source"]] = self._written({"chunks": here["chunks"], "vectors": vectors, "files": here["files"], "postings": bm25.stored_postings(bm25.index(here["chunks"]))})
        for name in (*old, "version"):
            self._delete(self._path(name))
        for r in metas:
            self.set_meta(r["source"], Meta(r["model"], r["dimensions"], r["quantization"], r["max_input_bytes"] if "max_input_bytes" in r else 8192))
        self._commit(state)

    def status(self) -> DataFrame:
        """(source, files, chunks, model, dimensions, quantization)."""
        files = self.table("files").groupBy("source").agg(F.count(F.lit(1)).alias("files"))
        chunks = self.table("chunks").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
        both = files.join(chunks, "source", "full_outer").join(self.table("meta"), "source", "left")
        return both.select("source", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "model", "dimensions", "quantization")
