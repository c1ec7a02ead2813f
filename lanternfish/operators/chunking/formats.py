"""The chunker for a file by its name, and tables of files to tables of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import DEFAULT_MAX_BYTES, MIN_BYTES, Chunk, cap
from .code import LANGUAGES, chunk_code
from .markdown import chunk_markdown
from .session import chunk_session
from .source import OVERLAP, WINDOW, chunk_source

CHUNK_SCHEMA = "source string, file_path string, ordinal int, line_num int, end_line int, chunk_text string, language string, chunk_kind string, symbol string, error string"


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def chunk_file(path: str, content: str, max_bytes: int = DEFAULT_MAX_BYTES) -> list[Chunk]:
    """Chunks of one file, none over max_bytes."""
    ext = extension(path)
    if ext in (".md", ".markdown"):
        chunks = chunk_markdown(content)
    elif ext == ".jsonl":
        found = chunk_session(content)
        chunks = chunk_source(content) if found is None else found
    elif ext in LANGUAGES:
        chunks = chunk_code(content, LANGUAGES[ext]) or chunk_source(content)
    else:
        chunks = chunk_source(content)
    return cap(chunks, max_bytes)


def chunk_table(files: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """Chunks of files (source, file_path, content binary); a file that fails is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, path, content in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    made = chunk_file(path, (content or b"").decode("utf-8", "replace"), max_bytes)
                    rows += [(source, path, k, c.start_line, c.end_line, c.text, c.language, c.kind, c.symbol, None) for k, c in enumerate(made)]
                except Exception as e:  # a bad file must not fail the others
                    rows.append((source, path, 0, None, None, None, None, None, None, str(e)[:500]))
            kinds = (pa.string(), pa.string(), *[pa.int32()] * 3, *[pa.string()] * 5)
            names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return files.select("source", "file_path", "content").mapInArrow(run, CHUNK_SCHEMA)


def window_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Windows of 30 lines, 25 apart, as expressions only: (key, line_num, end_line, chunk_text)."""
    lines = docs.select(F.col(key), F.split(F.col(text), "\n", -1).alias("lines")).withColumn("n", F.size("lines"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - WINDOW) / (WINDOW - OVERLAP)).cast("int")) * (WINDOW - OVERLAP)
    begun = lines.withColumn("begin", F.explode(F.sequence(F.lit(0), last, F.lit(WINDOW - OVERLAP))))
    body = F.regexp_replace(F.array_join(F.slice("lines", F.col("begin") + 1, F.lit(WINDOW)), "\n"), r"^\s+|\s+$", "")
    out = begun.select(key, (F.col("begin") + 1).alias("line_num"), F.least(F.col("begin") + WINDOW, F.col("n")).alias("end_line"), body.alias("chunk_text"))
    return out.filter(F.octet_length("chunk_text") >= MIN_BYTES)
