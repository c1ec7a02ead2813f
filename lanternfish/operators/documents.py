"""Reading stored files back: line ranges, globs, byte budgets, context, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import text as X

DEFAULT_BYTES, MAX_BYTES = 100_000, 1_000_000


def overlaps(first: Column, last: Column, start: int, end: int) -> Column:
    """Whether lines [first, last] meet [start, end]; limits that are not positive don't bind, nor does such a last line."""
    until = F.when(last > 0, last).otherwise(first)
    out = F.lit(True)
    if start > 0:
        out = out & (until >= start)
    return out & (first <= end) if end > 0 else out


def get(chunks: DataFrame, file_path: str, start: int = 0, end: int = 0) -> DataFrame:
    """Chunks of one file in order, those inside a line range."""
    return chunks.filter((F.col("file_path") == file_path) & overlaps(F.col("line_num"), F.col("end_line"), start, end)).orderBy("line_num", "rowid")


def expand_paths(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(file_path, ord) of files (file_path) that patterns name, in the patterns' order, each once.

    A pattern is a path, or a glob over the whole path or its last segment.
    """
    parts = []
    for k, p in enumerate(patterns):
        fits = X.matches_glob(F.col("file_path"), p) if X.is_glob(p) else F.col("file_path") == p
        parts.append(F.when(fits, F.lit(k)))
    nth = F.coalesce(*parts) if parts else F.lit(None).cast("int")
    return files.select("file_path").distinct().withColumn("nth", nth).filter("nth IS NOT NULL")


def within_budget(rows: DataFrame, file_order: Sequence[str], chunk_order: Sequence[str], budget: int) -> DataFrame:
    """Rows (bytes, header and the order columns) up to the first that doesn't fit, with their running total.

    header is counted at the first chunk of each file (one value of file_order). Rows past the budget are first
    cut per file by a window inside the file, so one running sum over whole files
    remains for the global order.
    """
    inside = Window.partitionBy(*file_order).orderBy(*chunk_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_file = rows.withColumn("_upto", F.sum("bytes").over(inside) + F.col("header")).filter(F.col("_upto") - F.col("bytes") <= budget)
    sizes = rows.groupBy(*file_order).agg((F.sum("bytes") + F.max("header")).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy(*file_order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") <= budget)
    out = per_file.join(before.select(*file_order, "_before"), list(file_order)).withColumn("total", F.col("_before") + F.col("_upto"))
    return out.filter(F.col("total") <= budget).drop("_upto", "_before")


def chunk_location() -> Column:
    many = (F.col("end_line") > 0) & (F.col("end_line") != F.col("line_num"))
    return F.concat(F.col("file_path"), F.lit(":"), F.col("line_num").cast("string"), F.when(many, F.concat(F.lit("-"), F.col("end_line").cast("string"))).otherwise(""))


def multi_get(chunks: DataFrame, patterns: Sequence[str], max_bytes: int = 0, context: Column | None = None) -> DataFrame:
    """Chunks of several files in order, as many as fit into max_bytes when they are rendered."""
    budget = min(max_bytes if max_bytes > 0 else DEFAULT_BYTES, MAX_BYTES)
    named = expand_paths(chunks, patterns)
    symbol = F.when(F.col("symbol") != "", F.octet_length("symbol") + 3).otherwise(0)
    rows = chunks.join(named, "file_path").withColumn("context", context if context is not None else F.array().cast("array<string>"))
    heading = F.octet_length("file_path") + 9 + F.when(F.size("context") > 0, F.octet_length(F.array_join("context", " > ")) + 10).otherwise(0)
    sized = rows.withColumn("bytes", (F.octet_length(chunk_location()) + symbol + F.octet_length("chunk_text") + 3).cast("long")).withColumn("header", heading.cast("long"))
    return within_budget(sized, ["nth", "file_path"], ["line_num", "rowid"], budget).orderBy("nth", "file_path", "line_num", "rowid")


def relative(path: Column, folder: Column) -> Column:
    inside = (folder != "") & path.startswith(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))
    return F.when(inside, F.substring(path, F.length(F.rtrim(folder, F.lit("/"))) + 2, F.length(path))).otherwise(path)


def resolve_context(path: Column, folder: Column, contexts: dict[str, str]) -> Column:
    """Descriptions whose path prefix holds the file, general to specific; "" and "." hold all."""
    here = relative(path, folder)
    entries = sorted((("" if k == "." else k), v) for k, v in contexts.items())
    entries.sort(key=lambda e: len(e[0]))
    found = [F.when(F.lit(True) if not k else (here == k) | here.startswith(f"{k}/"), F.lit(v)) for k, v in entries]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def resolve_source(path: Column, folders: Sequence[str]) -> Column:
    """The first configured folder that a path lies in; null if there is none."""
    parts = [F.when((path == f) | path.startswith(f.rstrip("/") + "/"), F.lit(f)) for f in folders]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def render() -> Column:
    """A result's heading: [score] path:lines [symbol] (context)."""
    symbol = F.when(F.col("symbol") != "", F.concat(F.lit(" ["), "symbol", F.lit("]"))).otherwise("")
    context = F.when(F.size("context") > 0, F.concat(F.lit(" ("), F.array_join("context", " > "), F.lit(")"))).otherwise("")
    return F.concat(F.format_string("[%.2f] ", F.col("score").cast("double")), chunk_location(), symbol, context)
