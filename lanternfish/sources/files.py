"""Files of folders: what is scanned and what is left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.text import glob_pattern
from lanternfish.operators.chunking.code import LANGUAGES

EXTENSIONS = (*LANGUAGES, ".md", ".markdown", ".txt", ".org", ".jsonl")


def ignore_rules(text: str) -> list[tuple[bool, bool, str]]:
    """(negated, for folders only, regular expression on relative paths) of the lines of an ignore file."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        folder, anchored = line.endswith("/"), "/" in line.strip("/") or line.startswith("/")
        body = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*"}.get(p) or glob_pattern(p)[4:-2] for p in _pieces(line.strip("/")))
        out.append((negated, folder, ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$")))
    return out


def _pieces(pattern: str) -> list[str]:
    import re

    return [p for p in re.split(r"(\*\*/|/\*\*|\*\*)", pattern) if p]


def ignored(relative: Column, text: str) -> Column:
    """Whether the last rule that fits a relative path excludes it."""
    out = F.lit(False)
    for negated, _, pattern in ignore_rules(text):
        out = F.when(relative.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def wanted(relative: Column, length: Column, exclude: Sequence[str] = (), include: Sequence[str] = (), max_kb: int = 0, ignore: str = "") -> Column:
    """Whether a file is to be indexed: outside excluded folders and ignored paths, of an included name or a known extension, not too large."""
    folders = F.slice(F.split(relative, "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    out = F.lit(True)
    for name in exclude:
        out = out & ~F.array_contains(folders, name) & ~F.concat(F.lit("/"), relative).contains(f"/{name}/")
    if ignore:
        out = out & ~ignored(relative, ignore)
    base = F.element_at(F.split(relative, "/"), -1)
    if include:
        named = F.lit(False)
        for glob in include:
            named = named | base.rlike(glob_pattern(glob))
        out = out & named
    else:
        out = out & F.lower(F.regexp_extract(base, r"\.[^.]+$", 0)).isin(*EXTENSIONS)
    return out & (length <= max_kb * 1024) if max_kb > 0 else out


def root_ignore(spark: SparkSession, root: str) -> str:
    """Text of the .gitignore in a folder's root, empty without one; Spark's own readers pass over hidden files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/.gitignore")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return ""
    stream = system.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scan(spark: SparkSession, root: str, exclude: Sequence[str] = (), include: Sequence[str] = (), max_kb: int = 0, ignore: str = "") -> DataFrame:
    """(source, file_path, mtime, length, content) of a folder's files; content is read only where it is asked for."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rows = files.select(F.lit(root).alias("source"), path.alias("file_path"), F.unix_micros("modificationTime").alias("mtime"), "length", "content")
    relative = F.substring("file_path", len(root) + 2, 1 << 20)
    return rows.filter(wanted(relative, F.col("length"), exclude, include, max_kb, ignore))
