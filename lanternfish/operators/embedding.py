"""Texts to vectors through a pluggable embedder, in batches of bounded count and bytes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.text import tokenize_query


def batches_by_budget(texts: Sequence[str], max_count: int, max_bytes: int) -> list[list[int]]:
    """Positions of texts in order, in batches within both limits; a text over the limit goes alone, limits that are not positive don't bind."""
    out: list[list[int]] = []
    size = 0
    for i, t in enumerate(texts):
        n = len(t.encode("utf-8", "surrogatepass"))
        full = out and ((max_count > 0 and len(out[-1]) >= max_count) or (max_bytes > 0 and size + n > max_bytes))
        if not out or full:
            out.append([])
            size = 0
        out[-1].append(i)
        size += n
    return out


def batch_bytes(rows: DataFrame, text: str = "chunk_text") -> DataFrame:
    """One row (total, largest, texts): bytes of all texts together and of the largest; nulls don't count."""
    size = F.octet_length(text)
    return rows.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("largest"), F.count(text).alias("texts"))


def fnv1a(data: bytes) -> int:
    h = 0x811C9DC5
    for b in data:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


class HashEmbedder:
    """A deterministic embedder that needs no model: counts of hashed query tokens, of length 1."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            counts = Counter(fnv1a(x.encode()) % self.dimensions for x in tokenize_query(t))
            size = math.sqrt(sum(c * c for c in counts.values()))
            out.append([counts.get(k, 0) / size for k in range(self.dimensions)] if size else [1.0, *[0.0] * (self.dimensions - 1)])
        return out


def fit_dimensions(vector: Sequence[float], dimensions: int) -> list[float]:
    """A vector cut to a number of dimensions and brought to length 1; a shorter one is an error, one without length stays."""
    if len(vector) < dimensions:
        raise ValueError(f"expected {dimensions} dimensions, got {len(vector)}")
    short = list(vector[:dimensions])
    size = math.sqrt(math.fsum(x * x for x in short))
    return [x / size for x in short] if size and len(vector) > dimensions else short


def embed(rows: DataFrame, embedder, text: str = "chunk_text", max_count: int = 64, max_bytes: int = 65_536) -> DataFrame:
    """rows with embedding array<float> and error; a batch that fails marks its rows and no others."""
    names = rows.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            for group in batches_by_budget(texts, max_count, max_bytes):
                try:
                    found = embedder([texts[i] for i in group])
                    if len(found) != len(group):
                        raise ValueError(f"{len(found)} vectors for {len(group)} texts")
                    for i, v in zip(group, found, strict=True):
                        vectors[i] = fit_dimensions(v, embedder.dimensions)
                except Exception as e:  # the next run tries these files again
                    for i in group:
                        errors[i] = str(e)[:500] or type(e).__name__
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*names, "embedding", "embed_error"])

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "embedding array<float>, embed_error string"])
    return rows.mapInArrow(run, fields)
