"""Vectors out of numpy files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, rowid, embedding) of little-endian float32 arrays of one or two dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.dtype != np.dtype("<f4") or a.ndim not in (1, 2) or not a.flags.c_contiguous:
                    raise ValueError(f"{name} holds no rows of little-endian float32")
                rows = a.reshape(1, -1) if a.ndim == 1 else a
                for s in range(0, len(rows), 4096):
                    part = rows[s : s + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(s, s + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float32()))], ["path", "rowid", "embedding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, rowid long, embedding array<float>")
