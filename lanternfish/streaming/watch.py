"""Watching folders: an index that follows its files."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(engine, interval: float = 300.0, cycles: int | None = None) -> list[dict]:
    """Index again and again; a cycle that fails is logged and survived. Also sees deletions."""
    out: list[dict] = []
    while cycles is None or len(out) < cycles:
        if out:
            time.sleep(interval)
        try:
            out.append(engine.index())
        except Exception as e:
            log.exception("indexing failed")
            out.append({"error": str(e)})
        if cycles is None:
            out = out[-1:]
    return out


def stream(engine, folder: str, checkpoint: str, interval: str = "5 minutes", once: bool = False) -> StreamingQuery:
    """Index a folder as files arrive: a file stream tells that there are some, and each micro-batch diffs and upserts.

    With once, what is there now is indexed and the query ends. Deletions are
    seen with the next arrival, since a file stream reports none.
    """
    arriving = engine.spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(folder).select("path", "modificationTime")

    def upsert(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.reindex(folder)

    writer = arriving.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
