"""Operator 10: quality rules with compression bands.

Base rules count words, symbols, repeated lines and words inside repeated 8-word
windows. The method adds zstandard: the whole text and every fixed chunk of it
are compressed, and the ratio of compressed to plain bytes must stay inside a
band that depends on the length. Text below the band is repetitive, text above it
is incompressible noise. A document fails by its whole text, when more than a set
share of its chunks leaves the band, or when any long piece of it leaves the band of
its own length, so that no document is long enough to hide junk.

Every document is judged alone, so there is no shuffle and no group; a task holds
one Arrow batch. Defined cases: null and empty texts have no words, so
``base_failed`` is true and ratios are null; equal rows give equal results; extra
columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_words, covered, gram_ids, grams, lean, map_by_place, table

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
CHUNK_BYTES = 4096
LEVEL = 3
#: (bytes of text up to here, lowest ratio, highest ratio). Short texts compress badly: zstandard has nothing to refer to yet.
BANDS = ((256, 0.40, 1.10), (1024, 0.33, 0.92), (4096, 0.28, 0.82), (16384, 0.25, 0.76), (1 << 62, 0.20, 0.72))
#: Share of the fixed chunks that may leave the band.
MAX_BAD_CHUNKS = 0.5
#: Bytes of the pieces, of which none may leave the band; each overlaps half of the one before, so junk of 1.5 pieces fills one.
PIECE_BYTES = 16384

_SYMBOL = re.compile(r"[#*$%&|<>]")
_BLANK = " \t\n\v\f\r"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    ws = byte_words(text)
    n_dup, seen = 0, set()
    for line in text.split("\n"):
        if _HAS_WORD.search(line):
            if line in seen:
                n_dup += 1
            seen.add(line)
    n_repeat = 0
    if len(ws) > WINDOW:
        sums = np.sort(grams(np.fromiter(map(hash, ws), np.int64, len(ws)).view(np.uint64), WINDOW))
        if (sums[1:] == sums[:-1]).any():  # equal windows have equal hashes; which ones are equal is settled exactly
            known: dict[bytes, int] = {}
            wins = gram_ids(np.array([known.setdefault(w, len(known)) for w in ws], dtype=np.int64), WINDOW)
            n_repeat = int(covered((np.bincount(wins) > 1)[wins], WINDOW, len(ws)).sum())
    return len(ws), len(text) - sum(map(text.count, _BLANK)), len(_SYMBOL.findall(text)), n_dup, n_repeat


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((lo, hi) for most, lo, hi in bands if n_bytes <= most)


def compression(text: str, compressor, chunk_bytes: int = CHUNK_BYTES, bands=BANDS) -> tuple[float | None, float]:
    """Ratio of the whole text, and the share of its fixed chunks that leave the band of their length."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return None, 0.0
    whole = len(compressor.compress(data)) / len(data)
    if len(data) <= chunk_bytes:
        return whole, 0.0
    # The last chunk is as long as the others and may overlap the one before it.
    starts = [*range(0, len(data) - chunk_bytes, chunk_bytes), len(data) - chunk_bytes]
    lo, hi = band(chunk_bytes, bands)
    bad = sum(not lo <= len(compressor.compress(data[s : s + chunk_bytes])) / chunk_bytes <= hi for s in starts)
    return whole, bad / len(starts)


def compression_ok(n_bytes: int, ratio: float | None, bad_chunks: float, bands=BANDS, max_bad=MAX_BAD_CHUNKS) -> bool:
    if ratio is None:
        return False
    lo, hi = band(n_bytes, bands)
    return lo <= ratio <= hi and bad_chunks <= max_bad


def pieces_ok(text: str, compressor, piece_bytes: int = PIECE_BYTES, bands=BANDS) -> bool:
    """Whether every piece of a text longer than one stays inside the band of its length."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= piece_bytes:
        return True
    lo, hi = band(piece_bytes, bands)
    starts = [*range(0, len(data) - piece_bytes, piece_bytes // 2), len(data) - piece_bytes]
    return all(lo <= len(compressor.compress(data[s : s + piece_bytes])) / piece_bytes <= hi for s in starts)


def _judge(texts, bands, chunk_bytes, max_bad):
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for text in texts:
        counts = base_counts(text)
        failed = base_failed(counts[0], counts[4])
        ratio, bad = compression(text or "", compressor, chunk_bytes, bands)
        ok = compression_ok(len((text or "").encode("utf-8", "surrogatepass")), ratio, bad, bands, max_bad)
        ok = ok and not failed and pieces_ok(text or "", compressor, bands=bands)
        yield (*counts, failed, not failed and ok, ratio, bad)


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio", "bad_chunk_share")
_TYPES = (pa.int64(),) * 5 + (pa.bool_(),) * 2 + (pa.float64(),) * 2
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_share double"


def score(docs: DataFrame, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad: float = MAX_BAD_CHUNKS) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, and the compression figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_judge(b.column(1).to_pylist(), bands, chunk_bytes, max_bad))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]], ["doc_id", *_FIELDS])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(lean(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {_DDL}")


def keep_clean(docs: DataFrame, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad: float = MAX_BAD_CHUNKS) -> DataFrame:
    """The rows of docs that pass, with all their columns, in one pass and without a join."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([r[6] for r in _judge(b.column(at).to_pylist(), bands, chunk_bytes, max_bad)], pa.bool_()))

    return map_by_place(docs, lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
