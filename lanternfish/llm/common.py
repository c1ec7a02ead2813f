"""What several operators of this subpackage share: tables, words, shared folders."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word: a run without ASCII white space. The same text serves Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: ASCII letters only; other alphabets keep their case.
_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """Words of a whole text; none of a null one."""
    return _WORD.findall(text) if text else []


def byte_words(text: str | None) -> list[bytes]:
    """The same words in UTF-8, several times as fast: bytes are split at ASCII white space alone."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER) if not text.isascii() else text.lower()


def n_words(text: Column) -> Column:
    """Number of words, 0 for null, inside the JVM."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and every executor share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, as in
    local tests, the session gets one under the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later job reads; only what was built from them and written may be used on."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: names that hold dots or clash with an operator's own do no harm."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def map_by_place(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow in which columns go by place alone; the result has the names of ``schema``."""
    names = [f"c{i}" for i in range(len(schema))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names)

    return by_place(df).mapInArrow(placed, StructType([StructField(n, f.dataType) for n, f in zip(names, schema, strict=True)])).toDF(*schema.names)


_MODELS: dict = {}


def per_worker(kind: Callable, path: str):
    """One model a worker, made when first asked for; a worker that turns to another gives the last one up."""
    if (kind, path) not in _MODELS:
        _MODELS.clear()
        _MODELS[kind, path] = kind(path)
    return _MODELS[kind, path]


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches that needs no model: its worker gives up those of other operators, and free memory at the end."""

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(only_with_models=True)
        yield from run(batches)
        give_back()

    return slim


def give_back(only_with_models: bool = False) -> None:
    """This worker's models go, and free memory that it holds goes back to the system."""
    if only_with_models and not _MODELS:
        return
    _MODELS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


class Memo(dict):
    """Answers of a function by text, remembered up to ``limit``; long texts are not kept."""

    def __init__(self, answer: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.answer, self.limit, self.longest = answer, limit, longest

    def __missing__(self, text: str):
        out = self.answer(text)
        if len(text) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[text] = out
        return out


#: Bits of the map that keeps most texts without candidates from the shuffle: 2^20 words, about 32 MB, at most.
FILTER_BITS = 1 << 26


def may_be_in(rows: DataFrame, docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows without most of those whose doc is not in docs, before any shuffle.

    docs sets bits of a map that has bits / 64 words at most, whatever its size,
    so it can be broadcast. The fuller the map, the more rows pass in vain; a
    join must follow.
    """
    place = F.pmod(F.xxhash64("doc"), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc), {int(bits)}L) & 63 as int))")
    words = docs.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return rows.join(F.broadcast(words), (word == F.col("_word")) & (bit.bitwiseAND(F.col("_bits")) != 0), "left_semi")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# 64-bit mixing of integer arrays (public splitmix64 constants).
def mix64(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BYTE_OTHER = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C55
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's base, and of its inverse, up to n."""
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def word_hashes(text: str | None, lower: bool = False, segment: int = 1 << 20, other: bool = False) -> np.ndarray:
    """64-bit hashes of the words of a whole text, in order, without a Python object for each.

    A word's hash is a polynomial in its bytes, read off running sums over the
    text. lower: as if A-Z were a-z; other: hashes independent of the usual ones. Long texts go by segments that end at white
    space, so memory follows the longest word and not the text.
    """
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(at + segment, len(data))
        if end < len(data):
            blank = np.flatnonzero(_BLANK[data[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                rest = np.flatnonzero(_BLANK[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        out.append(_segment_hashes(data[at:end], _BYTE_LOWER if lower else _BYTE_OTHER if other else _BYTE))
        at = end
    return np.concatenate(out)


def _segment_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[True], _BLANK[data], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of n items, from the items' hashes.

    A polynomial in the items; runs double in length (1, 2, 4, ...) and the
    lengths that sum to n are put together.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    level, length, base, acc, done, shift = h, 1, 0x9E3779B97F4A7C15, None, 0, 1
    with np.errstate(over="ignore"):
        while True:
            if n & length:
                acc = level if acc is None else level[: len(acc) - length] * np.uint64(shift) + acc[length:]
                done, shift = done + length, shift * base % (1 << 64)
            if done == n:
                return mix64(acc[:m])
            level = level[:-length] * np.uint64(base) + level[length:]
            length, base = length * 2, base * base % (1 << 64)


def gram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """Exact ids of every run of n items: equal ids if and only if the runs are equal.

    Runs double in length (1, 2, 4, ...) and each length is numbered anew, so no
    hash can collide.
    """
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.int64)
    level, length, done, acc = np.asarray(ids, dtype=np.int64), 1, 0, None
    while True:
        if n & length:
            part = level[done : done + m]
            acc = part if acc is None else np.unique(acc * (int(part.max()) + 1) + part, return_inverse=True)[1]
            done += length
        if done == n:
            return acc
        pair = level[:-length] * (int(level.max()) + 1) + level[length:]
        level, length = np.unique(pair, return_inverse=True)[1], length * 2


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the items that a run of n, starting at a marked start, covers."""
    edge = np.zeros(total + 1, dtype=np.int32)
    np.add.at(edge, np.flatnonzero(starts), 1)
    at = np.flatnonzero(starts) + n
    np.add.at(edge, at, -1)
    return np.cumsum(edge[:total]) > 0
