"""Exact nearest neighbours over a table of vectors.

One query is a literal in the plan, so its search is a projection and a bounded
top-k in each partition (TakeOrderedAndProject) without any join. Many queries
stream past groups of vectors dealt out by key, and keep k rows each before the
shuffle that merges them. Filters stand below the distance and reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions import vectors as V

MAX_K = 4096
MAX_DIMENSIONS = 8192
#: Numbers in the vectors that a task holds, and in a block that it works on: 64 and 16 MB.
GROUP_CELLS, BLOCK_CELLS = 1 << 23, 1 << 21
#: What a matrix product may be wrong by, against the size of its operands.
SLACK = 1e-9


@dataclass(frozen=True)
class VectorTable:
    """A vector table's columns: checked when it is declared, and a schema for its data."""

    dimensions: int
    element: str = "float"
    metric: str = "l2"
    partition_keys: tuple[str, ...] = ()
    metadata: tuple[tuple[str, str], ...] = ()
    auxiliary: tuple[tuple[str, str], ...] = ()
    key: str = "rowid"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= self.dimensions <= MAX_DIMENSIONS:
            raise ValueError(f"dimensions must be in 1..{MAX_DIMENSIONS}")
        if self.element not in ("float", "tinyint"):
            raise ValueError("vectors hold float or tinyint")
        if self.metric not in V.DISTANCES:
            raise ValueError(f"metric must be one of {sorted(V.DISTANCES)}")
        if len(self.partition_keys) > 4 or len(self.metadata) > 16 or len(self.auxiliary) > 16:
            raise ValueError("at most 4 partition keys, 16 metadata and 16 auxiliary columns")
        if bad := [t for _, t in self.metadata if t not in ("boolean", "long", "double", "string")]:
            raise ValueError(f"metadata of type {bad[0]}")

    @property
    def schema(self) -> T.StructType:
        out = T.StructType().add(self.key, "long", False)
        for name in self.partition_keys:
            out.add(name, "string")
        out.add("embedding", T.ArrayType(T.FloatType() if self.element == "float" else T.ByteType(), False), False)
        for name, kind in (*self.metadata, *self.auxiliary):
            out.add(name, kind)
        return out

    def validated(self, df: DataFrame) -> DataFrame:
        """df with its vectors' dimensions checked as it is read."""
        right = F.size("embedding") == self.dimensions
        return df.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"expected {self.dimensions} dimensions, got "), F.size("embedding").cast("string"))).cast(df.schema["embedding"].dataType)))


def check_k(k: int) -> int:
    if not 0 <= k <= MAX_K:
        raise ValueError(f"k must be in 0..{MAX_K}")
    return k


def with_distance(vectors: DataFrame, query: Sequence[float], metric: str = "cosine", embedding: str = "embedding") -> DataFrame:
    return vectors.withColumn("distance", V.distance_to(F.col(embedding), query, metric))


def usable(distance: Column) -> Column:
    """Neither null nor NaN: a vector without length is near nothing."""
    return distance.isNotNull() & ~F.isnan(distance)


def knn(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: Column | None = None, distance_where=None, rowids: DataFrame | None = None, key: str = "rowid", embedding: str = "embedding") -> DataFrame:
    """The k rows nearest to one query, ties by key.

    where filters rows before distances; distance_where makes a condition from
    the distance column; rowids restricts to the keys it holds.
    """
    rows = vectors if where is None else vectors.filter(where)
    if rowids is not None:
        rows = rows.join(rowids.select(key).distinct(), key, "left_semi")
    near = with_distance(rows, query, metric, embedding).filter(usable(F.col("distance")))
    if distance_where is not None:
        near = near.filter(distance_where(F.col("distance")))
    return near.orderBy("distance", key).limit(check_k(k))


def knn_per_partition(vectors: DataFrame, query: Sequence[float], k: int, partition: str, metric: str = "cosine", key: str = "rowid", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows of each partition, with their rank."""
    order = Window.partitionBy(partition).orderBy("distance", key)
    near = with_distance(vectors, query, metric, embedding).filter(usable(F.col("distance")))
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= check_k(k))


class _Shelf:
    """Vectors of one group by rising key, against which queries are searched block by block.

    A matrix product finds who may be among the k nearest; only those get a
    distance. That is summed component by component, so it has the same bits
    wherever a vector lies, and equal vectors are equally far. Of equal vectors
    only the k smallest keys can count, so no others are kept.
    """

    def __init__(self, keys: np.ndarray, v: np.ndarray, k: int, metric: str):
        self.k, self.metric = k, metric
        norms = self._norms(v)
        at = np.flatnonzero(self._near_any(v, norms))
        at = at[np.argsort(keys[at], kind="stable")]
        if len(at) > k:
            same = pd.Series(pd.factorize(np.array([v[i].tobytes() for i in at], dtype=object))[0])
            at = at[(same.groupby(same).cumcount() < k).to_numpy()]
        self.keys, self.v, self.norms = keys[at], v[at], norms[at]

    @staticmethod
    def _sum(m: np.ndarray) -> np.ndarray:
        return np.cumsum(m, axis=1)[:, -1] if m.shape[1] else np.zeros(len(m))

    def _norms(self, m: np.ndarray) -> np.ndarray:
        step = max(1, BLOCK_CELLS // max(1, m.shape[1]))
        return np.concatenate([np.zeros(0), *[np.sqrt(self._sum(m[s : s + step] ** 2)) for s in range(0, len(m), step)]])

    def _near_any(self, m: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return norms > 0 if self.metric == "cosine" else ~np.isnan(norms)

    def _exact(self, q: np.ndarray, sizes: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(qi)), max(1, BLOCK_CELLS // max(1, q.shape[1]))
        for s in range(0, len(qi), step):
            x, y = qi[s : s + step], vi[s : s + step]
            a, b = q[x], self.v[y]
            if self.metric == "cosine":
                out[s : s + step] = 1 - self._sum(a * b) / (self.norms[y] * sizes[x])
            else:
                out[s : s + step] = self._sum(np.abs(b - a)) if self.metric == "l1" else np.sqrt(self._sum((b - a) ** 2))
        return out

    def _rough(self, q: np.ndarray, sizes: np.ndarray, begin: int, end: int) -> np.ndarray:
        """What rises with the distance: of queries (rows) and a block of vectors."""
        v = self.v[begin:end]
        if self.metric == "l1":
            out = np.zeros((len(q), len(v)))
            for j in range(q.shape[1]):
                out += np.abs(q[:, j, None] - v[None, :, j])
            return out
        if self.metric == "l2":
            return (q @ (-2 * v).T) + (self.norms[begin:end] ** 2)[None, :] + (sizes**2)[:, None]
        return (q / sizes[:, None]) @ (v / -self.norms[begin:end, None]).T + 1

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q, keys and distances of the k nearest of each."""
        k, asked = self.k, len(q)
        sizes = self._norms(q)
        rows = np.flatnonzero(self._near_any(q, sizes))
        q, sizes = q[rows], sizes[rows]
        qi = vi = np.zeros(0, dtype=np.int64)
        d = np.zeros(0)
        if not (k and len(rows) and len(self.v)):
            return qi, vi, d
        # Far above the rounding of a product, so that it hides no vector from the exact distance; l1 has no product.
        slack = {"cosine": SLACK * np.ones(len(q)), "l2": SLACK * (self.norms.max() + sizes) ** 2, "l1": np.zeros(len(q))}[self.metric]
        worst = np.full(len(q), np.inf)
        step = max(1, BLOCK_CELLS // asked)
        for begin in range(0, len(self.v), step):
            rough = self._rough(q, sizes, begin, begin + step)
            limit = (worst**2 if self.metric == "l2" else worst) + slack
            if begin == 0 and rough.shape[1] > k:
                first = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack
                limit = np.where(np.isnan(first), np.inf, first)
            x, y = np.nonzero(~(rough > limit[:, None]))
            y += begin
            far = self._exact(q, sizes, x, y)
            real = ~np.isnan(far)
            qi, vi, d = np.concatenate([qi, x[real]]), np.concatenate([vi, y[real]]), np.concatenate([d, far[real]])
            order = np.lexsort((vi, d, qi))
            qi, vi, d = qi[order], vi[order], d[order]
            nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
            qi, vi, d, nth = qi[nth < k], vi[nth < k], d[nth < k], nth[nth < k]
            worst[qi[nth == k - 1]] = d[nth == k - 1]
        return rows[qi], self.keys[vi], d


def _component(vectors: DataFrame, name: str) -> str:
    """Type of the components of a column of vectors."""
    kind = vectors.schema[name].dataType
    return kind.elementType.simpleString() if isinstance(kind, T.ArrayType) else ""


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "rowid", embedding: str = "embedding", vectors_per_group: int = 65_536, queries_per_group: int = 1_024) -> DataFrame:
    """The k nearest rows for each of many queries (query_id, embedding): query_id, rank, key, distance.

    Vectors are dealt out once, into groups of bounded size; each group is held
    by one task while all queries stream past it in blocks, and leaves k rows a
    query. A vector that is null or of another length than the query, or holds a
    null or NaN, is at no distance.
    """
    check_k(k)
    if metric not in V.DISTANCES:
        raise ValueError(f"metric must be one of {sorted(V.DISTANCES)}")
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(embedding)), F.lit(0))).first()
    held = max(1, min(vectors_per_group, GROUP_CELLS // max(1, width)))
    groups = max(1, -(-n // held), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n // 1_024)))
    kinds = {_component(vectors, embedding), _component(queries, "embedding")}
    kind = f"array<{kinds.pop()}>" if kinds in ({"float"}, {"tinyint"}) else "array<double>"
    left = vectors.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("side"), F.col(key).cast("long").alias("id"), F.col(embedding).cast(kind).alias("v"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("side"), F.col("query_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v"))
    dealt = left.unionByName(right).filter("v IS NOT NULL").withColumn("n", F.size("v")).repartitionById(groups, "g").sortWithinPartitions("g", "n", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shelf = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("g", "n", "side")], axis=1)
            ends = [*(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)] if len(marks) else []
            for begin, end in zip([0, *ends], ends, strict=False):
                g, size, side = marks[begin].tolist()
                if at != (g, size):
                    at, parts, shelf = (g, size), [], None
                ids = batch.column("id").slice(begin, end - begin).to_numpy(zero_copy_only=False)
                m = batch.column("v").slice(begin, end - begin).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(end - begin, size)
                if side == 0:
                    parts.append((ids, m))
                    continue
                with np.errstate(all="ignore"):
                    if parts:
                        keys, v = (np.concatenate(x) for x in zip(*parts, strict=True))
                        parts, shelf = [], _Shelf(keys, v, k, metric)
                        del v
                    for s in range(0, len(ids) if shelf else 0, queries_per_group):
                        rows, keys, d = shelf.nearest(m[s : s + queries_per_group])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[s + rows]), pa.array(keys), pa.array(d)], ["query_id", "key", "distance"])

    hits = dealt.mapInArrow(meet, "query_id long, key long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "key")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "distance")


def search_vectors(vectors: DataFrame, chunks: DataFrame, query: Sequence[float], top_k: int, threshold: float = 0.3, sources: Sequence[str] = (), languages: Sequence[str] = (), kinds: Sequence[str] = (), symbols: Sequence[str] = ()) -> DataFrame:
    """Chunks nearest to a query with score = 1 - distance of at least threshold.

    Metadata filters are applied to chunks first and semi-join the vectors, so a
    selective filter never costs hits; text is joined after the top-k.
    """
    rows = vectors.filter(F.col("source").isin(*sources)) if sources else vectors
    conditions = [F.col(c).isin(*v) for c, v in (("language", languages), ("chunk_kind", kinds)) if v]
    if symbols:
        conditions.append(F.lower("symbol").isin(*symbols))
    rowids = None
    for c in conditions:
        rowids = (chunks if rowids is None else rowids).filter(c)
    hits = knn(rows.select("rowid", "embedding"), query, top_k, "cosine", distance_where=lambda d: F.lit(1.0) - d >= threshold, rowids=None if rowids is None else rowids.select("rowid"))
    scored = hits.select("rowid", (F.lit(1.0) - F.col("distance")).alias("score"))
    return scored.join(chunks, "rowid").orderBy(F.desc("score"), "rowid")
