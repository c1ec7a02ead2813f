"""Operator 8: exact top-k by inner product with MaxScore.

Components are quantized to integers. Each sign of each component is a term, and
a shard of vectors keeps for every term its postings (the component of every
vector) and their largest impact. For a query the terms are ordered by the
highest score they can add; those whose bounds together stay under the score of
the k-th hit so far are non-essential. The essential postings are traversed, and
only vectors whose partial score plus the bound of the rest is still competitive
are probed for the other terms. Negative products only lower a score, so bounds
without them hold.

Queries and vectors are both dealt out in groups of bounded size, every group of
queries meets every group of vectors (a stated query set against all rows, in
blocks), and the shards' hits are merged by a window per query. Nothing is
broadcast.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part; vectors of different lengths compare as if padded with
zeros; rows that share the query's id are its own and no candidates; repeated
rows count each; ties go to the smaller id; extra columns are ignored; components
beyond the range of a long count as its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Of equal size, so that what both sides are copied into is least: (vectors x queries) / 4096 rows in all.
VECTORS_PER_GROUP = QUERIES_PER_GROUP = 8_192
#: Vectors of a shard scored in full to find first thresholds.
SEED = 256


def quantized(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double; null where the vector takes no part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    return F.when((F.size(v) > 0) & fine, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    if all(len(r) == width for r in rows):
        return np.stack(list(rows)).astype(np.int64) if len(rows) else np.empty((0, width), np.int64)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _exact_type(vectors: np.ndarray, queries: np.ndarray):
    """The fastest type in which every sum of products is exact."""
    biggest = max([1, *(abs(int(f(x))) for x in (vectors, queries) if x.size for f in (np.min, np.max))])
    most = vectors.shape[1] * biggest * biggest
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


class Shard:
    """Postings of a group of vectors, ready for MaxScore."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(vectors[order].T.astype(kind))
        self.highest, self.lowest = (f(self.postings, axis=1) if len(ids) else np.zeros(vectors.shape[1], kind) for f in (np.max, np.min))
        self.kind = kind

    def search(self, query: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors, best first, without those whose id is own."""
        q, n = query.astype(self.kind), len(self.ids)
        bound = np.maximum(np.maximum(q * self.highest, q * self.lowest), 0)
        seed = np.arange(0, n, max(1, n // SEED))
        seed = seed[self.ids[seed] != own]
        threshold = None
        if len(seed) >= k:
            threshold = np.sort((q @ self.postings[:, seed]).astype(np.float64 if self.kind is not object else object))[-k]
        terms = np.argsort(bound, kind="stable")
        if threshold is None:
            essential, rest = terms, terms[:0]
        else:
            reach = np.cumsum(bound[terms])
            cut = int(np.searchsorted(reach, threshold, side="left"))  # terms that together stay under the threshold
            essential, rest = terms[cut:], terms[:cut]
        scores = q[essential] @ self.postings[essential]
        hits = np.arange(n) if threshold is None else np.flatnonzero(scores + bound[rest].sum() >= threshold)
        scores = scores[hits]
        # Probe the others, highest bound first, as long as a vector stays competitive.
        for end in range(len(rest), 0, -8):
            some, left = rest[max(0, end - 8) : end], rest[: max(0, end - 8)]
            scores = scores + q[some] @ self.postings[np.ix_(some, hits)]
            stay = scores + bound[left].sum() >= threshold
            hits, scores = hits[stay], scores[stay]
        other = self.ids[hits] != own
        hits, scores = hits[other], scores[other]
        if len(hits) > k:
            least = np.partition(scores, -k)[-k]
            stay = scores >= least
            hits, scores = hits[stay], scores[stay]
        best = np.lexsort((self.ids[hits], -scores.astype(np.int64)))[:k]
        return self.ids[hits[best]], scores[best].astype(np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, per_group: int = VECTORS_PER_GROUP, queries_per_group: int = QUERIES_PER_GROUP) -> DataFrame:
    """The k best rows of vectors (vec_id, q) for each row of queries (query_id, q): query_id, rank, vec_id, score."""
    sizes = vectors.agg(F.count("q").alias("n"), F.max(F.size("q")).alias("width")).first()
    width = max(1, sizes["width"] or 1, queries.agg(F.max(F.size("q")).alias("width")).first()["width"] or 1)
    n_groups = max(1, -(-sizes["n"] // per_group))
    n_query_groups = max(1, -(-queries.count() // queries_per_group))
    asked = queries.withColumn("_row", F.monotonically_increasing_id()).withColumn("_h", F.pmod(F.xxhash64("query_id", "_row"), F.lit(n_query_groups)))
    asked = asked.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    dealt = vectors.withColumn("_g", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int"))
    dealt = dealt.withColumn("_h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_groups - 1).cast("long"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "_row": [], "vec_id": [], "score": []}).astype("int64")
        v, q = _matrix(left["q"], width), _matrix(right["q"], width)
        shard = Shard(left["vec_id"].to_numpy(np.int64), v, _exact_type(v, q))
        out = [shard.search(x, own, k) for x, own in zip(q, right["query_id"], strict=True)]
        each = [len(i) for i, _ in out]
        return pd.DataFrame({"query_id": np.repeat(right["query_id"].to_numpy(np.int64), each), "_row": np.repeat(right["_row"].to_numpy(np.int64), each), "vec_id": np.concatenate([i for i, _ in out]), "score": np.concatenate([s for _, s in out])})

    hits = dealt.groupBy("_g", "_h").cogroup(asked.groupBy("_g", "_h")).applyInPandas(meet, "query_id long, _row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "_row").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantized(F.col("embedding")).alias("q")).filter(F.col("q").isNotNull() & F.col("vec_id").isNotNull())
    asked = rows.filter(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), "q")
    return search(rows, asked)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""
