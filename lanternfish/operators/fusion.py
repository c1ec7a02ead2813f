"""Fusion of ranked lists and what follows it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Weights of modalities and of where a query came from.
MODALITY = {"vec": 1.0, "fts": 1.1}
SOURCE = {"original": 1.0, "expanded": 0.25}


def positive(weight: float | None) -> float:
    """A weight, 1 where it is missing or not positive."""
    return weight if weight and weight > 0 else 1.0


def ranked(results: DataFrame, by: Sequence, set_id, modality: str, query_source: str = "original") -> DataFrame:
    """(set_id, modality, query_source, rank, rowid) of one bounded result list; by orders it."""
    order = Window.partitionBy(F.lit(set_id)).orderBy(*by)
    return results.select(F.lit(set_id).alias("set_id"), F.lit(modality).alias("modality"), F.lit(query_source).alias("query_source"), F.row_number().over(order).alias("rank"), "rowid")


def union_all(sets: Sequence[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out


def rrf(sets: DataFrame, k: int = RRF_K, modality: dict[str, float] | None = None, source: dict[str, float] | None = None) -> DataFrame:
    """(rowid, rrf): sum of weights over k + rank for every list that holds a row; scores play no part."""
    k = k if k > 0 else RRF_K
    weigh = lambda c, table: F.coalesce(*[F.when(F.col(c) == name, positive(w)) for name, w in table.items()], F.lit(1.0))
    w = weigh("modality", modality or {"": 1.0}) * weigh("query_source", source or {"": 1.0})
    return sets.groupBy("rowid").agg(F.sum(w / (F.lit(k) + F.col("rank"))).alias("rrf"))


def min_score(results: DataFrame, least: float, column: str = "score") -> DataFrame:
    return results.filter(F.col(column) >= least) if least > 0 else results


#: Total order of fused results.
def final_order():
    return [F.desc("score"), F.asc("file_path"), F.asc("line_num"), F.asc("end_line"), F.asc("rowid")]


def blend_weights(top: float, bottom: float) -> tuple[float, float]:
    """Weights inside 0 to 1, the higher first; 0.8 and 0.2 where they are no numbers."""
    clean = [min(1.0, max(0.0, w)) if math.isfinite(w) else d for w, d in ((top, 0.8), (bottom, 0.2))]
    return max(clean), min(clean)


def rerank_blend(results: DataFrame, scores: DataFrame, order: Sequence, top_n: int = 20, top_weight: float = 0.8, bottom_weight: float = 0.2, column: str = "score") -> DataFrame:
    """Blend of retrieval scores with a reranker's 0 to 10, by position.

    results are a bounded list in the given order, of which the first top_n were
    candidates; the weight of retrieval goes linearly from top_weight at the first
    candidate to bottom_weight at the last. Rows that scores (rowid, rerank) lacks
    keep their retrieval score.
    """
    top_weight, bottom_weight = blend_weights(top_weight, bottom_weight)
    everything = Window.partitionBy(F.lit(1))
    placed = results.withColumn("pos", F.row_number().over(everything.orderBy(*order)) - 1)
    total = F.count(F.lit(1)).over(everything)
    placed = placed.withColumn("total", F.least(F.lit(top_n), total) if top_n > 0 else total)
    step = F.coalesce(F.try_divide(F.col("pos").cast("double"), F.col("total") - 1), F.lit(0.0))
    w = F.lit(top_weight) - F.lit(top_weight - bottom_weight) * step
    joined = placed.join(scores, "rowid", "left")
    blended = F.when(F.col("rerank").isNull() | (F.col("pos") >= F.col("total")), F.col(column)).otherwise(w * F.col(column) + (F.lit(1.0) - w) * F.col("rerank") / 10.0)
    return joined.withColumn(column, blended).orderBy(F.desc(column), "pos").drop("pos", "total", "rerank")
