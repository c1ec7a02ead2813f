"""Keyword search: an inverted index as tables, BM25, and staged retrieval.

A search needs, per phrase, how many documents hold it and, per document, how
often. Over a written index that is a read of the postings of the query's terms;
without one, a scan of token arrays. Phrases are literals in the plan, so one pass
yields every count; counts are kept, and statistics are one row of them that is
joined back as a scalar.
Ranking carries ids and scores only; text is joined after the limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import text as X

K1, B = 1.2, 0.75
#: Weight of a phrase that stands in half of all rows or more.
LEAST_IDF = 1e-6
COLUMNS = ("chunk_text", "language", "chunk_kind", "symbol")
FETCH_FACTOR, FETCH_MAX = 5, 5000


@dataclass(frozen=True)
class Phrase:
    """Consecutive index tokens, in all columns or in one; prefix: the last is a beginning."""

    tokens: tuple[str, ...]
    column: str | None = None
    prefix: bool = False


def phrase(text: str, column: str | None = None, prefix: bool = False) -> Phrase:
    return Phrase(tuple(X.tokenize_index(text)), column, prefix)


def index(chunks: DataFrame, key: str = "rowid") -> DataFrame:
    """(rowid, source, tokens of each column, dl): what searches read; dl counts the tokens of all columns."""
    present = [c for c in COLUMNS if c in chunks.columns]
    tokens = {c: X.index_tokens(F.col(c)) for c in present}
    out = chunks.select(F.col(key).alias("rowid"), *([F.col("source")] if "source" in chunks.columns else []), *[t.alias(f"t_{c}") for c, t in tokens.items()])
    return out.withColumn("dl", sum((F.size(f"t_{c}") for c in present[1:]), F.size(f"t_{present[0]}")))


def postings(indexed: DataFrame) -> DataFrame:
    """(term, col, rowid, positions): the inverted index as a table."""
    parts = [c for c in indexed.columns if c.startswith("t_")]
    rows = None
    for c in parts:
        here = indexed.select("rowid", F.lit(c[2:]).alias("col"), F.posexplode(c).alias("pos", "term"))
        rows = here if rows is None else rows.unionByName(here)
    return rows.groupBy("term", "col", "rowid").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def corpus_stats(indexed: DataFrame) -> DataFrame:
    """One row: n documents and their mean length."""
    return indexed.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def vocabulary(indexed: DataFrame) -> DataFrame:
    """(term, df): documents that hold each term."""
    parts = [F.col(c) for c in indexed.columns if c.startswith("t_")]
    return indexed.select("rowid", F.explode(F.array_distinct(F.concat(*parts))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class Stored:
    """An inverted index that was written: postings (source, term, col, rowid, dl, positions) sorted by term, and totals of the corpus.

    A search reads the postings of its own terms; no text is tokenized again.
    """

    rows: DataFrame
    documents: int
    tokens: int


def stored_postings(indexed: DataFrame) -> DataFrame:
    """postings with the source and length of their row, as Stored reads them."""
    extra = indexed.select("rowid", *(["source"] if "source" in indexed.columns else [F.lit("").alias("source")]), "dl")
    return postings(indexed).join(extra, "rowid").select("source", "term", "col", "rowid", "dl", "positions")


def _frequency(p: Phrase, columns: Sequence[str]) -> Column:
    where = [p.column] if p.column else columns
    counts = [X.phrase_count(F.col(f"t_{c}"), list(p.tokens), p.prefix) for c in where]
    return sum(counts[1:], counts[0])


def _hits(p: Phrase, at: int, column: str | None):
    """Condition on a posting: it is of the phrase's token ``at``, in a column."""
    token, last = p.tokens[at], at == len(p.tokens) - 1

    def fits(h: Column) -> Column:
        same = h["term"].startswith(token) if p.prefix and last else h["term"] == token
        return same if column is None else same & (h["col"] == column)

    return fits


def _minus(n: int):
    return lambda x: x - F.lit(n)


def _stored_frequency(p: Phrase) -> Column:
    """How often a phrase stands in the row whose postings are the array hits."""
    if not p.tokens:
        return F.lit(0)
    if len(p.tokens) == 1:
        return F.aggregate(F.filter("hits", _hits(p, 0, p.column)), F.lit(0), lambda s, h: s + F.size(h["positions"]))
    counts = []
    for c in [p.column] if p.column else COLUMNS:
        starts = None
        for at in range(len(p.tokens)):
            places = F.flatten(F.transform(F.filter("hits", _hits(p, at, c)), lambda h: h["positions"]))
            begun = F.transform(places, _minus(at))
            starts = begun if starts is None else F.array_intersect(starts, begun)
        counts.append(F.size(starts))
    return sum(counts[1:], counts[0])


def _kept(counted: DataFrame) -> DataFrame:
    """Counts of all rows, written to the checkpoint folder, so that texts are tokenized once for statistics and ranks.

    Without such a folder they are counted for each of the two.
    """
    return counted.checkpoint() if counted.sparkSession.sparkContext.getCheckpointDir() else counted


def _counted(indexed: DataFrame | Stored, phrases: Sequence[Phrase]) -> tuple[DataFrame, DataFrame]:
    """(rowid, source, dl, tf) of rows that hold a phrase, and one row (n, avgdl, df)."""
    frequent = F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(phrases))]).alias("df")
    if isinstance(indexed, Stored):
        begins = [p.tokens[-1] for p in phrases if p.prefix and p.tokens]
        terms = sorted({t for p in phrases for t in (p.tokens[:-1] if p.prefix else p.tokens)})
        wanted = F.col("term").isin(*terms) if terms else F.lit(False)
        for b in sorted(set(begins)):
            wanted = wanted | F.col("term").startswith(b)
        rows = indexed.rows.filter(wanted).groupBy("rowid", "source", "dl").agg(F.collect_list(F.struct("term", "col", "positions")).alias("hits"))
        counted = rows.select("rowid", "source", "dl", F.array(*[_stored_frequency(p) for p in phrases]).alias("tf"))
        n = F.lit(indexed.documents).cast("long").alias("n")
        return counted, counted.agg(frequent).select(n, F.lit(indexed.tokens / max(1, indexed.documents)).alias("avgdl"), "df")
    columns = [c[2:] for c in indexed.columns if c.startswith("t_")]
    extra = ["source"] if "source" in indexed.columns else []
    counted = _kept(indexed.select("rowid", *extra, "dl", F.array(*[_frequency(p, columns) for p in phrases]).alias("tf")))
    return counted, counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), frequent)


def _weighed(indexed: DataFrame | Stored, phrases: Sequence[Phrase], sources: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """Rows that hold a phrase with the statistics at hand, and each phrase's part of their BM25."""
    counted, stats = _counted(indexed, phrases)
    # One row of a fixed size; its broadcast is bounded by the number of phrases.
    joined = counted.filter(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats))
    shape = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
    parts = []
    for k in range(len(phrases)):
        raw = F.ln((F.col("n") - F.col("df")[k] + 0.5) / (F.col("df")[k] + 0.5))
        parts.append(F.when(raw > 0, raw).otherwise(LEAST_IDF) * (F.col("tf")[k] * (K1 + 1)) / (F.col("tf")[k] + shape))
    return (joined.filter(F.col("source").isin(*sources)) if sources else joined), parts


def _rank(parts: Sequence[Column]) -> Column:
    return -sum(parts[1:], parts[0])


def score(indexed: DataFrame | Stored, phrases: Sequence[Phrase], keep=None, sources: Sequence[str] = ()) -> DataFrame:
    """(rowid, rank, tf): BM25 of rows that ``keep`` (a condition on the array tf of phrase counts) lets through.

    rank is negative, best first. Counts of rows and of rows per phrase are over
    the whole index, whatever sources the result is restricted to.
    """
    phrases = [p for p in phrases if p.tokens]
    if not phrases:
        rows = indexed.rows if isinstance(indexed, Stored) else indexed
        return rows.select("rowid", F.lit(0.0).alias("rank"), F.array().cast("array<int>").alias("tf")).limit(0)
    rows, parts = _weighed(indexed, phrases, sources)
    out = rows if keep is None else rows.filter(keep(F.col("tf")))
    return out.select("rowid", _rank(parts).alias("rank"), "tf")


def all_of(n: int):
    return lambda tf: F.forall(F.slice(tf, 1, n), lambda x: x > 0)


def any_of(n: int):
    return lambda tf: F.exists(F.slice(tf, 1, n), lambda x: x > 0)


def top(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy("rank", "rowid").limit(limit)


def display_score(rank: Column) -> Column:
    return F.abs(rank) / (F.abs(rank) + 1)


def filter_phrases(languages: Sequence[str] = (), kinds: Sequence[str] = (), symbols: Sequence[str] = ()) -> list[list[Phrase]]:
    """Phrases of a metadata filter: any in a group, all groups."""
    groups = (("language", languages), ("chunk_kind", kinds), ("symbol", symbols))
    return [[phrase(v, c) for v in values if v.strip()] for c, values in groups if any(v.strip() for v in values)]


def staged(indexed: DataFrame | Stored, query: str, top_k: int, filters: list[list[Phrase]] = (), sources: Sequence[str] = (), compat_filter_precedence: bool = False) -> DataFrame:
    """(rowid, stage, rank, score): all terms, then any term, then any beginning of one.

    A later stage counts only while earlier ones have fewer than top_k rows; a
    row keeps its first stage. Filters hold for the whole clause;
    with ``compat_filter_precedence`` they bind to the last term of stages 2 and 3.
    A query without terms ranks by its filters alone. Phrases of all stages are
    counted in one pass, and a row is ranked for each stage that it belongs to.
    """
    terms = X.tokenize_query(query)
    narrow = [p for g in filters for p in g]
    limit = min(FETCH_FACTOR * top_k, FETCH_MAX)
    k = len(terms)
    phrases = [*[phrase(t) for t in terms], *[phrase(t, prefix=True) for t in terms], *narrow]
    if not phrases:
        return score(indexed, []).select("rowid", F.lit(1).alias("stage"), "rank", F.lit(0.0).alias("score"))
    weighed, parts = _weighed(indexed, phrases, sources)
    has = [F.col("tf")[i] > 0 for i in range(len(phrases))]
    fits, at = F.lit(True), 2 * k
    for g in filters:
        fits = fits & reduce(or_, has[at : at + len(g)])
        at += len(g)

    def loose(held: Sequence[Column]) -> Column:
        if not (compat_filter_precedence and filters):
            return reduce(or_, held) & fits
        return reduce(or_, held[:-1], F.lit(False)) | (held[-1] & fits)

    exact, begun, rest = parts[:k], parts[k : 2 * k], parts[2 * k :]
    if terms:
        stages = [(reduce(and_, has[:k]) & fits, exact + rest), (loose(has[:k]), exact + rest), (loose(has[k : 2 * k]), begun + rest)]
    else:
        stages = [(fits, rest)]
    member = [F.when(held, F.struct(F.lit(number).alias("stage"), _rank(p).alias("rank"))) for number, (held, p) in enumerate(stages, 1)]
    rows = weighed.select("rowid", F.inline(F.filter(F.array(*member), lambda m: m.isNotNull())))
    best = Window.partitionBy("stage").orderBy("rank", "rowid")
    rows = rows.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= limit).drop("nth")
    first = Window.partitionBy("rowid").orderBy("stage")
    rows = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    # At most three limits' worth of rows from here on. A stage runs if those before it fell short.
    lead = F.count(F.lit(1)).over(Window.orderBy("stage").rangeBetween(Window.unboundedPreceding, -1))
    live = rows.withColumn("before", lead).filter(F.col("before") < top_k)
    return live.orderBy("stage", "rank", "rowid").limit(top_k).select("rowid", "stage", "rank", display_score(F.col("rank")).alias("score"))
