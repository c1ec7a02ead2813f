"""Operator 3: near-duplicates by MinHash with sequential Bayesian verification.

1. Each document becomes its set of shingles, a signature of ``HASHES`` minima,
   and bucket keys of its bands. Documents with equal sets are one node from here on.
2. Candidates come from buckets, in three rounds. Every member of a bucket meets
   the bucket's smallest member. Members that turn out not to be linked to it
   meet the likeliest of the others. Then, only in buckets that still hold several
   components, all members outside the largest meet all others of a different
   component. So a group of copies costs in proportion to its size, and pairs
   whose components already agree are never formed. Small buckets meet inside a
   task; large ones are joined into groups that meet in blocks, where pairs are
   compared and confirmed without leaving the task.
3. Signatures are compared in batches. After each batch a pair is pruned if the
   posterior probability that its similarity reaches the threshold (uniform prior)
   is under ``MISS``.
4. Survivors are confirmed on their full sets.
5. Links are joined into components by rounds of stars (``components``).

Bands are as long as a pair at the threshold may share no bucket with a probability
of ``NO_BUCKET`` at most: 32 of 6 for 0.85, 38 of 5 for 0.80. A bucket that holds a third of all documents is dealt out as
blocks; nothing is capped, broadcast or collected.

Defined cases: null texts and texts without words have an empty set and are
linked with nothing; shorter texts than a shingle are one shingle; rows with the
same doc_id are one document, and all their sets count as linked with each other; extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, grams, lean, materialize, may_be_in, mix64, table, word_hashes
from .components import components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-7
NO_BUCKET = 3e-7
#: Buckets over this size meet in blocks of about so many documents.
LARGE, BLOCK, BLOCK_BYTES = 64, 512, 1 << 23

_RNG = np.random.default_rng(20240501)
_A = (_RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    h = word_hashes(text, lower=True)
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(grams(h, n)) if len(h) >= n else grams(h, len(h)) + np.uint64(len(h))


def set_key(s: np.ndarray) -> bytes:
    """160 bits that are equal where sets are."""
    with np.errstate(over="ignore"):
        return b"".join(int(x).to_bytes(8, "big") for x in (mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))) + len(s).to_bytes(4, "big")


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        part = low[i : i + 2048, None] * _A[None, :]
        part += _B[None, :]
        np.minimum(out, part.min(axis=0), out=out)
    return out


@cache
def banding(percent: int = PERCENT) -> tuple[int, int]:
    """(bands, rows) with the most rows at which a pair at the threshold misses all buckets with ``NO_BUCKET`` at most."""
    for n in range(ROWS, 1, -1):
        if (1 - (percent / 100) ** n) ** (HASHES // n) <= NO_BUCKET:
            return HASHES // n, n
    return HASHES, 1


def band_keys(sig: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    bands, n = banding(percent)
    rows = sig[: bands * n].reshape(bands, n).astype(np.uint64)
    acc = np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return acc.view(np.int64)


@cache
def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest matches of n with which P(similarity >= threshold | matches) is at least ``miss``."""
    s, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def survive(a: np.ndarray, b: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Mask of the pairs (rows of a and b) that no batch of signatures prunes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for end in range(BATCH, HASHES + 1, BATCH):
        matches = matches + (a[alive, end - BATCH : end] == b[alive, end - BATCH : end]).sum(axis=1)
        stay = matches >= least_matches(end, percent, miss)
        alive, matches = alive[stay], matches[stay]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _sigs(column) -> np.ndarray:
    """Signatures of one byte a hash: chance adds matches and never takes any, so pruning by them is as safe."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, HASHES)


def features(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, key, sig, bands): key is equal where sets are equal, sig has the low byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, sigs, bands = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, shingle)
                n.append(len(s))
                keys.append(set_key(s))
                sig = signature(s) if len(s) else None
                sigs.append(sig.astype(np.uint8).tobytes() if len(s) else None)
                bands.append(band_keys(sig, percent) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "sig", "bands"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, key binary, sig binary, bands array<long>")


def _pruned(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sequential comparison of their signatures leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                stay = survive(_sigs(b.column(2).to_pylist()), _sigs(b.column(3).to_pylist()), percent)
                yield b.select([0, 1]).filter(pa.array(stay))

    left, right = (sigs.select(F.col("doc").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lean(run), "a long, b long")


def linked(p: np.ndarray, q: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets, sorted, reach the threshold."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stay = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                stay.append(linked(p, q, percent))
            yield b.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    left, right = (sets.select(F.col("doc").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a long, b long")


def _likely(x: tuple, k: int, y: tuple, percent: int) -> np.ndarray:
    """Places of y = (docs, sizes, components, signatures) that may be linked to the k-th of x, in other components."""
    at = np.flatnonzero((y[2] != x[2][k]) & (100 * np.minimum(x[1][k], y[1]) >= percent * np.maximum(x[1][k], y[1])))
    return at[survive(np.broadcast_to(x[3][k], (len(at), HASHES)), y[3][at], percent)] if len(at) else at


def _rows(b: pa.RecordBatch, *names: str):
    return zip(*[b.column(n).to_pylist() for n in names], strict=True)


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _small_pairs(rows: DataFrame, sigs: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidate pairs (a, b) of buckets that fit a task: rows (bucket, doc, n, comp, minor); minor rows meet all rows of other components."""
    full = rows.join(sigs, "doc").select("bucket", "doc", "n", "comp", "minor", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> list[tuple[int, int]]:
            minor = [k for k, r in enumerate(held) if r[4]]
            if len(held) < 2 or not minor:
                return []
            y = tuple(np.array([r[k] for r in held], dtype=np.int64) for k in (1, 2, 3)) + (_sigs([r[5] for r in held]),)
            found = []
            for k in minor:
                at = _likely(y, k, y, percent)
                if best and len(at) > 1:
                    at = at[[np.argmax((y[3][at] == y[3][k]).sum(axis=1))]]
                found += [(min(y[0][k], d), max(y[0][k], d)) for d in y[0][at]]
            return found

        for b in batches:
            found = []
            for r in _rows(b, "bucket", "doc", "n", "comp", "minor", "sig"):
                if held and held[0][0] != r[0]:
                    found += close()
                    held.clear()
                held.append(r)
            yield _pair_batch(found)
        yield _pair_batch(close())

    return full.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "a long, b long").distinct()


def _block_links(rows: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside groups of any size: rows (group, doc, n, comp, minor).

    A group meets in blocks: those of its minor documents with those of all of
    them. A block holds ``BLOCK`` documents and ``BLOCK_BYTES`` of sets, about. Pairs
    are confirmed where they meet and never leave the task; of the links that join
    the same two components one is enough.
    """

    def blocks(which) -> Column:
        shingled = F.sum(F.when(which, F.col("n")).otherwise(0)) * F.lit(8 / BLOCK_BYTES)
        return F.ceil(F.greatest(F.lit(1.0), F.count_if(which) / F.lit(BLOCK), shingled)).cast("int")

    sizes = rows.groupBy("group").agg(blocks(F.col("minor")).alias("minors"), blocks(F.lit(True)).alias("blocks"))
    full = rows.join(sizes, "group").join(sigs, "doc").join(sets, "doc")
    names = ("doc", "n", "comp", "sig", "shingles")
    mine, place = (F.pmod(F.xxhash64("doc"), F.col(c)).cast("int") for c in ("minors", "blocks"))
    left = full.filter("minor").withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", "i", "j", *names)
    right = full.withColumn("j", place).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minors") - 1))).select(*[F.col(c).alias(f"{c}_y") for c in ("group", "i", "j", *names)])

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(p) and len(q):
            x = tuple(p[c].to_numpy() for c in ("doc", "n", "comp")) + (_sigs(p["sig"]),)
            y = tuple(q[f"{c}_y"].to_numpy() for c in ("doc", "n", "comp")) + (_sigs(q["sig_y"]),)
            xs, ys = ([np.frombuffer(b, np.uint64) for b in c] for c in (p["shingles"], q["shingles_y"]))
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for k in range(len(p)):
                for d in _likely(x, k, y, percent):
                    a, b = find(int(x[2][k])), find(int(y[2][d]))
                    if a != b and linked(xs[k], ys[d], percent):
                        root[max(a, b)] = min(a, b)
                        found.append((min(x[0][k], y[0][d]), max(x[0][k], y[0][d])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return left.groupBy("group", "i", "j").cogroup(right.groupBy("group_y", "i_y", "j_y")).applyInPandas(meet, "a long, b long")


def find_links(found: DataFrame, docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(links between the smallest documents of different sets, those documents by set key).

    The links hold every pair at the threshold up to what their components
    already say: pairs inside a component need no link of their own.
    """
    groups = materialize(found.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc")), "sets")
    placed = found.join(groups, "key")
    nodes = placed.filter(F.col("doc_id") == F.col("doc")).dropDuplicates(["key"]).select("doc", F.col("n_shingles").alias("n"), "sig", "bands")
    # A doc_id with several texts ties the sets of all of them.
    tied = placed.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("other")).filter("a < other").select("doc_id", "a")
    ties_of_ids = placed.join(tied, "doc_id").filter("doc > a").select("a", F.col("doc").alias("b"))
    in_bands = nodes.select("doc", "n", F.explode("bands").alias("bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.count("doc").alias("size")).filter("size > 1")
    members = materialize(in_bands.join(buckets, "bucket"), "members")
    involved = members.select("doc").distinct()
    sigs = materialize(nodes.select("doc", "sig").join(involved, "doc", "left_semi"), "sigs")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                sets = [shingles(t, shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_key(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc", "key", "shingles"])

    texts = may_be_in(docs.select(F.col("doc_id").alias("doc"), "text"), involved).join(involved, "doc", "left_semi")
    sets = materialize(texts.mapInArrow(lean(to_sets), "doc long, key binary, shingles binary").dropDuplicates(["doc", "key"]).drop("key"), "shingles")

    # Every member against its bucket's smallest.
    stars = members.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    first = materialize(_confirmed(_pruned(stars, sigs, percent), sets, percent).distinct(), "links")

    # Members of small buckets not linked to it, against the likeliest of the others.
    ties = first.select(F.col("a").alias("pivot"), F.col("b").alias("doc"), F.col("a").alias("to"))
    others = members.filter(f"doc <> pivot AND size > 2 AND size <= {int(large)}").join(ties, ["pivot", "doc"], "left").select("bucket", "doc", "n", F.coalesce("to", "doc").alias("comp"), F.col("to").isNull().alias("minor"))
    strays = others.filter("minor").select("bucket").distinct()
    second = materialize(_confirmed(_small_pairs(others.join(strays, "bucket", "left_semi"), sigs, percent, True), sets, percent), "links")

    # Whatever may still join two components: in small buckets,
    joined = components(first.union(second).union(ties_of_ids)).withColumnRenamed("node", "doc")
    now = materialize(members.join(joined, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).select("bucket", "pivot", "size", "doc", "n", "comp"), "now")
    third = _confirmed(_small_pairs(_several(now.filter(f"size > 2 AND size <= {int(large)}").select("bucket", "doc", "n", "comp"), "bucket"), sigs, percent, False), sets, percent)

    # and in the groups that large buckets form together, each document once.
    wide = materialize(now.filter(f"size > {int(large)}"), "wide")
    together = components(wide.select(F.col("pivot").alias("a"), F.col("doc").alias("b"))).select(F.col("node").alias("doc"), F.col("component").alias("group"))
    rows = wide.select("doc", "n", "comp").distinct().join(together, "doc").select("group", "doc", "n", "comp")
    met = materialize(_several(rows, "group"), "groups")
    fourth = _block_links(met, sigs, sets, percent)
    links = materialize(first.union(second).union(third).union(fourth).union(ties_of_ids), "all_links")
    discard(members, sigs, sets, first, second, now, wide, met)
    return links, groups


def _several(rows: DataFrame, key: str) -> DataFrame:
    """rows of keys that hold several components, with minor marking those outside the largest."""
    parts = rows.groupBy(key, "comp").agg(F.count("doc").alias("c")).groupBy(key).agg(F.count("comp").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("major"))
    return rows.join(parts.filter("comps > 1").select(key, "major"), key).withColumn("minor", F.col("comp") != F.col("major")).drop("major")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, large: int = LARGE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    found = materialize(features(docs.select("doc_id", "text"), shingle, percent), "features")
    links, groups = find_links(found, docs, percent, shingle, large)
    same = groups.join(components(links).withColumnRenamed("node", "doc"), "doc", "left").select("key", F.coalesce("component", "doc").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "key").join(same, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose document is the one that its component keeps, with all their columns."""
    gone = near_duplicates(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
runs AS (
  SELECT doc_id, k, n, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
sets AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE k <= n - 4 OR (n < 5 AND k = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
SELECT d.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id
"""
