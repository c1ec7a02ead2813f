"""Operator 2: a quality classifier by nearest-neighbour voting in a latent space.

A text's terms are its words and their shapes (classes of characters, marks kept)
hashed to a fixed number of columns, and how often words repeat. Term frequencies
weighted by rarity are projected to ``TOPICS`` latent dimensions by a truncated
singular value decomposition, fitted on ``SAMPLE`` labelled documents at most
(those with the smallest hash of doc_id). Their vectors and labels, of a fixed
size (``SAMPLE`` x ``TOPICS`` floats), are broadcast with the projection. Latent
vectors are rounded to integers, so a product of ``BLOCK`` documents with all
labelled vectors is exact whatever order the sums are taken in. The labels of the
``NEIGHBOURS`` nearest are averaged with their similarities as weights.

Whole texts of all documents are scored; doc_id, lang, source and labels are no
inputs of a score. There is no shuffle of documents.

Defined cases: null and empty texts, and texts without words, get the share of
good labels in the sample; without any labels every score is 0.5; equal texts get
equal scores; neighbours as near as the last one that counts all count; rows of labels
that are null or in conflict: nulls are ignored, the smaller label of a doc_id
counts; of several texts of a labelled doc_id the one with the smallest hash is
learned; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_words, table

SAMPLE = 4096
TOPICS = 32
NEIGHBOURS = 25
SHAPES, LEXICON = 1024, 1024
#: Extra columns: words equal to the one before, words seen before, words in all.
EXTRA = 3
COLUMNS = SHAPES + LEXICON + EXTRA
#: Weight of a similarity in the vote is its power to this.
SHARPNESS = 4
BLOCK = 256
#: Latent vectors have this length before they are rounded: sums of products stay below 2^24, where 32-bit floats are exact.
UNIT = 2048

_CLASSES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "0"))


def _shape(word: str) -> str:
    for pattern, to in _CLASSES:
        word = pattern.sub(to, word)
    return word


class Terms:
    """Columns of a text's terms; what words stand for is remembered up to a bound."""

    LIMIT = 400_000

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def _columns(self, spelt: bytes) -> tuple[int, int]:
        if len(self.known) > self.LIMIT:
            self.known.clear()
        word = spelt.decode("utf-8", "surrogatepass")
        out = self.known[spelt] = (zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % SHAPES, SHAPES + zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % LEXICON)
        return out

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Columns and term frequencies (of the words in all) of a whole text; empty without words."""
        ws = byte_words(text)
        if not ws:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        n, total, known = len(ws), np.zeros(COLUMNS, np.float32), self.known
        counts = Counter(ws)
        pairs = np.array([known.get(w) or self._columns(w) for w in counts], dtype=np.int64)
        each = np.fromiter(counts.values(), np.float64, len(counts))
        for column in pairs.T:
            total += np.bincount(column, each, COLUMNS).astype(np.float32)
        total[SHAPES + LEXICON] = sum(map(bytes.__eq__, ws, ws[1:]))
        total[SHAPES + LEXICON + 1] = n - len(counts)
        total /= n
        total[-1] = min(1.0, np.log1p(n) / 10)
        at = np.flatnonzero(total)
        return at.astype(np.int32), total[at]


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), COLUMNS), np.float32)
    for i, (at, v) in enumerate(rows):
        out[i, at] = v
    return np.sqrt(out)


class Model:
    """Rarity weights, latent axes, and the labelled vectors with their labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], topics: int = TOPICS):
        self.prior = float(np.mean(labels)) if labels else 0.5
        self.labels = np.array(labels, np.float32)
        x = dense(rows)
        self.rarity = np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        # Truncated SVD by a randomized range finder with power iterations.
        a, rng = x * self.rarity, np.random.default_rng(7)
        q = rng.standard_normal((COLUMNS, min(COLUMNS, topics + 16))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(a.T @ (a @ q)) if len(rows) else (q, None)
        _, _, axes = np.linalg.svd(a @ q, full_matrices=False) if len(rows) else (None, None, np.eye(q.shape[1], dtype=np.float32))
        self.axes = np.ascontiguousarray((q @ axes.T)[:, :topics]).astype(np.float32)
        self.vectors = np.array([self.vector(*row) for row in rows], np.float32).reshape(len(rows), self.axes.shape[1])
        self.lengths = np.linalg.norm(self.vectors.astype(np.float64), axis=1)

    def vector(self, at: np.ndarray, frequency: np.ndarray) -> np.ndarray:
        """Latent vector of one document from the columns that it has, in whole numbers."""
        v = (np.sqrt(frequency) * self.rarity[at]) @ self.axes[at]
        norm = np.linalg.norm(v)
        return np.rint(v * (UNIT / norm)) if norm > 0 else np.zeros_like(v)

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        """Exact products of rounded vectors with all labelled ones, divided by their lengths."""
        lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)[:, None] * self.lengths
        products = (vectors @ self.vectors.T).astype(np.float64)
        return np.divide(products, lengths, out=np.zeros_like(products), where=lengths > 0)

    def _vote(self, cosines: np.ndarray, labels: np.ndarray) -> float:
        weight = np.maximum(cosines, 0) ** SHARPNESS
        total = weight.sum()
        return float((weight * labels).sum() / total) if total > 0 else self.prior

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        spoken = np.flatnonzero([len(at) > 0 for at, _ in rows]) if len(self.labels) else np.empty(0, int)
        for s in range(0, len(spoken), BLOCK):
            some = spoken[s : s + BLOCK]
            cosines = self.cosines(np.array([self.vector(*rows[i]) for i in some], np.float32))
            n = min(k, cosines.shape[1])
            least = np.partition(cosines, -n, axis=1)[:, -n]
            for i, c, last in zip(some, cosines, least, strict=True):
                near = np.flatnonzero(c >= last)  # those that tie with the last one count too
                out[i] = self._vote(c[near], self.labels[near])
        return np.clip(out, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents outside the held-out fold."""
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            rows = [terms.row(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["doc_id", "label", "at", "v"])

    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull())
    joined = labelled.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "label", "text")
    rows = joined.mapInArrow(run, "doc_id long, label int, at array<int>, v array<float>").filter(F.size("at") > 0).orderBy("doc_id").collect()
    return Model([(np.array(r["at"], np.int32), np.array(r["v"], np.float32)) for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), shared.value
        for b in batches:
            s = m.scores([terms.row(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
