"""Operators 2 and 10: quality by neighbours and by rules."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, documents, hard_texts, prose, split
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternfish.llm import quality_knn as qk
from lanternfish.llm import quality_rules as qr

tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def brute_counts(text):
    ws = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    gone = set()
    for i in range(len(ws) - 7):
        if windows[tuple(ws[i : i + 8])] > 1:
            gone |= set(range(i, i + 8))
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(gone)


def test_base_counts_of_hard_texts(spark):
    docs = documents(spark)
    want = {r["doc_id"]: brute_counts(r["text"]) for r in docs.collect()}
    for r in qr.score(docs).collect():
        counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert counts == want[r["doc_id"]]
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r["base_failed"] and r["kept"])


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["a", "b", " ", "\n", "#", "|", "a a a a a a a a a "]), max_size=50).map("".join)))
def test_base_counts(text):
    assert qr.base_counts(text) == brute_counts(text)


def test_compression_bands():
    import zstandard

    c = zstandard.ZstdCompressor(level=qr.LEVEL)

    def ok(text):
        return qr.compression_ok(len(text.encode()), *qr.compression(text, c))

    english = " ".join(f"{a} {b}" for a, b in zip(prose(1, 900).split(), "the quick brown fox jumps over a lazy dog and then it rests for some time".split() * 60))
    assert ok(english)
    assert not ok("buy now " * 400)
    assert not ok("".join(chr(33 + zlib.crc32(bytes([i % 256, i // 256])) % 90) for i in range(6000)))
    # A repetitive middle hides in the whole ratio and shows in the chunks.
    mostly_spam = english[:4096] + "spam and eggs " * 1200
    assert qr.compression(mostly_spam, c)[1] > qr.MAX_BAD_CHUNKS
    assert qr.compression("", c) == (None, 0.0)


def test_keep_clean(spark):
    docs = documents(spark).withColumns({c: F.lit(1) for c in ("kept", "n_words", "x.y")})
    out = qr.keep_clean(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in qr.score(docs).filter("kept").collect()}
    assert kept and {r["doc_id"] for r in out.collect()} == kept
    assert qr.keep_clean(documents(spark, [])).count() == 0 == qr.score(documents(spark, [])).count()


@tables
def test_clean_documents_stay(spark):
    """Of the documents labelled good, the rules reject few; of those labelled bad, most."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = qr.score(docs).join(labels, "doc_id").filter("quality = 1").agg(F.avg(F.col("kept").cast("double")).alias("kept")).first()
    assert rows["kept"] > 0.95


@tables
def test_held_out_accuracy(spark):
    """Rows that no label was learned from are told apart well."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = qk.score(docs, qk.fit(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(rows) > 500 and area > 0.85


def test_scores_of_hard_texts(spark):
    texts = hard_texts()
    docs = documents(spark, [(i, t, f"s{i}") for i, t in enumerate(texts * 2)] + [(None, "x", None)]).withColumns({c: F.lit(1) for c in ("label", "quality", "score", "x.y")})
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(1, 0, 0), (None, 1, 1), (2, None, 1), (3, 7, 0)], "doc_id long, quality long, toxic long")
    rows = qk.score(docs, qk.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for r in rows:
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
            assert by_text.setdefault(texts[r["doc_id"] % len(texts)], r["score"]) == r["score"]


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    docs = documents(spark)
    assert {r["score"] for r in qk.score(docs, qk.fit(docs, none)).collect()} == {0.5}
    empty = documents(spark, [])
    assert qk.score(empty, qk.fit(empty, none)).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = documents(spark, [(i, prose(i, 40 + i), "s") for i in range(60)])
    labels = [(i, i % 2) for i in range(60)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    a, b = ({r["doc_id"]: r["score"] for r in qk.score(docs, qk.fit(docs, spark.createDataFrame(x, "doc_id long, quality long"))).collect()} for x in (labels, other))
    assert a == b


def test_votes_are_exact():
    """Scores equal a plain search over all labelled vectors."""
    terms = qk.Terms()
    rows = [terms.row(prose(i, 30 + i % 17) + (" ###" * (i % 5))) for i in range(80)]
    labels = [i % 5 > 1 for i in range(80)]
    m = qk.Model(rows, [int(x) for x in labels])
    got = m.scores(rows[:10])
    vectors = [[float(x) for x in m.vector(*row)] for row in rows]
    for i in range(10):
        cosine = [sum(x * y for x, y in zip(vectors[i], v)) / math.sqrt(sum(x * x for x in v) * sum(x * x for x in vectors[i])) for v in vectors]
        last = sorted(cosine, reverse=True)[qk.NEIGHBOURS - 1]
        votes = [(max(c, 0.0) ** qk.SHARPNESS, q) for c, q in zip(cosine, labels) if c >= last - 1e-12]
        assert got[i] == pytest.approx(sum(w for w, q in votes if q) / sum(w for w, _ in votes), abs=1e-9)


def test_neighbours_that_tie_all_count():
    """Copies of one text, more than the neighbours asked for: the score is the mean of all their labels."""
    terms = qk.Terms()
    rows = [terms.row("alpha beta gamma delta")] * 40 + [terms.row(prose(i, 30)) for i in range(20)]
    labels = [1] * 10 + [0] * 30 + [1] * 20
    for order in (range(60), range(59, -1, -1)):
        m = qk.Model([rows[i] for i in order], [labels[i] for i in order])
        assert m.scores([rows[0]])[0] == pytest.approx(0.25)


def test_long_words_differ_to_their_end():
    terms = qk.Terms()
    a, b = (terms.row("x1" * 40 + end) for end in ("A", "9"))
    assert a[0].tolist() != b[0].tolist()


@tables
def test_held_out_accuracy_without_copies(spark):
    """As above, without held-out rows whose near copies stand in the other folds."""
    from lanternfish.llm import near_dedup

    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = near_dedup.keep_one(docs)
    rows = qk.score(docs, qk.fit(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(rows) > 50 and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.85


def brute_kept(text):
    """The verdict from the constants alone, compressed piece by piece."""
    import zstandard

    data = (text or "").encode("utf-8", "surrogatepass")
    counts = brute_counts(text)
    if counts[0] < 20 or 100 * counts[4] > 30 * counts[0]:
        return False

    def inside(piece, n):
        limits = [(lo, hi) for most, lo, hi in qr.BANDS if n <= most][0]
        return limits[0] <= len(zstandard.ZstdCompressor(level=qr.LEVEL).compress(piece)) / len(piece) <= limits[1]

    if not inside(data, len(data)):
        return False
    if len(data) > qr.CHUNK_BYTES:
        ends = sorted({*range(qr.CHUNK_BYTES, len(data), qr.CHUNK_BYTES), len(data)})
        if sum(not inside(data[e - qr.CHUNK_BYTES : e], qr.CHUNK_BYTES) for e in ends) > qr.MAX_BAD_CHUNKS * len(ends):
            return False
    if len(data) > qr.PIECE_BYTES:
        ends = sorted({*range(qr.PIECE_BYTES, len(data), qr.PIECE_BYTES // 2), len(data)})
        return all(inside(data[e - qr.PIECE_BYTES : e], qr.PIECE_BYTES) for e in ends)
    return True


@tables
def test_verdicts_against_brute_force(spark):
    docs = documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in docs.select("text").join(qr.score(docs.withColumn("doc_id", F.xxhash64("text"))).select("doc_id", "kept").distinct(), F.xxhash64("text") == F.col("doc_id")).collect():
        assert r["kept"] == brute_kept(r["text"])


def test_long_documents_cannot_hide_junk(spark):
    """Almost half of one letter, or a third of base85 noise, in a text that is clean otherwise."""
    import base64
    import random

    r = random.Random(4)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    clean = " ".join(r.choice(vocabulary) for _ in range(20_000))
    noise = base64.b85encode(random.Random(5).randbytes(30_400)).decode()
    texts = [clean, clean[:60_000] + " " + "x" * 49_000, clean[:60_000] + " " + noise]
    kept = {row["doc_id"] for row in qr.score(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).filter("kept").collect()}
    assert kept == {0}
