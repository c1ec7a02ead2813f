import random

import numpy as np
import pytest
from helpers import brute_components, documents, prose
from pyspark.sql import functions as F

from lanternfish.llm import near_dedup
from lanternfish.llm.components import components


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_hard_cases_against_brute_force(spark):
    docs = documents(spark)
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = near_dedup.near_duplicates(docs)
    assert result(out) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def family(seed, size, words=120, edits=3):
    """Texts that differ in a few words from one another, some near the threshold, in chains."""
    r, text = random.Random(seed), prose(seed, words).split(" ")
    out = []
    for k in range(size):
        some = list(text)
        for _ in range(r.randrange(edits + 1)):
            some[r.randrange(words)] = f"e{seed}x{k}x{r.randrange(99)}"
        out.append(" ".join(some))
    return out


@pytest.mark.parametrize("large", [8, 64])
def test_families_near_the_threshold(spark, large):
    """Groups in which some pairs are linked and others are not; large: also by way of blocks."""
    texts = [t for s, n in ((11, 40), (12, 25), (13, 12), (14, 2)) for t in family(s, n)] + [prose(90 + i, 50) for i in range(10)]
    rows = list(enumerate(texts))
    random.Random(0).shuffle(rows)
    got = result(near_dedup.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows]), large=large))
    assert got == brute_components(rows)


def test_hot_group_of_copies(spark):
    text = prose(7, 80)
    rows = [(i, text if i % 3 else prose(1000 + i, 40), "s") for i in range(600)]
    got = result(near_dedup.near_duplicates(documents(spark, rows)))
    assert {c for i, (_, c) in got.items() if i % 3} == {1}
    assert all(c == i for i, (_, c) in got.items() if i % 3 == 0)


def test_several_texts_of_one_doc_id(spark):
    """Both texts of document 5 have near copies; every set counts, whatever row comes first."""
    a, b, c = prose(31, 60), prose(32, 90), prose(33, 70)
    rows = [(5, a, "s"), (5, b, "s"), (7, a + " more", "s"), (9, b + " more", "s"), (3, c, "s"), (11, c, "s"), (11, b + " other", "s"), (20, prose(34, 50), "s"), (5, a, "s")]
    got = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"] != 20} == {3} and {r["component_id"] for r in got if r["doc_id"] == 20} == {20}


@pytest.mark.parametrize("block", [4, 512])
def test_many_components_in_a_hot_group(spark, monkeypatch, block):
    """Families of one stem, linked inside and hardly across, that share buckets."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    stem, rows = prose(40, 150).split(" "), []
    for k in range(30):
        r = random.Random(k)
        branch = list(stem)
        for _ in range(r.randrange(4, 9)):
            branch[r.randrange(150)] = f"b{k}x{r.randrange(999)}"
        for j in range(r.randrange(1, 6)):
            leaf = list(branch)
            leaf[r.randrange(150)] = f"l{k}x{j}"
            rows.append((len(rows), " ".join(leaf)))
    got = result(near_dedup.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows]), large=6))
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) > 1


def test_least_matches_bounds_the_miss_rate():
    rng = np.random.default_rng(1)
    for n in (32, 96, 192):
        least = near_dedup.least_matches(n)
        assert 0 < least < n
        assert (rng.binomial(n, 0.85, 200_000) < least).mean() < 1e-3


def test_survivors_include_all_above_the_threshold():
    a, b = (near_dedup.signature(near_dedup.shingles(t)) for t in (prose(5, 400), " ".join([*prose(5, 400).split(" ")[:-3], "x", "y", "z"])))
    assert near_dedup.survive(a[None], b[None]).all()
    c = near_dedup.signature(near_dedup.shingles(prose(6, 400)))
    assert not near_dedup.survive(a[None], c[None]).any()


def test_keep_one_and_repeated_rows(spark):
    docs = documents(spark, [(5, "a b c d e f", "s"), (5, "a b c d e f", "s"), (2, "A b c d e f", "s"), (9, None, None), (None, "q r s", None)])
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "component_id", "n_shingles", "doc", "x.y")})
    out = near_dedup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 2), (False, 9), (True, 0)]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    assert near_dedup.keep_one(documents(spark, [(1, None, None), (2, "", None)])).count() == 2


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
