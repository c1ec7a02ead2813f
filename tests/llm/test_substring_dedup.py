import hashlib
import random

import numpy as np
import pytest
from helpers import brute_removed, documents, prose, split
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternfish.llm import substring_dedup as sd


def digests(rows):
    return {i: (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (n, kept) in brute_removed(rows).items()}


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_hard_cases_against_brute_force(spark):
    docs = documents(spark)
    assert result(sd.digest(docs)) == digests([(r["doc_id"], r["text"]) for r in docs.collect()])


def collage(seed, n, vocabulary):
    """Documents pasted from shared passages of all lengths around a window, and texts over few words."""
    r = random.Random(seed)
    pool = [prose(seed * 100 + k, r.choice((5, 12, 13, 14, 20, 60)), vocabulary).split(" ") for k in range(12)]
    out = []
    for k in range(n):
        ws = []
        for _ in range(r.randrange(1, 8)):
            p = r.choice(pool)
            a = r.randrange(len(p)) if r.random() < 0.3 else 0
            ws += p[a:] + [f"u{r.randrange(3)}"] * r.randrange(3)
        out.append((r.randrange(10**6) * 1000 + k, " ".join(ws)))
    return out


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 4000), (2, 3), (3, 1)])
def test_collages_against_brute_force(spark, seed, vocabulary):
    rows = collage(seed, 60, vocabulary)
    got = result(sd.digest(documents(spark, [(i, t, "s") for i, t in rows]).repartition(5), chars=2000))
    assert got == digests(rows)


def test_hot_passage(spark):
    passage = prose(50, 40)
    rows = [(i, f"{prose(5000 + i, 20)} {passage} {prose(9000 + i, 15)}") for i in range(400)]
    got = result(sd.digest(documents(spark, [(i, t, "s") for i, t in rows])))
    assert got == digests(rows)
    assert got[0][1] == 0 and got[1][1] == 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=6))
def test_runs_of_equal_windows_meet(texts):
    """Equal windows have equal anchors, and runs of one class have the same windows."""
    from lanternfish.llm.common import grams, word_hashes

    seen = {}
    for ws in texts:
        h = word_hashes(" ".join(ws))
        first, size, anchor, cls = sd.runs(h)
        assert size.sum() == max(0, len(ws) - sd.WINDOW + 1)
        g = grams(h, sd.WINDOW)
        for f, n, a, c in zip(first, size, anchor, cls, strict=True):
            assert seen.setdefault(("class", int(c)), tuple(g[f : f + n])) == tuple(g[f : f + n])
            for w in g[f : f + n]:
                assert seen.setdefault(("window", int(w)), int(a)) == int(a)


def test_remove_repeats_keeps_columns_and_layout(spark):
    shared = prose(3, 20)
    rows = [(1, f"first  row\n{shared}\nend", "s"), (2, f"other\tline\n{shared}\n last  words ", "s"), (3, None, "s"), (4, "untouched  text ", None)]
    docs = documents(spark, rows).withColumns({c: F.lit(i) for i, c in enumerate(("mark", "doc", "passages", "start", "x.y"))})
    out = sd.remove_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[1][0] == rows[0][1] and got[3] == (None, None) and got[4][0] == "untouched  text "
    assert split(got[2][0]) == ["other", "line", "last", "words"] and got[2][1] == len(got[2][0])


def test_repeated_rows_and_null_ids(spark):
    text = prose(9, 30)
    docs = documents(spark, [(4, text, "s"), (4, text, "s"), (None, text, "s"), (6, text, "s")])
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in sd.digest(docs).collect())
    assert got == [(-1, 0), (4, 0), (4, 0), (6, 30)]


def test_empty_table(spark):
    assert sd.digest(documents(spark, [])).count() == 0
    assert sd.remove_repeats(documents(spark, [])).count() == 0


def test_cut():
    gone = np.array([False, True, True, False])
    assert sd.cut(" a b  c\nd ", gone) == " a d "
    assert sd.cut("a b c d", np.array([True, False, False, True])) == "b c"
    assert sd.cut("a b", np.array([True, True])) == ""
