"""Operators 4 and 6 against the libraries whose files they compile."""

import random

import pytest
from helpers import documents, hard_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternfish.llm import scan
from lanternfish.llm import sentencepiece_codec as sp
from lanternfish.llm import token_counts as tc

ALPHABET = "abcdefghij ABC  123.,'\n\t 　éßñ東🙂-<|>_ thein"
TEXT = st.one_of(st.text(max_size=60), st.text(alphabet=ALPHABET, max_size=80), st.lists(st.sampled_from(["the", "ing", " ", "  ", "<|endoftext|>", "'s", "\n", "12", "tion"]), max_size=30).map("".join))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tc.tokenizer_path(tc.MODEL))


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tc.tokenizer_path(sp.MODEL))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(tokenizer, text):
    assert tc.counter(tc.tokenizer_path(tc.MODEL)).count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def _one(m):
    assert len(m) == 1
    return next(iter(m.values()))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_state_maps_compose_to_the_whole(tokenizer, text, size):
    c = tc.counter(tc.tokenizer_path(tc.MODEL))
    maps = [c.chunk_map(*x) for x in c.chunks(text, size)]
    want = len(tokenizer.encode(text, add_special_tokens=False).ids)
    if maps:
        assert _one(scan.products(maps)) == want
        left = maps[0]
        for m in maps[1:]:
            left = scan.product(left, m)
        assert _one(left) == want


def test_a_word_without_end_is_counted_by_chunks(tokenizer):
    c = tc.counter(tc.tokenizer_path(tc.MODEL))
    for text in ("a" * 3000, "thequickbrownfox" * 150, "!?" * 900, "7" * 1000, " " * 700, "\u6771" * 500):
        maps = [c.chunk_map(*x) for x in c.chunks(text, 100)]
        assert max(map(len, maps)) <= 4 * c.machine.longest**2
        assert _one(scan.products(maps)) == len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [64, 65_536])
def test_count_tokens(spark, tokenizer, chunk):
    rows = [(i, t, "s") for i, t in enumerate([*hard_texts(), "the " * 50_000])] + [(0, None, None), (None, "a b", None)]
    docs = documents(spark, rows).withColumns({c: F.lit("x") for c in ("n_bytes", "uid", "part", "a.b")})
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.count_tokens(docs, chunk=chunk).collect())
    want = []
    for i, t, _ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i is None, i or 0, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_count_tokens_of_an_empty_table(spark):
    assert tc.count_tokens(documents(spark, [])).count() == 0


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encoding_equals_the_library(model, text):
    c = sp.codec(tc.tokenizer_path(sp.MODEL))
    ids = c.encode(text)
    assert ids.tolist() == model.encode(text)
    assert c.decode(ids) == model.decode(ids.tolist())


@settings(max_examples=120, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_bpe_chunks_equal_the_whole(model, text, size):
    c = sp.codec(tc.tokenizer_path(sp.MODEL))
    whole = c.normalize(text)
    if whole:
        assert c.to_ids(c.lattice.chunked(whole, size)).tolist() == model.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc▁", min_size=1, max_size=30), st.integers(3, 7), st.integers(0, 1000))
def test_unigram_chunks_find_a_best_path(text, size, seed):
    r = random.Random(seed)
    scores = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 3))): -r.random() * 5 for _ in range(12)}
    lattice = sp.Lattice(scores, sp.UNIGRAM)
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        for n in range(1, 4):
            w = lattice._weight(text[i : i + n]) if i + n <= len(text) else None
            if w is not None:
                best[i + n] = max(best[i + n], best[i] + w)
    for pieces in (lattice.segment(text)[0], lattice.chunked(text, size)):
        assert "".join(pieces) == text
        assert sum(map(lattice._weight, pieces)) == pytest.approx(best[-1])


def test_matrix_product_is_associative():
    r = random.Random(4)
    a, b, c = ({((i, 0), (j, 0)): r.random() for i in range(3) for j in range(3) if r.random() < 0.7} for _ in range(3))
    left, right = scan.product(scan.product(a, b), c), scan.product(a, scan.product(b, c))
    assert left.keys() == right.keys()
    assert all(left[k] == pytest.approx(right[k]) for k in left)


@pytest.mark.parametrize("chunk", [64, 65_536])
def test_encode_and_decode(spark, model, chunk):
    texts = [*hard_texts(), "the  end " * 9000]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(0, None, None)]).withColumns({c: F.lit("x") for c in ("part", "begin", "_ids2", "matrix", "a.b")})
    out = sp.encode(docs, chunk=chunk)
    assert out.columns == [*docs.columns, "token_ids", "n_tokens", "decoded"]
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = model.encode(r["text"] or "")
        assert r["token_ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == model.decode(want)
    again = {(r["doc_id"], tuple(r["token_ids"])): r["decoded"] for r in sp.decode(out.drop("decoded")).collect()}
    assert all(again[r["doc_id"], tuple(r["token_ids"])] == r["decoded"] for r in rows)


def test_encode_an_empty_table(spark):
    assert sp.encode(documents(spark, [])).count() == 0
