"""Operator 9: substring dedup with repeated-phrase automata.

A window is ``WINDOW`` consecutive words. A word goes if a window that covers it
also starts in a document with a smaller doc_id.

1. Passages. The windows of a document fall into runs that share an anchor: the
   least hash of the ``ANCHOR``-word phrases in the window. Equal windows have
   equal anchors wherever they stand, so only runs meet, about one for four words,
   and a run whose anchor is found in one document alone is done with.
2. Confirmation. Equal runs are counted as one class with its smallest doc_id. A
   run in any later document recurs as a whole. Only where an anchor has several
   classes can a window of a class's first document recur on its own; those
   windows are counted one by one. Minima are combined before each shuffle, and
   the joins back are ordinary equi-joins that Spark splits where one is hot.
3. Location. The joins of step 2 place every passage in its documents; were all
   passages of a corpus in automata and all documents streamed through each, work
   would grow with the square of the corpus. So each block of documents
   (``BLOCK_CHARS`` characters) is a shard: its passages are compiled, neighbouring
   windows as one passage and each word as one letter, into an Aho-Corasick
   automaton, and every document of the block is streamed through it to find all
   occurrences. An automaton has no more states than its block has words.

Runs are told apart by 96 bits of hash and windows by 128 bits of two independent
hashes; the words of a passage are compared inside a block only.

Defined cases: null, empty and shorter texts than a window lose nothing; repeated
rows of one doc_id don't remove each other; extra columns are ignored by
``digest`` and kept by ``remove_repeats``; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, by_place, byte_words, discard, grams, lean, map_by_place, materialize, mix64, table, word_hashes

WINDOW = 13
ANCHOR = 7
BLOCK_CHARS = 1_500_000
_WORD = re.compile(WORD)


def runs(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor, class) of each run of windows that share an anchor; h: words' hashes."""
    m = len(h) - window + 1
    if m <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    g, width = grams(h, anchor), window - anchor + 1
    least, span = g, 1
    while span < width:  # the least of ``span`` neighbours, then of as many more as still fit
        step = min(span, width - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    size = np.diff(np.concatenate([first, [m]]))
    place = np.arange(m) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        parts = mix64(grams(h, window) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        cls = mix64(np.add.reduceat(parts, first) + size.astype(np.uint64))
    return first, size, least[first].view(np.int64), cls.view(np.int64)


def _text_mark(text: str) -> int:
    """Tells rows of one doc_id with different texts apart."""
    import xxhash

    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 31)


def _classes(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, cls, lo, hi): smallest and largest doc_id of each class, combined in each batch before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(np.full(len(r[0]), i, np.int64), r[2], r[3]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and i is not None and len((r := runs(word_hashes(t), window, anchor))[0])]
            if not found:
                continue
            doc, a, c = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, c, a))
            doc, a, c = doc[order], a[order], c[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
            at = np.flatnonzero(new)
            end = np.concatenate([at[1:], [len(doc)]]) - 1
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(c[at]), pa.array(doc[at]), pa.array(doc[end])], ["anchor", "cls", "lo", "hi"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "anchor long, cls long, lo long, hi long")


def _recurring(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(low32, cls, first, mixed): classes to look at again, their smallest doc_id, and whether their anchor has other classes."""
    by_class = _classes(docs, window, anchor).repartition("anchor").groupBy("anchor", "cls").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Dealt out by anchor already: neither of these two moves data again.
    by_anchor = by_class.groupBy("anchor").agg(F.count("cls").alias("classes"), F.min("lo").alias("a_lo"), F.max("hi").alias("a_hi"))
    several = (F.col("classes") > 1) & (F.col("a_lo") < F.col("a_hi"))
    kept = by_class.join(by_anchor, "anchor").filter((F.col("lo") < F.col("hi")) | several)
    return kept.select(F.shiftright(F.shiftleft("anchor", 32), 32).cast("int").alias("low32"), "cls", F.col("lo").alias("first"), several.alias("mixed"))


def _places(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(low32, cls, doc, mark, start, size) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                rows = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if t and i is not None and len((r := runs(word_hashes(t), window, anchor))[0]):
                        n = len(r[0])
                        rows.append((r[2].astype(np.int32), r[3], np.full(n, i, np.int64), np.full(n, _text_mark(t), np.int32), r[0].astype(np.int32), r[1].astype(np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["low32", "cls", "doc", "mark", "start", "size"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "low32 int, cls long, doc long, mark int, start int, size int")


def _marked(docs: DataFrame) -> DataFrame:
    """(doc, mark, text) of documents with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_text_mark(t) for t in b.column(1).to_pylist()], pa.int32()), b.column(1)], ["doc", "mark", "text"])

    return docs.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).mapInArrow(lean(run), "doc long, mark int, text string")


def _windows(marked: DataFrame, doubtful: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc, mark, start): each window of the doubtful runs (doc, mark, start, size)."""
    lists = doubtful.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "size")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, mark, text, rs in zip(*(b.column(x).to_pylist() for x in ("doc", "mark", "text", "runs")), strict=True):
                h = word_hashes(text)
                at = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["size"]) for r in rs]))
                w1, w2 = grams(h, window), grams(word_hashes(text, other=True), window)
                yield pa.RecordBatch.from_arrays([pa.array(w1[at].view(np.int64)), pa.array(w2[at].view(np.int64)), pa.array(np.full(len(at), i, np.int64)), pa.array(np.full(len(at), mark, np.int32)), pa.array(at.astype(np.int32))], ["w1", "w2", "doc", "mark", "start"])

    return marked.join(lists, ["doc", "mark"]).mapInArrow(lean(run), "w1 long, w2 long, doc long, mark int, start int")


def passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, mark, start, size, first): runs of windows of a document that start in the earlier document ``first``."""
    recurring = materialize(_recurring(docs, window, anchor), "recurring")
    placed = materialize(_places(docs, window, anchor).join(recurring, ["low32", "cls"]).filter((F.col("doc") > F.col("first")) | F.col("mixed")).select("doc", "mark", "start", "size", "first"), "placed")
    discard(recurring)
    whole = placed.filter(F.col("doc") > F.col("first"))
    doubtful = placed.filter(F.col("doc") == F.col("first")).select("doc", "mark", "start", "size")
    singles = materialize(_windows(_marked(docs), doubtful, window), "windows")
    least = singles.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    alone = singles.join(least, ["w1", "w2"]).filter(F.col("doc") > F.col("first")).select("doc", "mark", "start", F.lit(1).alias("size"), "first")
    return whole.unionByName(alone)


def _merged(start: np.ndarray, size: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(first window, windows, largest first) of a document's runs, neighbouring ones as one."""
    order = np.argsort(start, kind="stable")
    start, size, first = start[order], size[order], first[order]
    at = np.flatnonzero(np.concatenate([[True], start[1:] > np.maximum.accumulate(start + size)[:-1]]))
    ends = np.maximum.reduceat(start + size, at)
    return list(zip(start[at].tolist(), (ends - start[at]).tolist(), np.maximum.reduceat(first, at).tolist(), strict=True))


class _Letters(dict):
    """A letter for each word of a block, so that a document is a string and a passage a substring."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        letter = self[word] = chr(n if n < 0xD800 else n + 0x800)
        return letter


def _automaton(block: list[tuple[int, str, list]], window: int):
    """Aho-Corasick automaton of a block's passages, each with the last of the documents that its windows start in."""
    import ahocorasick

    latest: dict[str, int] = {}
    for _, text, found in block:
        for start, size, first in found:
            passage = text[start : start + size + window - 1]
            if len(passage) == size + window - 1:
                latest[passage] = min(first, latest.get(passage, first))
    if not latest:
        return None
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for passage, first in latest.items():
        machine.add_word(passage, (len(passage), first))
    machine.make_automaton()
    return machine


def removed(block: list[tuple[int, str | None, list]], window: int = WINDOW) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
    """Words of each document (doc_id, text, merged runs) of a block, and the mask of those that go (None: none).

    Every document is streamed through the automaton; a passage goes where it is
    found in a document later than all those that its windows start in.
    """
    letters = _Letters()
    split = [byte_words(t) for _, t, _ in block]
    spelled = [(i, "".join(map(letters.__getitem__, ws)), found) for (i, _, found), ws in zip(block, split, strict=True)]
    machine = _automaton(spelled, window)
    for (doc, text, _), ws in zip(spelled, split, strict=True):
        gone = None
        if machine is not None and len(ws) >= window and doc is not None:
            # Occurrences are counted as they come: a list of them could be far longer than the text.
            edge: list[int] = []
            for e, (n, first) in machine.iter(text):
                if first < doc:
                    edge = edge or [0] * (len(ws) + 1)
                    edge[e + 1 - n] += 1
                    edge[e + 1] -= 1
            if edge:
                gone = np.cumsum(edge[:-1]) > 0
        yield ws, gone


def _located(docs: DataFrame, found: DataFrame, id_at: int, text_at: int) -> DataFrame:
    """docs, with columns named by place, and the column passages of each row."""
    names = docs.columns
    lists = found.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "size", "first")).alias("passages"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_text_mark(t or "") for t in b.column(text_at).to_pylist()], pa.int32())], [*names, "_mark"])

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "_mark int"])
    rows = docs.mapInArrow(lean(mark), fields)
    return rows.join(lists, (rows[names[id_at]] == lists["doc"]) & (rows["_mark"] == lists["mark"]), "left").select(*[rows[n] for n in names], "passages")


def _blocks(b: pa.RecordBatch, id_at: int, text_at: int, chars: int):
    """Slices of a batch with about ``chars`` characters each, and their rows for ``removed``."""
    ids, texts, lists = b.column(id_at).to_pylist(), b.column(text_at).to_pylist(), b.column(b.num_columns - 1)
    offsets, there = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
    start, size, first = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    found = [_merged(start[o:e], size[o:e], first[o:e]) if v and e > o else [] for o, e, v in zip(offsets, offsets[1:], there, strict=False)]
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or k == len(texts) - 1:
            yield b.slice(begin, k + 1 - begin), list(zip(ids[begin : k + 1], texts[begin : k + 1], found[begin : k + 1], strict=True))
            begin, held = k + 1, 0


def _kept(ws: list[bytes], gone: np.ndarray | None) -> bytes:
    return b" ".join(ws if gone is None else [w for w, g in zip(ws, gone.tolist(), strict=True) if not g])


def digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block in _blocks(b, 0, 1, chars):
                rows = [(len(ws), 0 if gone is None else int(gone.sum()), hashlib.sha256(_kept(ws, gone)).hexdigest()) for ws, gone in removed(block, window)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _located(by_place(slim), passages(slim, window, anchor), 0, 1).mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: str, gone: np.ndarray) -> str:
    """A text without its marked words; each goes with the white space after it, or before it at the end."""
    keep, at = [], 0
    spans = [m.span() for m in _WORD.finditer(text)]
    for k, (a, b) in enumerate(spans):
        end = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        if k == 0 and a:
            keep.append(text[:a])
        if not gone[k]:
            keep.append(text[a:end])
        at = b
    return "".join(keep).rstrip("\t\n\v\f\r ") if len(gone) and gone[-1] else "".join(keep) if spans else text[at:]


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with repeated passages cut out of text, and n_chars, if there, the new length."""
    names = docs.columns
    id_at, text_at = names.index("doc_id"), names.index("text")
    n_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block in _blocks(b, id_at, text_at, chars):
                texts = [t if t is None or gone is None else cut(t, gone) for (_, t, _), (_, gone) in zip(block, removed(block, window), strict=True)]
                columns = list(part.columns[:-1])
                if n_at is not None:
                    was = columns[n_at].to_pylist()
                    columns[n_at] = pa.array([n if t is None or t == old else len(t) for n, t, (_, old, _) in zip(was, texts, block, strict=True)], columns[n_at].type)
                columns[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_by_place(_located(by_place(docs), passages(docs, window, anchor), id_at, text_at), lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


_LEADS = ", ".join(f"lead(word, {i}) OVER o" for i in range(1, WINDOW))

ORACLE_SQL = rf"""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM lists),
windows AS (SELECT doc_id, k, n, concat_ws(' ', word, {_LEADS}) AS w FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
starts AS (SELECT doc_id, k, w FROM windows WHERE k <= n - {WINDOW - 1}),
firsts AS (SELECT w, min(doc_id) AS f FROM starts GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + {WINDOW - 1})) AS k FROM starts JOIN firsts USING (w) WHERE f < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS m FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(m, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM lists LEFT JOIN kept USING (doc_id)
"""
