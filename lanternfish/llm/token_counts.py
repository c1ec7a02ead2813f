"""Operator 4: token counts by a compiled finite-state transducer.

The vocabulary is compiled into a deterministic transducer over the bytes of a
pre-token (``bpe.Transducer``): each transition carries by how many tokens the count
changes. States are made when first reached and remembered up to a bound.

A document over ``CHUNK`` characters is counted by chunks on any executors. The
map of a chunk gives, for each state of the automaton in which it can be entered
(how a token lies over the cut) and each in which it can be left, the tokens that
begin inside. It is found by running all entries side by side until they fall
into one state, which they do at the next boundary of pre-tokens at the latest;
where a chunk has no boundary at all, the map still has a bounded size and no more
than the chunk is read. Maps compose associatively, and ``scan`` composes those
of a document group by group.

Defined cases: null and empty texts have 0 bytes and 0 tokens; equal rows give
equal rows; extra columns are ignored; a special token's string inside a text
counts as one token, the default of the tokenizers library; a text of one
endless word is counted by chunks as any other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .bpe import SEP, Merger, Transducer
from .common import Memo, materialize, per_worker, table

MODEL = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 65_536

_WS = r"\t-\r\x20\x85\xa0  -     　"
#: The vocabulary's split into pre-tokens, with white space spelt out.
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Letters of Latin alphabets, and ASCII marks but the apostrophe, which may begin a suffix.
_LATIN, _MARK = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
#: Pieces between places where a pre-token ends for certain: between words, marks and digits, and before white space.
_PIECE = re.compile(rf"[{_WS}]*(?:[{_LATIN}]+(?=[\x00-@\[-`{{-\x7f]|\Z)|[{_MARK}]+(?=[{_LATIN}0-9\t-\r ]|\Z)|[0-9]+(?=[\x00-/:-\x7f]|\Z)|[^{_WS}]+)|[{_WS}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return [out[b] for b in range(256)]


#: Stands for a special token in spelt texts.
_SPECIAL = "\1"


class TokenCounter:
    """Counts tokens as the tokenizers library does for a byte-level vocabulary file."""

    #: Pieces of text whose counts are remembered.
    LIMIT = 300_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level vocabulary without a normalizer is needed")
        ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        special = [t["content"] for t in spec["added_tokens"]]
        if any(a.startswith(b[k:]) for a in special for b in special for k in range(a == b, len(b))):
            raise ValueError("special tokens that overlap are not supported")
        self.machine = Transducer(set(model["vocab"]) - set(special), Merger(lambda a, b: ranks.get((a, b))))
        self.letters = dict(enumerate(byte_letters()))
        self.special, self.specials = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None, special
        #: Characters around a chunk that decide how its ends are crossed: the longest token, and what settles boundaries near the edge.
        self.reach = self.machine.longest + 8 + max(map(len, special), default=0)
        self.known = Memo(self._piece, self.LIMIT)

    def _letters(self, text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def _piece(self, text: str) -> int:
        """Tokens of a piece of text that begins and ends at certain boundaries."""
        return sum(self.machine.count(self._letters(m)) for m in _PRETOKEN.findall(text))

    def count(self, text: str) -> int:
        known = self.known.__getitem__
        if any(s in text for s in self.specials):
            parts = self.special.split(text)
            return sum(sum(map(known, _PIECE.findall(p))) for p in parts[::2]) + len(parts) // 2
        return sum(map(known, _PIECE.findall(text)))

    def spell(self, window: str, *cuts: int) -> tuple[str, list[int]]:
        """Letters of a window of text with separators between pre-tokens, and where its cuts lie in them.

        A cut at a boundary lies after the separator, one inside a special token after that token.
        """
        parts, places, at, size = [], {}, 0, 0
        for k, part in enumerate(self.special.split(window) if self.special else [window]):
            for token in [part] if k % 2 else _PRETOKEN.findall(part):
                letters = _SPECIAL if k % 2 else self._letters(token)
                begin = size + 1 if parts else 0
                for cut in cuts:
                    if at <= cut < at + len(token):
                        places[cut] = begin + (len(letters[: cut - at]) if k % 2 else len(self._letters(token[: cut - at])))
                parts.append(letters)
                at, size = at + len(token), begin + len(letters)
        return SEP.join(parts), [places.get(c, size) for c in cuts]

    def chunk_map(self, near: str, begin: int, end: int) -> scan.Matrix:
        """{(state at begin, state at end): tokens that begin between}; near reaches ``reach`` characters over both."""
        spelt, (a, b) = self.spell(near, begin, end)
        return self.machine.matrix(spelt, a, b)

    def chunks(self, text: str, size: int):
        """(text around a chunk, its begin, its end) of each chunk of a text."""
        for begin in range(0, len(text), size):
            end, low = min(begin + size, len(text)), max(0, begin - self.reach)
            yield text[low : end + self.reach], begin - low, end - low


def counter(path: str) -> TokenCounter:
    """One compiled counter a worker."""
    return per_worker(TokenCounter, path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and whether it has more than ``limit``."""
    path = path or tokenizer_path(MODEL)
    slim = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_bytes long, n_tokens long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([c.count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    small = slim.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(whole, fields)
    giant = slim.filter(F.length("text") > chunk).withColumn("_uid", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                one = b.slice(i, 1)
                for part, (near, begin, end) in enumerate(c.chunks(text, chunk)):
                    cells = [pa.array([v], t) for v, t in ((part, pa.int32()), (near, pa.string()), (begin, pa.int32()), (end, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*(one.column(x) for x in ("_uid", "doc_id", "n_bytes")), *cells], ["_uid", "doc_id", "n_bytes", "part", "near", "begin", "end"])

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for s in range(0, b.num_rows, 16):
                few = b.slice(s, 16)
                maps = [c.chunk_map(*x) for x in zip(*(few.column(x).to_pylist() for x in ("near", "begin", "end")), strict=True)]
                yield pa.RecordBatch.from_arrays([*(few.column(x) for x in ("_uid", "doc_id", "n_bytes", "part")), scan.pack(maps)], ["_uid", "doc_id", "n_bytes", "part", "matrix"])

    key = f"_uid long, doc_id {kind}, n_bytes long, part int"
    parts = giant.mapInArrow(cut, f"{key}, near string, begin int, end int").repartition("_uid", "part")
    maps = materialize(parts.mapInArrow(to_maps, f"{key}, matrix {scan.MATRIX}"), "maps")
    totals = scan.levels(maps.select("_uid", "part", "matrix"))[-1].select("_uid", F.element_at("matrix", 1)["v"].cast("long").alias("n_tokens"))
    large = maps.filter("part = 0").join(totals, "_uid").select("doc_id", "n_bytes", "n_tokens")
    return small.unionByName(large).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
