"""Operator 6: SentencePiece encoding and decoding by a max-plus parallel scan.

A text's segmentation is the best path through a lattice of pieces. A chunk of a
text is a matrix over the semiring (max, +): from each state in which a path can
enter the chunk to each in which it can leave, the best score. Matrices compose
associatively, so a giant document is cut into chunks scored on any executors, a
scan of their matrices fixes the states at the cuts, and each chunk is then
traced back by itself.

* Unigram models: pieces have scores, and a state is how far the last piece
  reaches over the cut.
* BPE models: no score is added, but a piece may stand after another only if
  merging keeps the two apart (``bpe.Merger.valid``), so entries are 0 or -inf, a
  state is the piece at the cut, and exactly one path over the whole text is left.
  It is the segmentation that merging yields. Ways into a chunk are followed side by
  side by the automaton of ``bpe.Transducer`` until they fall together.

The scan (``scan``) multiplies the matrices of neighbouring chunks group by group
up to one a document, and hands the states at the cuts down again.

Where no piece has a space mark after another character, paths never cross a
place where a space mark follows something else; the matrix between two such
places is one number, and pieces of text between them are remembered.

Defined cases: null and empty texts have no pieces and decode to an empty
string; equal rows give equal rows; extra columns are kept by ``encode``.
Decoding inverts encoding except for what the model's own normalization changes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import scan
from .bpe import SEP, Merger, Transducer
from .common import Memo, by_place, map_by_place, materialize, per_worker, table
from .scan import choose
from .token_counts import tokenizer_path

MODEL = "piece_bpe_32k.model"
CHUNK = 65_536
SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_LATIN, _OTHER = "A-Za-zÀ-ÖØ-öø-ɏ", r"\x00-@\[-`{-\x7f"
#: Segments that also end between Latin letters and ASCII characters that are no letters.
_FINER = re.compile(rf"{SPACE}*(?:[{_LATIN}]+(?=[{_OTHER}{SPACE}]|\Z)|[{_OTHER}]+(?=[{_LATIN}{SPACE}]|\Z)|[^{SPACE}]+)|{SPACE}+")
_CROSSING = re.compile(rf"[{_LATIN}][{_OTHER}]|[{_OTHER}][{_LATIN}]")
_SAFE = re.compile(f"(?<=[^{SPACE}]){SPACE}")
#: What a NUL is in spelt texts, where it would be taken for a separator.
_NUL = "\udc00"
UNIGRAM, BPE = 1, 2


def _field(data: bytes, want: tuple[int, ...]) -> int | None:
    """An integer field of a serialized protocol buffer by its path of field numbers."""
    at, found = 0, None

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            value = varint()
            if want == (number,):
                found = value
        elif kind == 2:
            n = varint()
            if number == want[0] and len(want) > 1:
                found = _field(data[at : at + n], want[1:])
            at += n
        else:
            at += 8 if kind == 1 else 4
    return found


class Lattice:
    """Pieces, their scores and which may follow which.

    scores: of ordinary pieces. A character that no piece covers stands alone at
    ``unknown_score``.
    """

    def __init__(self, scores: dict[str, float], kind: int, unknown_score: float | None = None):
        self.scores, self.kind = scores, kind
        self.longest = max([1, *map(len, scores)])
        self.unknown_score = min([0.0, *scores.values()]) - 10.0 if unknown_score is None else unknown_score
        self.merger = Merger(lambda a, b: -s if (s := scores.get(a + b)) is not None else None)
        self.machine = Transducer(scores, self.merger) if kind == BPE else None
        #: Whether a space mark after another character is always a boundary.
        self.safe = all(SPACE not in p.lstrip(SPACE) for p in scores)
        #: Segments between places that no piece crosses.
        self.segments = _SEGMENT if any(map(_CROSSING.search, scores)) else _FINER
        self.reach = self.longest + 1

    def _weight(self, piece: str) -> float | None:
        return self.scores.get(piece, self.unknown_score if len(piece) == 1 else None)

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Ways in which the last piece before a cut can lie over it: 1 for what lies before, and the characters after."""
        if at == 0 or at == len(text):
            return [(0, 0)] if at == 0 else [(1, 0)]
        return [(1, n) for n in range(self.longest) if at + n <= len(text) and any(b <= at and self._weight(text[at - b : at + n]) is not None for b in range(1, self.longest - n + 1))]

    def _walk(self, text: str, begin: int, end: int, sources: dict) -> tuple[dict, dict]:
        """Best scores into each place from each source, for pieces that start in [begin, end).

        sources: place -> {source: score}. Returns the places and the best place
        before each (place, source).
        """
        places: dict[int, dict] = {at: dict(scores) for at, scores in sources.items()}
        back: dict = {(at, source): None for at, scores in sources.items() for source in scores}
        for i in range(begin, end):
            for source, score in places.get(i, {}).items():
                for n in range(1, min(self.longest, len(text) - i) + 1):
                    if (w := self._weight(text[i : i + n])) is not None:
                        at = places.setdefault(i + n, {})
                        if source not in at or score + w > at[source]:
                            at[source] = score + w
                            back[i + n, source] = i
        return places, back

    def _cuts(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """First and last safe places strictly inside a chunk."""
        if not self.safe:
            return None
        first = _SAFE.search(text, begin + self.longest, max(begin + self.longest, end - self.longest))
        if first is None:
            return None
        last = max(text.rfind(SPACE, first.start(), end - self.longest), first.start())
        while last > first.start() and text[last - 1] == SPACE:
            last -= 1
        return first.start(), last

    def _spelt(self, text: str, *cuts: int) -> tuple[str, list[int]]:
        """A text with separators at its safe places, and where its cuts lie in it (after a separator)."""
        text = text.replace(SEP, _NUL)
        if not self.safe:
            return text, list(cuts)
        places = [m.start() for m in _SAFE.finditer(text)]
        return _SAFE.sub(SEP + SPACE, text), [c + bisect_right(places, c) for c in cuts]

    def matrix(self, text: str, begin: int, end: int) -> scan.Matrix:
        """Best score from each state at begin to each at end; text reaches ``reach`` characters over both."""
        if self.kind == BPE:
            spelt, (a, b) = self._spelt(text, begin, end)
            return dict.fromkeys(self.machine.matrix(spelt, a, b, count=lambda part: 0), 0.0)
        enter = {begin + s[1]: {s: 0.0} for s in self.states(text, begin)}
        if (cuts := self._cuts(text, begin, end)) is None:
            return self._leave(self._walk(text, begin, end, enter)[0], end)
        a, b = cuts
        into = self._walk(text[:a], begin, a, enter)[0].get(a, {})
        middle = sum(self.segment(x)[1] for x in _SEGMENT.findall(text, a, b))
        out = {t: v for (_, t), v in self._leave(self._walk(text, b, end, {b: {"cut": 0.0}})[0], end).items()}
        return {(s, t): v + middle + w for s, v in into.items() for t, w in out.items()}

    def _leave(self, places: dict, end: int) -> scan.Matrix:
        return {(s, (1, at - end)): v for at, scores in places.items() if at >= end for s, v in scores.items()}

    def trace(self, text: str, begin: int, end: int, enter: tuple, leave: tuple) -> list[str]:
        """Pieces that start in [begin, end) on the best path between two states."""
        if self.kind == BPE:
            spelt, (a, b) = self._spelt(text, begin, end)
            return [p.replace(_NUL, "\0") for p in self.machine.trace(spelt, a, b, enter, leave)]
        if (cuts := self._cuts(text, begin, end)) is None:
            return self._path(text, begin, end, begin + enter[1], end + leave[1])
        a, b = cuts
        head, tail = self._path(text[:a], begin, a, begin + enter[1], a), self._path(text, b, end, b, end + leave[1])
        return [*head, *[p for x in _SEGMENT.findall(text, a, b) for p in self.segment(x)[0]], *tail]

    def _path(self, text: str, begin: int, end: int, source: int, to: int) -> list[str]:
        back = self._walk(text, begin, end, {source: {0: 0.0}})[1]
        out = []
        while (prior := back[to, 0]) is not None:
            out.append(text[prior:to])
            to = prior
        return out[::-1]

    def segment(self, text: str) -> tuple[list[str], float]:
        """Pieces and score of a text on its own."""
        if self.kind == BPE:
            return self.machine.encode(text), 0.0
        places, back = self._walk(text, 0, len(text), {0: {0: 0.0}})
        to, out = len(text), []
        while (prior := back[to, 0]) is not None:
            out.append(text[prior:to])
            to = prior
        return out[::-1], places[len(text)][0]

    def chunked(self, text: str, size: int) -> list[str]:
        """The whole text by chunks: matrices, scan, and a trace of each chunk."""
        chunks = list(self.chunks(text, size))
        choice = choose([self.matrix(*c) for c in chunks])
        return [p for c, (s, t) in zip(chunks, choice, strict=True) for p in self.trace(*c, s, t)]

    def chunks(self, text: str, size: int):
        """(text around a chunk, its begin, its end) of each chunk of a text."""
        for begin in range(0, len(text), size):
            end, low = min(begin + size, len(text)), max(0, begin - self.reach)
            yield text[low : end + self.reach], begin - low, end - low


class Codec:
    """Encodes and decodes as the sentencepiece library does for a model file."""

    #: Segments whose ids are remembered.
    LIMIT = 300_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = _field(m.serialized_model_proto(), (2, 3)) or UNIGRAM
        n = m.get_piece_size()
        self.pieces = m.id_to_piece(list(range(n)))
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        if kind not in (UNIGRAM, BPE):
            raise ValueError("a unigram or a BPE model is needed")
        self.ids = {self.pieces[i]: i for i in plain}
        self.lattice = Lattice({self.pieces[i]: m.get_score(i) for i in plain}, kind)
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = m.unk_id()
        self.is_byte = np.array([i in self.bytes_of for i in range(n)])
        self.known = Memo(self._segment, self.LIMIT)
        self.packed = Memo(self._piece_ids, self.LIMIT)

    def normalize(self, text: str) -> str:
        return self.model.normalize(text)

    def _piece_ids(self, piece: str) -> bytes:
        """Ids of one piece of the lattice, packed."""
        if (i := self.ids.get(piece)) is not None:
            ids = [i]
        else:
            ids = [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
        return np.array(ids, dtype=np.int32).tobytes()

    def _segment(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.lattice.segment(text)[0]))

    def _ids(self, packed: bytes) -> np.ndarray:
        """Unpacked ids; where there are no bytes, a run of unknown characters is one id."""
        ids = np.frombuffer(packed, dtype=np.int32)
        if self.byte_ids or not len(ids):
            return ids
        return ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])]

    def to_ids(self, pieces: list[str]) -> np.ndarray:
        """Ids of pieces; characters outside the vocabulary become bytes, or one unknown id for each run of them."""
        return self._ids(b"".join(map(self.packed.__getitem__, pieces)))

    def encode(self, text: str | None) -> np.ndarray:
        if not text or not (whole := self.normalize(text)):
            return np.empty(0, dtype=np.int32)
        if not self.lattice.safe:
            return self.to_ids(self.lattice.segment(whole)[0])
        return self._ids(b"".join(map(self.known.__getitem__, self.lattice.segments.findall(whole))))

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int32)
        if not self.is_byte[ids].any():
            text = "".join(map(self.pieces.__getitem__, ids.tolist()))
        else:
            out, run = [], bytearray()
            for i in [*ids.tolist(), None]:
                if i in self.bytes_of:
                    run.append(self.bytes_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                if i is not None:
                    out.append(self.pieces[i])
            text = "".join(out)
        return text.removeprefix(SPACE).replace(SPACE, " ")


def codec(path: str) -> Codec:
    """One codec a worker."""
    return per_worker(Codec, path)


def _id_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """docs with token_ids array<int>, n_tokens long and decoded string (the ids decoded again).

    Documents of ``chunk`` characters or fewer are encoded where they are read.
    Longer ones are dealt out by chunk: matrices first, then the scan that fixes the
    states at the cuts, then the ids of each chunk.
    """
    path = path or tokenizer_path(MODEL)
    own = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "decoded")]
    docs = by_place(docs.select(*[f"`{c}`" for c in own]))
    names, at = docs.columns, own.index("text")
    text = F.col(names[at])
    out_fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in docs.schema], "token_ids array<int>", "n_tokens long", "decoded string"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids = [c.encode(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, _id_lists(ids), pa.array([len(i) for i in ids], pa.int64()), pa.array([c.decode(i) for i in ids], pa.string())], [*names, "token_ids", "n_tokens", "decoded"])

    small = docs.filter(F.coalesce(F.length(text), F.lit(0)) <= chunk).mapInArrow(whole, out_fields)
    giant = materialize(docs.filter(F.length(text) > chunk).withColumn("_uid", F.monotonically_increasing_id()), "giants")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part, (near, begin, end) in enumerate(c.lattice.chunks(c.normalize(text), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((uid, pa.int64()), (part, pa.int32()), (near, pa.string()), (begin, pa.int32()), (end, pa.int32()))], ["_uid", "part", "near", "begin", "end"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for s in range(0, b.num_rows, 16):
                few = b.slice(s, 16)
                found = [c.lattice.matrix(*x) for x in zip(*(few.column(x).to_pylist() for x in ("near", "begin", "end")), strict=True)]
                yield pa.RecordBatch.from_arrays([few.column("_uid"), few.column("part"), scan.pack(found)], ["_uid", "part", "matrix"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for s in range(0, b.num_rows, 16):
                few = b.slice(s, 16)
                ids = [c.to_ids(c.lattice.trace(r["near"], r["begin"], r["end"], (r["s0"], r["s1"]), (r["t0"], r["t1"]))) for r in few.to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column("_uid"), few.column("part"), _id_lists(ids)], ["_uid", "part", "ids"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [np.array(i or [], dtype=np.int32) for i in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], _id_lists(ids), pa.array([len(i) for i in ids], pa.int64()), pa.array([c.decode(i) for i in ids], pa.string())], [*names, "token_ids", "n_tokens", "decoded"])

    parts = materialize(giant.select("_uid", text).mapInArrow(cut, "_uid long, part int, near string, begin int, end int").repartition("_uid", "part"), "chunks")
    scored = materialize(parts.select("_uid", "part", "near", "begin", "end").mapInArrow(matrices, f"_uid long, part int, matrix {scan.MATRIX}"), "matrices")
    pieces = parts.join(scan.states(scored), ["_uid", "part"]).select("_uid", "part", "near", "begin", "end", "s0", "s1", "t0", "t1").mapInArrow(traced, "_uid long, part int, ids array<int>")
    ids = pieces.groupBy("_uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("_ids"))
    large = giant.join(ids, "_uid", "left").select(*names, "_ids").mapInArrow(finished, out_fields)
    return small.unionByName(large).toDF(*own, "token_ids", "n_tokens", "decoded")


def decode(encoded: DataFrame, path: str | None = None, column: str = "token_ids") -> DataFrame:
    """encoded with the texts of its ids in the column decoded; null ids decode to an empty string."""
    path = path or tokenizer_path(MODEL)
    names = [c for c in encoded.columns if c != "decoded"]
    slim = encoded.select(*[f"`{c}`" for c in names])
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(i or []) for i in b.column(at).to_pylist()], pa.string())], [*names, "decoded"])

    return map_by_place(slim, run, StructType([*slim.schema, StructField("decoded", StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
