"""Parallel prefix scan of max-plus matrices over the chunks of many documents.

A chunk of a text is a matrix over the semiring (max, +): from each state in which
it can be entered to each in which it can be left. Products are associative, so
the chunks of a document are multiplied in groups of ``FAN``, these products in
groups again, and so on up to one matrix a document; then the states at the cuts
are handed down again, group by group. No task ever holds more than ``FAN``
matrices of a document, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32

Matrix = dict[tuple[tuple[int, int], tuple[int, int]], float]

#: A matrix as a column: state at the beginning, state at the end, score.
MATRIX = "array<struct<s0:int,s1:int,t0:int,t1:int,v:double>>"
_CELLS = pa.list_(pa.struct([("s0", pa.int32()), ("s1", pa.int32()), ("t0", pa.int32()), ("t1", pa.int32()), ("v", pa.float64())]))
_STATES = ("s0", "s1", "t0", "t1")


def pack(matrices: list[Matrix]) -> pa.Array:
    return pa.array([[{"s0": s[0], "s1": s[1], "t0": t[0], "t1": t[1], "v": float(v)} for (s, t), v in m.items()] for m in matrices], _CELLS)


def unpack(cells: list[dict]) -> Matrix:
    return {((c["s0"], c["s1"]), (c["t0"], c["t1"])): c["v"] for c in cells}


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of two matrices; associative."""
    rows: dict = {}
    for (s, t), v in b.items():
        rows.setdefault(s, []).append((t, v))
    out: Matrix = {}
    for (s, m), v in a.items():
        for t, w in rows.get(m, ()):
            if (at := out.get((s, t))) is None or v + w > at:
                out[s, t] = v + w
    return out


def products(matrices: list[Matrix]) -> Matrix:
    """All matrices multiplied, pairwise."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def choose(matrices: list[Matrix], enter: tuple | None = None, leave: tuple | None = None) -> list[tuple]:
    """The states in which the best path enters and leaves each of some neighbouring chunks; by default the best of all paths."""
    prefix = [{enter or (0, 0): 0.0}]
    for m in matrices:
        row: dict = {}
        for (s, t), v in m.items():
            if s in prefix[-1] and prefix[-1][s] + v > row.get(t, float("-inf")):
                row[t] = prefix[-1][s] + v
        prefix.append(row)
    at = leave or max(prefix[-1], key=lambda t: (prefix[-1][t], t))
    out = []
    for m, before in zip(matrices[::-1], prefix[-2::-1], strict=True):
        from_ = max((s for s, t in m if t == at and s in before), key=lambda s: (before[s] + m[s, at], s))
        out.append((from_, at))
        at = from_
    return out[::-1]


def _grouped(maps: DataFrame) -> DataFrame:
    """(_uid, part, members): the matrices of each group of neighbours, in no order."""
    group = F.floor(F.col("part") / F.lit(FAN)).cast("int")
    return maps.groupBy("_uid", group.alias("group")).agg(F.collect_list(F.struct("part", "matrix")).alias("members")).select("_uid", F.col("group").alias("part"), "members")


def _members(row: list[dict]) -> tuple[list[int], list[Matrix]]:
    row.sort(key=lambda m: m["part"])
    return [m["part"] for m in row], [unpack(m["matrix"]) for m in row]


def _level(maps: DataFrame) -> DataFrame:
    """One matrix for each group of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pack([products(_members(r)[1]) for r in b.column(2).to_pylist()])], ["_uid", "part", "matrix"])

    return _grouped(maps).mapInArrow(run, f"_uid long, part int, matrix {MATRIX}")


def levels(maps: DataFrame) -> list[DataFrame]:
    """maps (_uid, part, matrix) and the products of its groups, up to one row for each _uid."""
    most = maps.agg(F.max("part").alias("p")).first()["p"] or 0
    out = [maps]
    while most > 0 or len(out) == 1:
        out.append(_level(out[-1]))
        most //= FAN
    return out


def states(maps: DataFrame) -> DataFrame:
    """(_uid, part, s0, s1, t0, t1): the states in which the best path enters and leaves each chunk of maps."""
    *lower, top = levels(maps)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [choose([unpack(m)])[0] for m in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([(*s, *t)[k] for s, t in ends], pa.int32()) for k in range(4)]], ["_uid", "part", *_STATES])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uid, row, *ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts, matrices = _members(row)
                rows += [(uid, p, *s, *t) for p, (s, t) in zip(parts, choose(matrices, tuple(ends[:2]), tuple(ends[2:])), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), *[pa.int32()] * 5))], ["_uid", "part", *_STATES])

    fields = "_uid long, part int, s0 int, s1 int, t0 int, t1 int"
    out = top.mapInArrow(best, fields)
    for maps in reversed(lower):
        out = _grouped(maps).join(out, ["_uid", "part"]).select("_uid", "members", *_STATES).mapInArrow(down, fields)
    return out
