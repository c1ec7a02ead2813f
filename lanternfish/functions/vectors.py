"""Vector functions as Column expressions; all but distance_to and packing stay inside the JVM.

A vector is an array of floats, of tinyints (int8), or of longs whose bits are
packed 64 to a word, least significant first (bit vectors). The element type is
the tag that says which. Arithmetic is in doubles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")
#: Vectors that are widened to doubles at a time.
BLOCK = 512
#: Width of one int8 step over [-1, 1], as a 32-bit float.
STEP = "cast(cast(2.0D / 255.0D as float) as double)"


def _double(x: Column) -> Column:
    return x.cast("double")


def literal(v) -> Column:
    """A query vector as an array literal of doubles."""
    return F.array(*[F.lit(float(x)) for x in v])


def fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def same_length(a: Column, b: Column) -> Column:
    """a, or an error if the two differ in dimensions."""
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" dimensions"))).cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def norm(a: Column) -> Column:
    return F.sqrt(fold(F.transform(a, lambda x: _double(x) * _double(x))))


def distance_cosine(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has no length, so that thresholds drop it."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def distance_l2(a: Column, b: Column) -> Column:
    return F.sqrt(fold(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y)))))


def distance_l1(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: F.abs(_double(x) - _double(y))))


def distance_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two bit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda s, x: s + x)


DISTANCES = {"cosine": distance_cosine, "l2": distance_l2, "l1": distance_l1}


def _rows_to(query: np.ndarray, metric: str):
    """Distances of the rows of a matrix to one vector, each row by itself, so that equal rows are equally far."""
    size = np.sqrt((query * query).sum())

    def cosine(m: np.ndarray) -> np.ndarray:
        norms = np.sqrt((m * m).sum(axis=1)) * size
        return 1.0 - np.divide((m * query).sum(axis=1), norms, out=np.full(len(m), np.nan), where=norms != 0)

    def l2(m: np.ndarray) -> np.ndarray:
        m = m - query
        return np.sqrt((m * m).sum(axis=1))

    return {"cosine": cosine, "l2": l2, "l1": lambda m: np.abs(m - query).sum(axis=1)}[metric]


def distance_to(v: Column, query: Sequence[float], metric: str = "cosine") -> Column:
    """Distance of vectors to one query, by Arrow batches; null for a vector that is null, of another length, or has no direction.

    A vector with a null or NaN component is at no distance either. Packed vectors
    are read as they lie; a query's dimensions tell int8 and float32 apart.
    """
    q = np.array([float(x) for x in query])

    @F.arrow_udf(T.DoubleType())
    def distances(a: pa.Array) -> pa.Array:
        rows_to, out = _rows_to(q, metric), np.full(len(a), np.nan)
        if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type):
            sizes = pc.fill_null(pc.binary_length(a), -1).to_numpy(zero_copy_only=False)
            for kind in ("<f4", "i1"):
                at = np.flatnonzero(sizes == len(q) * np.dtype(kind).itemsize)
                for s in range(0, len(at), BLOCK):
                    here = at[s : s + BLOCK]
                    joined = np.frombuffer(b"".join(a.take(pa.array(here)).to_pylist()), kind)
                    with np.errstate(all="ignore"):
                        out[here] = rows_to(joined.astype(np.float64).reshape(len(here), len(q)))
            return pa.array(out, pa.float64(), mask=np.isnan(out))
        fits = pc.fill_null(pc.equal(pc.list_value_length(a), len(q)), False)
        at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
        for s in range(0, len(at), BLOCK):
            part = a.take(pa.array(at[s : s + BLOCK])) if len(at) < len(a) else a.slice(s, BLOCK)
            with np.errstate(all="ignore"):
                out[at[s : s + BLOCK]] = rows_to(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), len(q)))
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return distances(v)


@F.arrow_udf(T.BinaryType())
def pack(a: pa.Array) -> pa.Array:
    """Bytes of a vector: one for each int8, four (little-endian float32) for others; null of one that holds a null."""
    kind = "i1" if pa.types.is_int8(a.type.value_type) else "<f4"
    return pa.array([None if v is None or None in v else np.asarray(v, kind).tobytes() for v in a.to_pylist()], pa.binary())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def unpack_float(a: pa.Array) -> pa.Array:
    """Components of packed float32; null of bytes that are no multiple of four."""
    return pa.array([None if b is None or len(b) % 4 else np.frombuffer(b, "<f4") for b in a.to_pylist()], pa.list_(pa.float32()))


@F.arrow_udf(T.ArrayType(T.ByteType()))
def unpack_int8(a: pa.Array) -> pa.Array:
    """Components of packed int8."""
    return pa.array([None if b is None else np.frombuffer(b, "i1") for b in a.to_pylist()], pa.list_(pa.int8()))


def length(v: Column) -> Column:
    return F.size(v)


def kind(v: Column) -> Column:
    """float32, int8 or bit."""
    t = F.typeof(v)
    return F.when(t == "array<tinyint>", "int8").when(t == "array<bigint>", "bit").otherwise("float32")


def from_json(text: Column) -> Column:
    """A float vector from its JSON text; null if it is none or empty."""
    v = F.from_json(text, "array<float>")
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), v)


def int8_from_json(text: Column) -> Column:
    """An int8 vector; a component outside [-128, 127] is an error."""
    return F.transform(F.from_json(text, "array<int>"), lambda x: x.cast("tinyint"))


def bits_from_hex(text: Column) -> Column:
    """A bit vector from the hexadecimal text of its bytes."""
    raw = F.unhex(text)
    byte = lambda w, i: F.conv(F.hex(F.substring(raw, w * 8 + i + 1, 1)), 16, 10).cast("long")
    words = F.sequence(F.lit(0), F.ceil(F.octet_length(raw) / 8).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.coalesce(byte(w, i), F.lit(0).cast("long")), i * 8))))


def to_json(v: Column) -> Column:
    """Text of a vector with six decimals; NaN becomes null."""
    item = lambda x: F.when(F.isnan(_double(x)), "null").otherwise(F.format_string("%.6f", _double(x)))
    return F.concat(F.lit("["), F.array_join(F.transform(v, item), ","), F.lit("]"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (_double(x) + _double(y)).cast("float"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)).cast("float"))


def _wrap(x: Column) -> Column:
    return (F.pmod(x + F.lit(128), F.lit(256)) - F.lit(128)).cast("tinyint")


def add_int8(a: Column, b: Column) -> Column:
    """Sum that wraps around at 8 bits."""
    return F.zip_with(a, b, lambda x, y: _wrap(x.cast("int") + y.cast("int")))


def subtract_int8(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _wrap(x.cast("int") - y.cast("int")))


def cut(v: Column, start: int, end: int) -> Column:
    """Components [start, end), counted from 0; limits outside the vector are an error."""
    if start < 0 or end <= start:
        raise ValueError(f"no slice [{start}, {end})")
    return F.when(F.size(v) >= end, F.slice(v, start + 1, end - start)).otherwise(F.raise_error(F.lit(f"slice end {end} beyond the vector")).cast("array<float>"))


def normalize(v: Column) -> Column:
    """v of length 1; components of a vector without length are NaN."""
    n = norm(v)
    return F.transform(v, lambda x: F.coalesce(F.try_divide(_double(x), n), F.lit(NAN)).cast("float"))


def truncate_normalized(v: Column, dims: int) -> Column:
    """The first dims components, brought to length 1; a vector without length stays as it is."""
    short = F.slice(v, 1, dims)
    n = norm(short)
    return F.when(n > 0, F.transform(short, lambda x: (_double(x) / F.greatest(n, F.lit(5e-324))).cast("float"))).otherwise(short)


def quantize_int8(v: Column) -> Column:
    """int8 of components in [-1, 1]: truncated toward zero, clamped, NaN to 127."""
    step = F.expr(STEP)
    scaled = lambda x: (_double(x) + 1.0) / step - 128.0
    return F.transform(v, lambda x: F.greatest(F.least(scaled(x), F.lit(127.0)), F.lit(-128.0)).cast("tinyint"))


def quantize_binary(v: Column) -> Column:
    """Bit vector of the signs (1 where > 0), 64 to a long, least significant bit first."""
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / F.lit(64)).cast("int") - 1)

    def word(w: Column) -> Column:
        part = F.slice(v, w * 64 + 1, F.lit(64))
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.transform(words, word)


def each(v: Column) -> Column:
    """Generator of (pos, col): a row for each component."""
    return F.posexplode(v)


def version() -> Column:
    from lanternfish import __version__

    return F.lit(f"v{__version__}")


#: SQL names for sessions that query in text; each body is one expression that Catalyst inlines.
_SQL = {
    "vec_distance_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "vec_distance_l1(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)",
    "vec_distance_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "1D - try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))",
    "vec_length(v ARRAY<DOUBLE>) RETURNS INT": "size(v)",
}


def register_sql(spark) -> None:
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def is_unit(v: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(v) - 1.0) <= F.lit(math.fabs(tolerance))
