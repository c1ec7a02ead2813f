import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.functions import vectors as V
from lanternfish.operators import knn


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)], [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(20)]
    return spark.createDataFrame(rows, "i int, a array<float>, b array<float>"), rows


def test_distances(pairs):
    df, rows = pairs
    got = df.select("i", V.distance_l2(F.col("a"), F.col("b")).alias("l2"), V.distance_l1(F.col("a"), F.col("b")).alias("l1"), V.distance_cosine(F.col("a"), F.col("b")).alias("cos")).collect()
    for r, (_, a, b) in zip(sorted(got), rows, strict=True):
        a, b = np.array(a), np.array(b)
        assert math.isclose(r["l2"], np.linalg.norm(a - b), rel_tol=1e-9)
        assert math.isclose(r["l1"], np.abs(a - b).sum(), rel_tol=1e-9)
        assert math.isclose(r["cos"], 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), rel_tol=1e-9)


def test_quantize_int8_truncates(spark):
    df = spark.createDataFrame([([0.0, 0.5, -0.5, 1.0, -1.0, 2.0, -2.0, float("nan")],)], "v array<float>")
    assert df.select(V.quantize_int8(F.col("v"))).first()[0] == [0, 63, -64, 126, -128, 127, -128, 127]


def test_bits(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.0] + [0.0] * 61 + [1.0],)], "v array<float>")
    assert df.select(V.quantize_binary(F.col("v"))).first()[0] == [5, 1]
    assert df.select(V.distance_hamming(F.array(F.lit(5).cast("long")), F.array(F.lit(2).cast("long")))).first()[0] == 3
    assert spark.createDataFrame([("0102",)], "t string").select(V.bits_from_hex(F.col("t"))).first()[0] == [513]


def test_wrapping_and_slices(spark):
    df = spark.createDataFrame([([100, -100], [100, -100])], "a array<tinyint>, b array<tinyint>")
    assert df.select(V.add_int8(F.col("a"), F.col("b"))).first()[0] == [-56, 56]
    f = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>")
    assert f.select(V.cut(F.col("v"), 1, 3)).first()[0] == [2.0, 3.0]
    with pytest.raises(ValueError):
        V.cut(F.col("v"), 2, 2)
    with pytest.raises(Exception, match="beyond"):
        f.select(V.cut(F.col("v"), 1, 4)).collect()


def test_normalize_and_json(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    rows = df.select(V.normalize(F.col("v")).alias("n"), V.truncate_normalized(F.col("v"), 1).alias("t"), V.to_json(F.col("v")).alias("j"), V.kind(F.col("v")).alias("k")).collect()
    assert rows[0]["n"] == pytest.approx([0.6, 0.8]) and all(map(math.isnan, rows[1]["n"]))
    assert rows[0]["t"] == [1.0] and rows[1]["t"] == [0.0]
    assert rows[0]["j"] == "[3.000000,4.000000]" and rows[0]["k"] == "float32"
    assert spark.createDataFrame([("[1,2]",), ("[]",)], "t string").select(V.from_json(F.col("t"))).collect()[0][0] == [1.0, 2.0]


def test_sql_functions(spark):
    V.register_sql(spark)
    assert spark.sql("SELECT vec_distance_l2(array(0D, 0D), array(3D, 4D)), vec_length(array(1D))").first() == (5.0, 1)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "a", [1.0, 0.0, 0.0]), (2, "a", [0.8, 0.6, 0.0]), (3, "b", [0.0, 1.0, 0.0]), (4, "b", [0.0, 0.0, 0.0]), (5, "b", [1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "rowid long, source string, embedding array<float>")


def test_knn_orders_and_drops_zero_vectors(table):
    got = knn.knn(table, [1, 0, 0], 10).collect()
    assert [r["rowid"] for r in got] == [1, 5, 2, 3]
    assert [r["distance"] for r in got] == pytest.approx([0, 0, 0.2, 1], abs=1e-6)


def test_knn_filters(spark, table):
    assert [r["rowid"] for r in knn.knn(table, [1, 0, 0], 1, where=F.col("source") == "b").collect()] == [5]
    ids = spark.createDataFrame([(3,), (3,), (2,)], "rowid long")
    assert [r["rowid"] for r in knn.knn(table, [1, 0, 0], 5, rowids=ids).collect()] == [2, 3]
    assert [r["rowid"] for r in knn.knn(table, [1, 0, 0], 5, distance_where=lambda d: d > 0.1).collect()] == [2, 3]
    with pytest.raises(ValueError):
        knn.knn(table, [1, 0, 0], 5000)


def test_knn_batch_equals_single(spark, table):
    queries = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.0])], "query_id long, embedding array<float>")
    for metric in ("cosine", "l2", "l1"):
        got = knn.knn_batch(table, queries, 3, metric, vectors_per_group=2, queries_per_group=1).collect()
        for q, v in ((10, [1, 0, 0]), (11, [0, 1, 0])):
            assert [r["rowid"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [r["rowid"] for r in knn.knn(table, v, 3, metric).collect()]


def test_knn_batch_holds_blocks(spark):
    """A group of 40,000 vectors against a block of 1,024 queries: no matrix of all their distances at once."""
    import tracemalloc

    rng = np.random.default_rng(1)
    v, q = rng.integers(-3, 4, (40_000, 4)).astype(float), rng.integers(-3, 4, (1_024, 4)).astype(float)
    shelf = knn._Shelf(np.arange(40_000), v, 5, "l1")
    tracemalloc.start()
    rows, keys, d = shelf.nearest(q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(rows) == 5 * 1_024
    for i in range(0, 1_024, 100):
        far = np.abs(v - q[i]).sum(axis=1)
        assert keys[rows == i].tolist() == np.lexsort((np.arange(40_000), far))[:5].tolist() and d[rows == i].tolist() == sorted(far)[:5]


def test_knn_batch_ties_and_odd_vectors(spark):
    """Copies are equally far wherever they lie; rows without a distance to the query are left out."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(7, 33)).tolist()
    rows = [(i, base[i * i % 7]) for i in range(300)] + [(300, None), (301, [1.0] * 32 + [None]), (302, [1.0]), (303, [0.0] * 33), (304, [float("nan")] * 33)]
    df = spark.createDataFrame(rows, "rowid long, embedding array<float>")
    asked = df.filter("rowid < 7 OR rowid >= 300").withColumnRenamed("rowid", "query_id")
    for metric in ("cosine", "l2", "l1"):
        for size in (50, 65_536):
            got = sorted(map(tuple, knn.knn_batch(df, asked, 60, metric, vectors_per_group=size, queries_per_group=3).select("query_id", "rank", "rowid").collect()))
            for q in range(7):
                want = [r["rowid"] for r in knn.knn(df, dict(rows)[q], 60, metric).collect()]
                assert [r for i, _, r in got if i == q] == want
            assert {i for i, _, _ in got} == {*range(7), 302, *([303] if metric != "cosine" else [])}


def test_top_k_plan_has_no_join(table):
    plan = knn.knn(table, [1, 0, 0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan


def test_declared_table(spark, table):
    t = knn.VectorTable(3, metric="cosine", partition_keys=("source",), metadata=(("label", "long"),))
    assert t.schema.fieldNames() == ["rowid", "source", "embedding", "label"]
    with pytest.raises(ValueError):
        knn.VectorTable(0)
    with pytest.raises(Exception, match="expected 2"):
        knn.VectorTable(2).validated(table).collect()


def test_distances_by_batches_equal_expressions(spark):
    rows = [(1, [1.0, 2.0, -3.0]), (2, None), (3, [1.0, None, 0.0]), (4, [1.0, 2.0]), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [1.0, 2.0, -3.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>").coalesce(1)
    for metric, by_expression in V.DISTANCES.items():
        got = df.select("id", V.distance_to(F.col("v"), [1, 0, 2], metric).alias("a"), V.distance_to(V.pack("v"), [1, 0, 2], metric).alias("p"), by_expression(F.col("v"), V.literal([1, 0, 2])).alias("e")).collect()
        for r in got:
            assert r["a"] == r["p"]
            assert r["a"] is None if r["e"] is None or r["e"] != r["e"] else r["a"] == pytest.approx(r["e"], abs=1e-12)
        assert got[0]["a"] == got[6]["a"] is not None and got[1]["a"] is None and got[5]["a"] is None


def test_packing_is_reversible(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0], [-128, 127]), (2, [], []), (3, None, None)], "id long, f array<float>, i array<tinyint>")
    for c, back in (("f", V.unpack_float), ("i", V.unpack_int8)):
        got = df.select(F.col(c).alias("v"), back(V.pack(c)).alias("b"), F.octet_length(V.pack(c)).alias("n")).collect()
        assert all(r["v"] == r["b"] for r in got) and [r["n"] for r in got] == [8 if c == "f" else 2, 0, None]
