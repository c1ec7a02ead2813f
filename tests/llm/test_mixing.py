import hashlib

import pytest
from helpers import documents, split
from pyspark.sql import functions as F

from lanternfish.llm import mixing


def brute_targets(sizes, budget=1.5, weights=(5, 2, 1), most=2):
    """{source: target} by raising a common level until all capped and free targets sum to the budget."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, wanted = set(), budget * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = wanted - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / share > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else left * weight[s] / share for s in order}
        capped |= over


def brute_mix(rows):
    """{doc_id: (size, source_size, target, taken)} with each source read in the order of the md5 of doc_id."""
    sizes, by = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
        by.setdefault(s, []).append((hashlib.md5(str(i).encode()).hexdigest(), len(split(t)), i))
    targets, out = brute_targets(sizes), {}
    for s, docs in by.items():
        left, total = {}, int(targets[s] + 0.5)
        for _ in range(2):
            for _, n, i in sorted(docs):
                take = max(0, min(n, total))
                total -= take
                left[i] = left.get(i, 0) + take
        for _, n, i in docs:
            out[i] = (n, sizes[s], targets[s], left[i])
    return out


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_against_brute_force(spark):
    docs = documents(spark)
    want = brute_mix(rows_of(docs))
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert got.keys() == want.keys()
    for i, (n, source, target, taken) in want.items():
        r = got[i]
        assert (r["size"], r["source_size"]) == (n, source)
        assert r["target"] == pytest.approx(target)
        assert r["taken"] == taken <= 2 * n


def test_hot_source_and_caps(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 11)), "big" if i % 3 else f"s{i % 30}") for i in range(900)]
    want = brute_mix(rows)
    got = {r["doc_id"]: r for r in mixing.mix(documents(spark, rows)).collect()}
    assert {i: r["taken"] for i, r in got.items()} == {i: w[3] for i, w in want.items()}
    by_source = {}
    for i, _, s in rows:
        by_source.setdefault(s, []).append(got[i])
    for rs in by_source.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 0.5
        assert rs[0]["target"] <= 2 * rs[0]["source_size"]


def test_query_places_and_sorts_copies(spark, tmp_path):
    """The registered query's rows stand in the order of the brute-force positions of their first copies."""
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(800)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want, sizes, by, first = brute_mix(rows), {}, {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
        by.setdefault(s, []).append((hashlib.md5(str(i).encode()).hexdigest(), len(split(t)), i))
    targets = brute_targets(sizes)
    for s, docs in by.items():
        k, start = sorted(by).index(s) % 3, 0
        both = [w[k] * 0.5 for _, w in mixing.PHASES]
        for epoch in range(2):
            for _, n, i in sorted(docs):
                asked = start / targets[s] * sum(both)
                if start < int(targets[s] + 0.5):
                    at = min(1.0, 0.5 * asked / both[0] if asked <= both[0] else 0.5 + 0.5 * (asked - both[0]) / both[1])
                    first.setdefault(i, []).append(at)
                start += n
    mixed = {r["doc_id"]: r for r in mixing.mix(documents(spark, rows)).collect()}
    assert all(mixed[i]["positions"] == pytest.approx(first.get(i, [])) for i, _, _ in rows)
    out = mixing.query(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {i: w[3] for i, w in want.items()}
    order = [first.get(r["doc_id"], [2.0])[0] for r in out]
    assert all(b - a > -1e-9 for a, b in zip(order, order[1:]))


def test_reruns_agree(spark):
    docs = documents(spark)
    a, b = (sorted(map(repr, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b


def test_weights_follow_the_schedule():
    for k, want in enumerate((5.0, 2.0, 1.0)):
        begin = total = 0.0
        for end, weights in mixing.PHASES:
            total, begin = total + weights[k] * (end - begin), end
        assert total == want


def test_positions_invert_cumulative_demand(spark):
    """Up to any time, each source has given what the integral of its weights asks for."""
    rows = [(i, "a b c d e f g h i j", f"s{i % 3}") for i in range(1800)]
    out = mixing.training_order(documents(spark, rows)).select("source", "mix_position", F.size(F.split("text", " ")).alias("n")).collect()
    positions = [r["mix_position"] for r in out]
    assert positions == sorted(positions)
    for k in range(3):
        own = [r for r in out if r["source"] == f"s{k}"]
        total = sum(r["n"] for r in own)
        for at in (0.25, 0.5, 0.75):
            begin = asked = whole = 0.0
            for end, weights in mixing.PHASES:
                asked += weights[k] * max(0.0, min(end, at) - begin)
                whole, begin = whole + weights[k] * (end - begin), end
            assert sum(r["n"] for r in own if r["mix_position"] < at) / total == pytest.approx(asked / whole, abs=0.02)


def test_copies_stay_near_targets(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(800)])
    targets = {r["source"]: r["target"] for r in mixing.source_targets(docs.select("source", F.size(F.split(F.trim("text"), " ")).cast("long").alias("size"))).collect()}
    out = mixing.training_order(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n"), F.max("mix_epoch").alias("e")).collect()
    for r in out:
        assert abs(r["n"] - targets[r["source"]]) <= 9
        assert r["e"] <= 1


def test_empty_and_clashing_columns(spark):
    empty = documents(spark, [])
    assert mixing.mix(empty).count() == 0 == mixing.training_order(empty).count()
    odd = documents(spark).withColumns({c: F.lit("x") for c in ("size", "bucket", "target", "order_key", "rank", "weight", "a.b")})
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.training_order(odd).columns == [*odd.columns, "mix_epoch", "mix_position"]
    assert mixing.training_order(odd).filter("target = 'x'").count() > 0
    nulls = documents(spark, [(None, None, None), (1, "a b", "s"), (1, "a b", "s")])
    assert sorted(r["size"] for r in mixing.mix(nulls).collect()) == [0, 2, 2]
