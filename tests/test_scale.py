import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clauselake.operators import scale


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice([None, None, i]), round(rng.random() * 9, 1)) for i in range(500)]
    return spark.createDataFrame(data, "id long, k string, v long, x double").repartition(5)


def test_number_rows(rows):
    got = scale.number_rows(rows, ["k"], "id", "n", width=16)
    plain = got.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert plain.filter("n <> w").count() == 0 and plain.count() == 500


def test_carry_forward(rows):
    got = scale.carry_forward(rows, ["k"], ["id"], F.floor(F.col("id") / 16), "v", "last_v")
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    plain = got.withColumn("w", F.last("v", ignorenulls=True).over(w))
    assert plain.filter(~F.col("last_v").eqNullSafe(F.col("w"))).count() == 0 and plain.count() == 500


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_index_percentiles(rows, accuracy):
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.k, r.p): r.x for r in scale.index_percentiles(rows, ["k"], "x", ps, accuracy).collect()}
    values: dict[str, list[float]] = {}
    for r in rows.collect():
        values.setdefault(r.k, []).append(r.x)
    want = {(k, p): sorted(v)[min(len(v) - 1, int(len(v) * p))] for k, v in values.items() for p in ps}
    assert got == want


@pytest.mark.parametrize("most", [64, 100])
def test_index_percentiles_by_cells(rows, most):
    few = rows.withColumn("x", F.when(F.col("id") % 3 == 0, F.lit(4.0)).otherwise(F.col("x") + F.col("id") / 1000))  # one heavy value
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.k, r.p): (r.n, r.x) for r in scale.index_percentiles(few, ["k"], "x", ps, 20, most).collect()}
    values: dict[str, list[float]] = {}
    for r in few.collect():
        values.setdefault(r.k, []).append(r.x)
    assert got == {(k, p): (len(v), sorted(v)[min(len(v) - 1, int(len(v) * p))]) for k, v in values.items() for p in ps}


def test_a_bracket_of_a_million_values(spark, monkeypatch):
    n, most, seen = 2_500_000, 10_000, []
    df = spark.range(n).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % n).alias("x"))
    narrowed = scale._narrowed
    monkeypatch.setattr(scale, "_narrowed", lambda counts, wanted, *rest: seen.append((wanted, narrowed(counts, wanted, *rest))) or seen[-1][1])
    got = scale.index_percentiles(df, ["k"], "x", [0.5, 0.95], accuracy=20, most=most, store=lambda d: d.checkpoint())
    assert {r.p: r.x for r in got.collect()} == {0.5: n // 2, 0.95: int(n * 0.95)}
    first, last = seen[0][0].filter("p = 0.5").first(), seen[-1][1].collect()
    assert first.hi - first.lo >= 500_000 and len(seen) == 2
    assert all(r.hi - r.lo < most and r.lo <= r._at <= r.hi for r in last)



def test_index_percentile_of_one_and_of_equals(spark):
    df = spark.createDataFrame([("a", 2.0)] + [("b", 1.0)] * 50, "k string, x double")
    got = {(r.k, r.p): r.x for r in scale.index_percentiles(df, ["k"], "x", [0.5, 0.95]).collect()}
    assert got == {("a", 0.5): 2.0, ("a", 0.95): 2.0, ("b", 0.5): 1.0, ("b", 0.95): 1.0}


def test_frames_in_blocks(rows):
    numbered = scale.number_rows(rows, ["k"], "id", "pos", width=64)
    blocked = scale.in_blocks(numbered, ["k"], "pos", 6, width=16)
    w = Window.partitionBy("k", "_blk").orderBy("pos").rowsBetween(-6, -1)
    got = blocked.withColumn("s", F.sum("id").over(w)).filter(~F.col("_copy"))
    plain = got.withColumn("w", F.sum("id").over(Window.partitionBy("k").orderBy("pos").rowsBetween(-6, -1)))
    assert plain.filter(~F.col("s").eqNullSafe(F.col("w"))).count() == 0 and plain.count() == 500


def test_top_k_limits_before_the_exchange(rows):
    plan = scale.top_k(rows, ["k"], [F.col("x").desc(), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert scale.keep_first(rows, ["k"], [F.col("id")]).count() == 4


def test_numbering_of_sparse_ids_is_split(spark):
    ids = spark.range(600).select((F.col("id") * 10**15 - 10**17).alias("id"), F.lit("hot").alias("k"))
    got = scale.number_rows(ids, ["k"], "id", "n", width=50)
    assert [r.n for r in got.orderBy("id").collect()] == list(range(1, 601))
    assert scale.number_rows(ids.limit(0), ["k"], "id", "n").collect() == []


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    texts = spark.createDataFrame([("x" * 1000,)] * 5, "t string")
    assert scale.is_small(texts) and not scale.is_small(texts, 4000)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 2000)
    assert "broadcast" not in scale.broadcast_if(texts)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in scale.broadcast_if(spark.range(3), 3)._jdf.queryExecution().logical().toString().lower()
