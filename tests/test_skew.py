from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexweave.operators import skew as K


def _data(spark):
    data = [("hot", i % 700) for i in range(3000)] + [("warm", i) for i in range(900)] + [(f"k{i % 500}", i) for i in range(2000)] + [(None, 1)] * 50 + [("hot", None)] * 3
    return data, spark.createDataFrame(data, "k string, p int").repartition(3)


def test_per_key_equals_a_plain_count(spark):
    data, df = _data(spark)
    got = {r.k: (r.n_rows, r.n_records) for r in K.per_key(df, "k", "p", 8).collect()}
    n, p = Counter(k for k, _ in data if k), defaultdict(set)
    for k, x in data:
        if k and x is not None:
            p[k].add(x)
    assert got == {k: (n[k], len(p[k])) for k in n}


def test_heavy_keys_are_split_and_tasks_level(spark):
    _, df = _data(spark)
    cut, plan, heavy = K.fragments(df, "k", ["p"], 8)
    assert set(heavy) == {"hot", "warm"}
    shards = {r.k: r.n for r in plan.groupBy(F.col("__key").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert shards["hot"] >= 8 and shards["warm"] >= 2
    load = [r["count"] for r in cut.groupBy("__task").count().collect()]
    assert max(load) < 2.2 * sum(load) / 8


def test_fragment_join_equals_a_join(spark):
    _, df = _data(spark)
    small = spark.createDataFrame([("hot", 1, "a"), ("hot", 2, "b"), ("k3", 3, "c"), ("none", 4, "d"), (None, 5, "e")], "k string, v int, p string")
    got = sorted((r.k, r.p or 0, r.v, r.p_r) for r in K.fragment_join(df, small, "k", ["p"], 8).collect())
    want = sorted((r.k, r.p or 0, r.v, r.p_r) for r in df.join(small.withColumnRenamed("p", "p_r"), "k").collect())
    assert got == want


def test_plan_is_first_fit_by_size():
    plan = K.plan_of([("a", 80), ("b", 10)], 100, 4)
    assert {k: n for k, n, _, _ in plan} == {"a": 7, "b": 1}
    assert max(Counter(t for *_, t in plan).values()) == 2


def test_all_in_one_key_and_empty(spark):
    df = spark.createDataFrame([("x", i) for i in range(100)], "k string, p int")
    assert [tuple(r)[:3] for r in K.per_key(df, "k", "p", 4).collect()] == [("x", 100, 100)]
    assert K.per_key(df.limit(0), "k", "p", 4).count() == 0
