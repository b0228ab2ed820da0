from __future__ import annotations

import random

import pytest

from lexweave.llm import topn as Q
from lexweave.session import drop_staged


def brute(data, n):
    best = {}
    for g, i, s in data:
        if None not in (g, i, s) and s == s:
            best[g, i] = max(s, best.get((g, i), float("-inf")))
    groups = {}
    for (g, i), s in best.items():
        groups.setdefault(g, []).append((-s, i))
    return {(g, i, -s) for g, items in groups.items() for s, i in sorted(items)[:n]}


@pytest.mark.parametrize("shard_rows, row_group", [(500_000, 20_000), (50, 10)])
def test_as_brute_force(spark, shard_rows, row_group):
    rnd = random.Random(7)
    data = [(0, rnd.randrange(900), rnd.randrange(40) / 4) for _ in range(1500)]
    data += [(rnd.randrange(1, 200), rnd.randrange(60), rnd.choice([1.0, 2.0, -1.0, rnd.random()])) for _ in range(1500)]
    data += [(1, 5, None), (1, 5, float("nan")), (None, 1, 1.0), (2, None, 1.0), (300, 1, float("-inf")), (300, 2, float("inf"))]
    df = spark.createDataFrame(data, "g int, i int, s double").repartition(4)
    got = Q.top_n(df, "g", "i", "s", 10, shard_rows, row_group).collect()
    assert {(r.g, r.i, r.s) for r in got} == brute(data, 10) and len(got) == len(brute(data, 10))


def test_row_groups_are_skipped(spark):
    data = [(0, i, float(i)) for i in range(4000)]
    df = spark.createDataFrame(data, "g int, i int, s double").coalesce(1)
    got = Q.top_n(df, "g", "i", "s", 10, 10_000, 200).collect()
    assert {r.i for r in got} == set(range(3990, 4000))
    assert all(r.n_read == 1 and r.n_groups >= 10 for r in got)


def test_equal_scores_at_the_cut_are_all_looked_at(spark):
    data = [(0, i, 1.0) for i in random.Random(1).sample(range(3000), 3000)]
    got = Q.top_n(spark.createDataFrame(data, "g int, i int, s double"), "g", "i", "s", 5, 10_000, 100).collect()
    assert sorted(r.i for r in got) == [0, 1, 2, 3, 4]


def test_empty_and_odd_tables(spark, empty_sf, odd_sf, sf):
    assert Q.p7_found(spark, empty_sf).count() == 0
    plain, odd = (sorted(tuple(r) for r in Q.p7_top(spark, d).collect()) for d in (sf, odd_sf))
    assert plain == odd


def test_a_kept_copy_is_asked_again(spark):
    data = [(g, i, float(i * 7 % 1000)) for g in range(3) for i in range(1000 if g else 3000)]
    path = Q.clustered(spark.createDataFrame(data, "g int, i int, s double"), "g", "i", "s", 10_000, 100)
    for n in (1, 10):
        got = Q.best_of(spark, path, n).collect()
        assert {(r.g, r.i, r.s) for r in got} == brute(data, n)
        assert all(r.n_read < r.n_groups for r in got)


def test_the_copy_of_a_table_is_kept(spark, sf):
    first = Q._scores(spark, sf)
    assert Q._scores(spark, sf) == first
    drop_staged()
    assert Q._scores(spark, sf) != first and Q.p7_found(spark, sf).count() > 0
