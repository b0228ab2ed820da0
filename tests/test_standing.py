"""Ranks of given pairs by shared keys, held against brute force; the query that takes them makes no row for each pair."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from lexweave.operators import headings as H
from lexweave.operators import standing
from tests.test_products import holds


@pytest.mark.parametrize("bits, pairs_at_once", [(0, 1 << 22), (3, 50), (12, 1 << 22)])
def test_ranks_equal_brute_force(spark, monkeypatch, bits, pairs_at_once):
    monkeypatch.setattr(standing, "BITS", bits)
    monkeypatch.setattr(standing, "PAIRS", pairs_at_once)
    rnd = random.Random(3)
    sets = {p: {f"k{int(30 * rnd.random() ** 3)}" for _ in range(rnd.randint(1, 6))} for p in range(80)} | {90: {"alone"}}
    pairs = {(rnd.randrange(40), rnd.randrange(95)) for _ in range(400)} | {(90, 1), (99, 2)}
    pairs = {(s, r) for s, r in pairs if s != r}
    want = Counter()
    by = defaultdict(set)
    for s, r in pairs:
        by[s].add(r)
    for s in by:
        n = {d: len(sets.get(s, set()) & x) for d, x in sets.items() if d != s}
        for r in by[s]:
            if n.get(r, 0) and 1 + sum(x > n[r] for x in n.values()) <= 7:
                want[s] += 1
    heads = spark.createDataFrame([(p, k) for p, x in sets.items() for k in x], "pmid int, mesh string")
    got = standing.among_best(spark.createDataFrame(sorted(pairs), "src int, rel int"), heads, "mesh", 7)
    assert want and {r.src: r.n for r in got.collect()} == want


def test_overlap_of_every_source_makes_no_pairs(spark, sf, monkeypatch):
    def pair_rows(*_, **__):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(H, "relations", pair_rows)
    holds(spark, sf, "neighbor_overlap_inner")


def test_overlap_of_no_source(spark, empty_sf):
    assert entry.queries()["neighbor_overlap_inner"](spark, empty_sf).collect() == []
