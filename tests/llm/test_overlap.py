from __future__ import annotations

import itertools
import random
from collections import defaultdict
from fractions import Fraction

import pytest

from lexweave.llm import overlap as Q


def brute(sets, threshold, least):
    ok = {k: v for k, v in sets.items() if len(v) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(ok), 2) if len(ok[a] & ok[b]) >= threshold * len(ok[a] | ok[b])}


def made(seed, n=300, most=14):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    sets = {i: set(rnd.choices(words[: rnd.choice([10, 40])], k=rnd.randrange(1, most))) for i in range(n)}
    for i in range(n, n + 60):
        sets[i] = set(sets[rnd.randrange(n)])
        if i % 3 and sets[i]:
            sets[i].pop()
            sets[i].add("new")
    return sets


@pytest.mark.parametrize("max_subsets, threshold", [(4096, Fraction(3, 5)), (100, Fraction(3, 5)), (1, Fraction(4, 5)), (4096, Fraction(1, 2))])
def test_all_pairs_as_brute_force(spark, max_subsets, threshold):
    sets = made(5)
    df = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s] * 2, "pmid long, mesh string").repartition(4)
    member, once = Q.set_classes(df, "pmid", "mesh", 6)
    links = Q.overlap_join(once, threshold, 6, max_subsets)
    of = defaultdict(list)
    for r in member.collect():
        of[r["class"]].append(r.pmid)
    got = set()
    for r in links.collect():
        got |= {tuple(sorted(p)) for p in itertools.product(of[r.a], of[r.b])}
    for copies in of.values():
        got |= set(itertools.combinations(sorted(copies), 2))
    assert got == brute(sets, threshold, 6)


def test_needed_overlap():
    t = Fraction(3, 5)
    for a in range(1, 30):
        for b in Q.sizes_for(a, t, 1):
            c = Q.needed(a, b, t)
            assert Fraction(c, a + b - c) >= t and Fraction(c - 1, a + b - c + 1) < t


def test_class_table_counts_partners(spark, sf):
    pairs = [tuple(r) for r in Q.p4_found(spark, sf).collect()]
    n = defaultdict(int)
    for a, b in pairs:
        assert a < b
        n[a] += 1
        n[b] += 1
    got = {r.pmid: r.n_links for r in Q.p4_classes(spark, sf).collect()}
    assert {k: v for k, v in got.items() if v} == n and len(pairs) == len(set(pairs))


def test_empty_and_odd_tables(spark, empty_sf, odd_sf, sf):
    assert Q.p4_found(spark, empty_sf).count() == 0
    plain, odd = ({tuple(r) for r in Q.p4_found(spark, d).collect()} for d in (sf, odd_sf))
    assert plain == odd
