from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import frequency as Q
from lexweave.llm.terms import BurstTrie, terms_of, trie_counts


@given(st.lists(st.text("abc1", min_size=0, max_size=6), max_size=300), st.integers(1, 5), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_trie_counts_as_a_counter(words, capacity, depth):
    trie = BurstTrie(capacity, depth)
    for w in words:
        trie.add(w, 2, 1)
    got = {prefix + suffix: tuple(n) for prefix, entries in trie.containers() for suffix, n in entries.items()}
    assert got == {w: (2 * n, n) for w, n in Counter(words).items()}
    assert all(len(prefix) <= depth for prefix, _ in trie.containers())


def test_terms():
    assert terms_of("The p53-gene, a B2 é x1") == ["the", "p53", "gene", "b2", "x1"]


@pytest.mark.parametrize("capacity, depth, limit", [(2, 3, 10**6), (50, 3, 10**6), (2048, 64, 10**6), (2, 64, 10**6), (2, 64, 3)])
def test_merged_subtrees_equal_a_count(spark, capacity, depth, limit):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["alpha", "alps", "al", "beta", "bet", "longcommonbeginning" + str(rnd.randrange(90)), f"w{rnd.randrange(300)}"]) for _ in range(rnd.randrange(30))) for _ in range(200)] + [None, "", "  - "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    counts, total = trie_counts(df, text="t", capacity=capacity, depth=depth, limit=limit)
    got = {r.term: (r.occurrences, r.records) for r in counts.collect()}
    occ, rec = Counter(), Counter()
    for t in texts:
        occ.update(terms_of(t or ""))
        rec.update(set(terms_of(t or "")))
    assert got == {w: (occ[w], rec[w]) for w in occ}
    assert total == sum(bool(terms_of(t or "")) for t in texts)


def test_marks(spark):
    df = spark.createDataFrame([("a", 1, 9), ("b", 1, 10), ("c", 1, 30), ("d", 1, 31)], "term string, occurrences int, records int")
    assert {r.term: r.mark for r in Q.marked(df, 100).collect()} == {"a": "rare", "b": None, "c": None, "d": "common"}


def test_values_without_a_key_or_a_value(spark):
    data = [(1, " Human "), (1, "HUMAN"), (2, "human"), (None, "human"), (3, None), (4, "  ")]
    got = Q.value_frequency(spark.createDataFrame(data, "pmid int, mesh string"), "pmid", "mesh").collect()
    assert [(r.term, r.occurrences, r.records, r.mark) for r in got] == [("human", 4, 2, "rare")]


def test_empty_and_odd_tables(spark, empty_sf, odd_sf, sf):
    assert Q.p1_found(spark, empty_sf).count() == 0
    plain, odd = ({(r.fld, r.term): r.records for r in Q.p1_terms(spark, d).collect()} for d in (sf, odd_sf))
    assert plain == odd
