from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import packing as Q
from lexweave.llm.tokens import VOCABULARY, encoding, sized, sized_and_weighed


@given(st.lists(st.integers(0, 100), max_size=200), st.integers(100, 150))
@settings(max_examples=150, deadline=None)
def test_containers_hold_and_are_few(sizes, capacity):
    bins = Q.pack(np.array(sizes, np.int64), capacity)
    load, large = Counter(), Counter()
    for b, s in zip(bins.tolist(), sizes):
        load[b] += s
        large[b] += s * 3 > capacity
    assert all(v <= capacity for v in load.values()) and all(v <= 2 for v in large.values())
    assert set(load) == set(range(len(load)))
    halves = sum(s * 2 > capacity for s in sizes)
    assert len(load) <= max(halves, 1.5 * sum(sizes) / capacity + 1) + 1


def test_best_fit():
    assert Q.pack(np.array([60, 55, 45, 40]), 100).tolist() == [0, 1, 1, 0]
    assert Q.pack(np.array([70, 80, 20, 30]), 100).tolist() == [1, 0, 0, 1]


@pytest.mark.parametrize("group_items", [50_000, 20])
def test_items_are_whole_unless_too_large(spark, group_items):
    items = [(i, n) for i, n in enumerate([5, 10, 0, 16, 17, 33, 1, None, 7, 8, 9] * 12)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long").withColumnRenamed("n_tokens", "n_tokens")
    limits = spark.createDataFrame([("a", 16), ("b", 100), ("bad", 0), ("null", None)], "limit_name string, capacity_tokens int")
    parts = defaultdict(list)
    load = Counter()
    for r in Q.packed(df, limits, group_items).collect():
        parts[r.limit_name, r.doc_id].append((r.part, r.start_token, r.n_tokens))
        load[r.limit_name, r.container_id] += r.n_tokens
    assert {k[0] for k in parts} == {"a", "b"} and len(parts) == 2 * len(items)
    caps = {"a": 16, "b": 100}
    assert all(v <= caps[k[0]] for k, v in load.items())
    for (name, doc), p in parts.items():
        n = items[doc][1] or 0
        assert sum(x[2] for x in p) == n and len(p) == max(1, -(-n // caps[name]))
        assert [x[:2] for x in sorted(p)] == [(i, i * caps[name]) for i in range(len(p))]


def test_sizes_are_whole_texts(spark):
    text = "Einige Wörter, <|endoftext|> and more. " * 500
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in sized(df, "text", ["doc_id"]).collect()}
    assert got == {1: len(encoding(VOCABULARY).encode_ordinary(text)), 2: 0, 3: 0}
    assert encoding(VOCABULARY).decode(encoding(VOCABULARY).encode_ordinary(text)) == text


def test_typical_texts_weigh_more(spark):
    plain = "The effect of the drug on the patients was small. We saw no change in the level of the marker."
    rows = [(i, plain) for i in range(50)] + [(100, "xqzv jjkw qqpz vvxk zzqj kxwv " * 20), (101, "the " * 400), (102, plain), (103, None), (104, "")]
    got = {r.doc_id: (r.n_tokens, r.weight) for r in sized_and_weighed(spark.createDataFrame(rows, "doc_id long, text string"), "text", ["doc_id"]).collect()}
    assert got[102] == got[0] and got[102][1] > 0.8 and max(got[100][1], got[101][1]) < 0.5 and got[103] == got[104] == (0, 0.0)


def test_fill_and_empty_and_odd_tables(spark, sf, empty_sf, odd_sf):
    for r in Q.p8_fill(spark, sf).collect():
        assert r.fill > 0.9 and r.n_containers <= 1.1 * r.least_containers + 1
    assert Q.p8_pack(spark, empty_sf).count() == 0
    Q.p8_pack(spark, odd_sf).count()
