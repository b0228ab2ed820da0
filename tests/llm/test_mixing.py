from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from lexweave.llm import mixing as Q

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("gone", 0.1, 2), (None, 0.2, 1), ("none", None, None)]


def made():
    rnd = random.Random(4)
    docs = [(i, "a", rnd.randrange(5, 50), 1.0) for i in range(400)]
    docs += [(1000 + i, "b", rnd.randrange(5, 50), rnd.choice([0.1, 1.0])) for i in range(100)]
    docs += [(2000 + i, "c", rnd.randrange(5, 50), 0.5) for i in range(10)]
    return docs + [(3000, "other", 9, 1.0), (3001, None, 9, 1.0), (3002, "a", 0, 1.0), (3003, "none", 8, 1.0)]


@pytest.mark.parametrize("edge_rows, round_bits, size", [(100_000, 12, "all"), (3, 4, "all"), (1, 12, "all"), (3, 4, "met"), (20, 4, 1000)])
def test_budgets_repeats_and_order(spark, edge_rows, round_bits, size):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, weight double")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    chosen, _ = Q.mixed(df, targets, size, edge_rows, round_bits)
    keys = {r.doc_id: r.k for r in df.select("doc_id", Q.sampling_key(df.doc_id, df.weight).alias("k")).collect()}
    tokens_of = Counter()
    for _, s, n, _ in docs:
        tokens_of[s] += n
    total = sum(tokens_of[s] for s in ("a", "b", "c", "none"))
    if size == "met":
        total = min(math.floor(tokens_of[s] * repeats / share) for s, share, repeats in TARGETS[:3])
    elif size != "all":
        total = size
    got = {r.doc_id: r.copies for r in chosen.collect()}
    want = {}
    for source, share, repeats in TARGETS[:4]:
        own = sorted((keys[i], i, n) for i, s, n, _ in docs if s == source and n)
        tokens = sum(n for *_, n in own)
        give = min(math.floor(share * float(total)), tokens * repeats)
        epochs = give // tokens if tokens else 0
        left = give - epochs * tokens
        for _, i, n in own:
            left -= n
            if epochs + (left >= 0):
                want[i] = epochs + (left >= 0)
    assert got == want


def test_keys_favour_weights(spark):
    df = spark.range(20_000).selectExpr("id", "if(id % 2 = 0, 1.0, 0.25) as w")
    first = df.withColumn("k", Q.sampling_key(df.id, df.w)).orderBy("k").limit(2000)
    n = Counter(r.w for r in first.collect())
    assert 3.2 < n[1.0] / n[0.25] < 4.8


def test_shares_of_the_test_data(spark, sf, empty_sf, odd_sf):
    out = {r.source: r for r in Q.p9_shares(spark, sf).collect()}
    assert abs(sum(r.share for r in out.values()) - 1) < 1e-9
    assert all((r.most_copies or 0) <= r.max_repeats for r in out.values()) and out["oldvault"].n_tokens == 0
    copies = defaultdict(int)
    for r in Q.p9_mix(spark, sf).collect():
        copies[r.source] += r.copies * r.n_tokens
    assert {s: r.n_tokens for s, r in out.items() if r.n_tokens} == copies
    assert Q.p9_mix(spark, empty_sf).count() == 0
    Q.p9_shares(spark, odd_sf).collect()
