from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import distinctive as Q
from lexweave.llm.terms import terms_of

TEXTS = {1: "rare rare rare common word here", 2: "common word common word", 3: "lone", 4: None, 5: "", 6: "alpha beta alpha beta common", 7: "word here common gamma"}


def brute():
    docs = {k: terms_of(t or "") for k, t in TEXTS.items()}
    n = sum(bool(d) for d in docs.values())
    df = Counter(w for d in docs.values() for w in set(d))
    out = {}
    for k, d in docs.items():
        near = defaultdict(set)
        for i, a in enumerate(d):
            for b in d[i + 1 : i + Q.WINDOW]:
                if a != b:
                    near[a].add(b)
                    near[b].add(a)
        for w, tf in Counter(d).items():
            out[k, w] = (tf, len(near[w]), len(near[w]) * math.log(n / df[w]), tf * math.log(n / df[w]))
    return out


@pytest.mark.parametrize("vocabulary", [1000, -1])
def test_scores_as_brute_force(spark, vocabulary):
    df = spark.createDataFrame(list(TEXTS.items()), "k int, t string").repartition(3)
    got = {(r._key, r.term): (r.occurrences, r.degree, r.graph_weight, r.tf_idf) for r in Q.distinctive_terms(df, "k", "t", vocabulary=vocabulary).collect()}
    want = brute()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("vocabulary", [1000, -1])
def test_margin(spark, vocabulary):
    df = spark.createDataFrame(list(TEXTS.items()), "k int, t string")
    got = {(r._key, r.term) for r in Q.distinctive_terms(df, "k", "t", 1.7, vocabulary).collect()}
    by = defaultdict(list)
    for (k, w), x in brute().items():
        by[k].append((x[3], w))
    want = {(k, max(v)[1]) for k, v in by.items() if len(v) == 1 or sorted(v)[-1][0] > 1.7 * sorted(v)[-2][0]}
    assert got == want and (3, "lone") in got


@given(st.lists(st.lists(st.sampled_from("abcde"), min_size=1, max_size=25), min_size=1, max_size=6), st.sampled_from([1.0, 1.2, 1.7, 3.0]))
@settings(max_examples=150, deadline=None)
def test_the_graph_preselects_all_that_stand_out(texts, margin):
    texts = [" ".join(c * 2 for c in t) for t in texts]
    known = {c * 2: i for i, c in enumerate("abcde")}
    doc, code, occurrences, degree, _ = Q._graph(texts, known)
    idf = np.array([0.3, 1.0, 1.5, 2.0, 4.0])[code]
    got = Q._standing_out(doc, degree * idf, occurrences * idf, margin).tolist()
    score = occurrences * idf
    assert got == [i for i in range(len(doc)) if all(score[i] > margin * score[k] for k in range(len(doc)) if k != i and doc[k] == doc[i])]


def test_empty_and_odd_tables(spark, empty_sf, odd_sf, sf):
    assert Q.p5_found(spark, empty_sf).count() == 0 and Q.p5_weights(spark, empty_sf).count() == 0
    plain, odd = ({tuple(r) for r in Q.p5_found(spark, d).collect()} for d in (sf, odd_sf))
    assert plain == odd
