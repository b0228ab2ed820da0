"""Best products by blocks, held against brute force; queries that take them make no row for each pair."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from compare import frame
from lexweave.operators import headings as H
from lexweave.operators import products as P
from lexweave.operators import similarity as S
from lexweave.plans import matrix as M
from lexweave.session import staged
from tests.test_whole import sql_rows

KINDS = {"tied": [1, 2, 3], "signed": [-2, 0, 1, 2], "huge": [3 * 10**8 + 1, 10**8, 7]}


def brute(a, b):
    out = defaultdict(int)
    for t, s, x in a:
        for u, r, y in b:
            if t == u:
                out[s, r] += x * y
    return out


def first(pairs, k, how, keep_self):
    """(src, rel, units) by the rules of similarity.ranked."""
    out = set()
    for s in {s for s, _ in pairs}:
        rows = sorted((-u, r) for (x, r), u in pairs.items() if x == s and (keep_self or x != r))
        if how == "distinct":
            rows = [(u, min(r for v, r in rows if v == u)) for u in sorted({u for u, _ in rows})]
        worst = rows[min(k, len(rows)) - 1][0] if rows else 0
        out |= {(s, r, -u) for u, r in ([x for x in rows if x[0] <= worst] if how == "rank" else rows[:k])}
    return out


def by_blocks(own, b, reduced, sizes=None):
    b = sorted(b, key=lambda x: x[1])
    for lo in sorted({r // 7 for _, r, _ in b}):  # blocks of seven documents
        rows = [x for x in b if x[1] // 7 == lo and x[0] in own.terms]
        if rows:
            t, rel, w = (np.array(c) for c in zip(*rows, strict=True))
            ids, d = np.unique(rel, return_inverse=True)
            reduced.add(P.Block(own, np.searchsorted(own.terms, t), d, w, ids, np.array([(sizes or {}).get(int(i), 0) for i in ids])))
    return pa.Table.from_batches(reduced.result())


def data(kind, seed=1):
    rnd = random.Random(seed)
    b = [(t, p, rnd.choice(KINDS[kind])) for p in range(60) for t in rnd.sample(range(9), rnd.randint(1, 4))]
    b += [(t, p, rnd.choice(KINDS[kind])) for t, p, _ in rnd.sample(b, 20)]  # a term may have several rows
    return [x for x in b if x[1] % 3 == 0], b


def own_of(a, sizes=None):
    t, s, w = (pa.array(c, pa.int64()) for c in zip(*a, strict=True))
    return P.Own(pa.table({"src": s, "_t": t, "_a": w, "_n": pa.array([(sizes or {}).get(x[1], 0) for x in a], pa.int64())}))


@pytest.mark.parametrize("keep_self", [True, False])
@pytest.mark.parametrize("how", ["rank", "row_number", "distinct"])
@pytest.mark.parametrize("kind", list(KINDS))
@pytest.mark.parametrize("k", [2, 5, 100])
def test_best_equals_brute_force(monkeypatch, kind, how, keep_self, k):
    monkeypatch.setattr(P, "SOURCES", 8)
    a, b = data(kind)
    own = own_of(a)
    best = P.Best(own, k, how, keep_self, False)
    best.limit = 40
    got = by_blocks(own, b, best).to_pydict()
    assert set(zip(got["src"], got["rel"], got["units"], strict=True)) == first(brute(a, b), k, how, keep_self)


@pytest.mark.parametrize("kind", list(KINDS))
def test_totals_equal_brute_force(kind):
    a, b = data(kind)
    own, pairs = own_of(a), brute(a, b)
    got = by_blocks(own, b, P.Totals(own)).to_pydict()
    assert got["n"] == [sum(u != 0 for (x, _), u in pairs.items() if x == s) for s in got["src"]]
    assert got["units"] == [sum(u for (x, _), u in pairs.items() if x == s) for s in got["src"]]


@pytest.mark.parametrize("k", [1, 4, 100])
def test_ratios_equal_brute_force(k):
    b = list({(t, p): (t, p, 1) for t, p, _ in data("tied")[1]}.values())
    a = [x for x in b if x[1] % 3 == 0]
    sizes = defaultdict(int)
    for _, p, _ in b:
        sizes[p] += 1
    own = own_of(a, sizes)
    got = by_blocks(own, b, P.Best(own, k, "rank", True, True), sizes).to_pydict()
    ratio = {(s, r): round(u / (sizes[s] + sizes[r] - u), 9) for (s, r), u in brute(a, b).items()}
    assert {(s, r, round(u / n, 9)) for s, r, u, n in zip(got["src"], got["rel"], got["units"], got["of"], strict=True)} == first(ratio, k, "rank", True)


def test_documents_are_read_whole(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(P, "READ", 4)
    rows = [(t, p, 1, 0) for p in range(9) for t in range(1 + (5 * p) % 11)]
    spark.createDataFrame(rows, "_t long, rel long, _b long, _n long").coalesce(1).sortWithinPartitions("rel").write.parquet(str(tmp_path / "rows"))
    parts = list(P._documents([P._plain(f) for f in spark.read.parquet(str(tmp_path / "rows")).inputFiles()]))
    seen = [set(rel.tolist()) for _, rel, _, _ in parts]
    assert sum(map(len, seen)) == 9 and sum(len(p[0]) for p in parts) == len(rows)


@pytest.fixture()
def no_pairs(monkeypatch):
    def pair_rows(*_, **__):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(S, "product", pair_rows)


def holds(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got) and frame(got).equals(frame(sql_rows(sf, entry.oracle_sql()[name])))


@pytest.mark.parametrize("name", ["similar_docs_rank", "similar_docs_fixed_k", "similar_docs_distinct_scores"])
def test_ranked_queries_make_no_pairs(spark, sf, no_pairs, name):
    holds(spark, sf, name)


def test_zeros_are_counted_without_pairs(spark, sf, no_pairs):
    holds(spark, sf, "product_with_zeros")


@pytest.mark.parametrize("name", ["explain_pairs", "report_terms"])
def test_explained_pairs_come_from_blocks(spark, sf, no_pairs, name):
    holds(spark, sf, name)


@pytest.mark.parametrize("name", ["concept_top", "heading_rank"])
def test_best_headings_make_no_pairs(spark, sf, monkeypatch, name):
    def pair_rows(*_, **__):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(H, "concept_similarity", pair_rows)
    monkeypatch.setattr(H, "relations", pair_rows)
    holds(spark, sf, name)


def test_true_cells_are_all_found():
    rnd = np.random.default_rng(2)
    for shape in [(0, 5), (3, 5), (4, 6), (8, 16)]:
        for share in (0, 0.1, 1):
            mask = rnd.random(shape) < share
            assert P._true_at(mask).tolist() == np.flatnonzero(mask).tolist()


def test_the_kth_value_counts_ties_once():
    best = P.Best(own_of([(0, 0, 1)]), 1, "distinct", True, False)
    rows = np.array([[5.0] * 3 + [4.0] * 2 + [3.0] * 20, [7.0] * 25, [9.0, 8.0, 7.0] + [-np.inf] * 22])
    assert best.kth_value(rows).tolist() == [4.0, -np.inf, 8.0]


def test_a_first_block_gives_floors_of_different_values():
    """So that not every pair of the first blocks is held."""
    b = [(0, p, 1 + p % 50) for p in range(500)]
    own = own_of([(0, p, 1) for p in range(0, 500, 100)])
    best = P.Best(own, 3, "distinct", True, False)
    t, ids, w = (np.array(c) for c in zip(*b, strict=True))
    best.add(P.Block(own, t, np.arange(500), w, ids, np.zeros(500)))
    assert best.n <= 5 * 40
    got = pa.Table.from_batches(best.result()).to_pydict()
    assert set(zip(got["src"], got["rel"], got["units"], strict=True)) == first(brute([(0, p, 1) for p in own.ids.tolist()], b), 3, "distinct", True)


@pytest.mark.parametrize("name", ["similar_docs_fixed_k", "similar_docs_distinct_scores"])
def test_the_matrix_is_laid_by_document_once(spark, sf, monkeypatch, name):
    plans = {}

    def seen(df, stage):
        plans[stage] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, stage)

    monkeypatch.setattr(P, "staged", seen)
    monkeypatch.setattr(M, "staged", None)  # the matrix isn't written by itself
    holds(spark, sf, name)
    assert plans["rows"].count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(rel" not in plans["rows"]


def test_terms_too_many_to_send_leave_documents_whole(spark, sf, monkeypatch):
    monkeypatch.setattr(P, "is_small", lambda *_: False)
    holds(spark, sf, "similar_docs_fixed_k")
