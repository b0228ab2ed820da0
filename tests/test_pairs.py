"""Queries whose result has a row for each pair: the pairs come from blocks and aren't joined."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import frame
from lexweave.operators import headings as H
from lexweave.operators import products as P
from tests.test_whole import sql_rows


def holds(spark, sf, name):
    got = entry.queries()[name](spark, sf)
    want = sql_rows(sf, entry.oracle_sql()[name])
    assert len(want) and frame(got.toPandas()).equals(frame(want))


@pytest.fixture()
def no_joined_pairs(monkeypatch):
    def pair_rows(*_, **__):
        raise AssertionError("joined pairs")

    for name in ("relations", "concept_similarity"):
        monkeypatch.setattr(H, name, pair_rows)


@pytest.mark.parametrize("name", ["heading_jaccard", "concept_similarity", "heading_pivot", "summed_jaccard"])
def test_pairs_are_not_joined(spark, sf, no_joined_pairs, name):
    holds(spark, sf, name)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Records of up to 40 headings, a third of them major, and qualifiers that some records have without a heading."""
    at = tmp_path_factory.mktemp("crowded")
    loaded = "timestamp'2020-01-01' loaded_at"
    spark.sql(f"select cast(10 * (id % 37) as int) pmid, concat(' H', (id * id + id) % 41, ' ') mesh, if(id % 3 = 0, 'y', null) major, {loaded} from range(900)").write.parquet(str(at / "mesh_heading.parquet"))
    spark.sql("select cast(10 * (id % 43) as int) pmid, concat('d', id % 5) descriptor_name, concat('q', id % 3) qualifier_name, if(id % 4 = 0, 'Y', 'N') qualifier_name_major_yn from range(300)").write.parquet(str(at / "qualifier.parquet"))
    return str(at)


@pytest.mark.parametrize("name", ["heading_jaccard", "heading_pivot", "summed_jaccard"])
@pytest.mark.parametrize("most", [15, 2])
def test_digits_of_many_headings(spark, crowded, monkeypatch, name, most):
    """With 2 bits they don't hold the counts, and the pairs are joined."""
    monkeypatch.setattr(H, "COUNT", most)
    holds(spark, crowded, name)


def test_all_pairs_of_any_weights(spark):
    rnd = np.random.default_rng(5)
    a = [(int(t), int(s), int(w)) for t, s, w in zip(rnd.integers(0, 9, 60), rnd.integers(0, 20, 60), rnd.integers(-2, 3, 60), strict=True)]
    b = [(int(t), int(s), int(w)) for t, s, w in zip(rnd.integers(0, 9, 200), rnd.integers(0, 90, 200), rnd.integers(-2, 3, 200), strict=True)]
    want: dict = {}
    for t, s, w in a:
        for u, d, v in b:
            if t == u:
                want[s, d] = want.get((s, d), 0) + w * v
    left = spark.createDataFrame([(*r, r[1]) for r in a], "_t long, src int, _a long, _n long")
    right = spark.createDataFrame([(*r, 2 * r[1]) for r in b], "_t long, rel int, _b long, _n long")
    out = P.all_pairs(left, right, lambda units, n, m: {"u": units, "n": (n + m).astype(np.int64)}, "u long, n long")
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "int", "bigint", "bigint"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted((s, d, u, s + 2 * d) for (s, d), u in want.items()) and 0 in want.values()


def test_ratios_are_rounded_halves_up():
    """Of some denominators that reach ten decimals, and of others."""
    den = np.concatenate([np.arange(1, 200), [1024, 2048, 5120, 10240, 51200, 128000, 249999]])
    common, of = (x.reshape(-1) for x in np.meshgrid(np.arange(1, 40), den))
    exact = [float((Decimal(int(c)) / Decimal(int(n))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for c, n in zip(common, of, strict=True)]
    assert H._rounded(common, common + of).tolist() == exact
    assert H._rounded(np.array([0]), np.array([0])).tolist() == [0.0]


@pytest.mark.parametrize("cnt", ["1 + id % 3", "if(id % 7 = 0, null, 1 + id % 3)"])
def test_concepts_of_no_weight_and_of_null_counts(spark, tmp_path, cnt):
    """A concept of all records weighs 0 and its pairs stay; where all shared counts are null, the score is null."""
    spark.sql("select cast(id as int) pmid, 't' title, repeat('word ', int(id) % 4 + 1) abs, timestamp'2020-01-01' loaded_at from range(30)").write.parquet(str(tmp_path / "abstracts.parquet"))
    rows = f"select concat('h', id % 11) mesh, cast(id % 30 as int) pmid, cast({cnt} as int) cnt, false major from range(97)"
    spark.sql(f"{rows} union all select 'all', cast(id as int), 1, false from range({0 if 'null' in cnt else 30})").write.parquet(str(tmp_path / "posting_list.parquet"))
    holds(spark, str(tmp_path), "concept_similarity")
    got = entry.queries()["concept_similarity"](spark, str(tmp_path))
    assert got.filter("score is null" if "null" in cnt else "score = 0").count()
