"""Queries that search nothing take all rows, not the stated set of sources."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import frame


def sql_rows(sf, sql):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    return db.execute(sql).df()


@pytest.mark.parametrize("name", ["composite_join", "union_branches", "top_words", "small_postings", "chunk_ids", "report_text"])
def test_all_ids(spark, sf, name):
    want = sql_rows(sf, re.sub(r"(\w+) % 100 = 0", r"\1 is not null", entry.oracle_sql()[name]))
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got) and frame(got).equals(frame(want))


def test_scores_are_all_there_in_order(spark, sf):
    sql = entry.oracle_sql()["first_scores"]
    want = [tuple(r) for r in sql_rows(sf, sql.removesuffix(" limit 1000")).itertuples(index=False)]
    got = [tuple(r) for r in entry.queries()["scores_by_text_id"](spark, sf).collect()]
    assert len(got) > 1000 and got == want
    assert [tuple(r) for r in entry.queries()["first_scores"](spark, sf).collect()] == want[:1000]


def test_exclusion_looks_at_all_articles(spark, tmp_path):
    """The articles without headings come after more others than the limit once was."""
    n = 1200
    texts = spark.range(n).selectExpr("cast(id as int) pmid", "concat('t', id) title", "if(id % 300 = 7, '', 'abs') abs", "timestamp'2020-01-01' loaded_at")
    texts.write.parquet(str(tmp_path / "abstracts.parquet"))
    spark.range(n - 5).selectExpr("cast(id as int) pmid", "'m' mesh", "'N' major", "timestamp'2020-01-01' loaded_at").write.parquet(str(tmp_path / "mesh_heading.parquet"))
    got = sorted(tuple(r) for r in entry.queries()["exclude_known"](spark, str(tmp_path)).collect())
    assert got == [(i, f"t{i}") for i in range(n - 5, n)]


def test_exclusion_keeps_the_limit_first(spark, tmp_path, monkeypatch):
    from lexweave.plans import relational

    spark.sql("select id pmid, concat('t', id) title, 'x' abs, timestamp'2020-01-01' loaded_at from range(9)").write.parquet(str(tmp_path / "abstracts.parquet"))
    spark.sql("select 1L pmid, 'm' mesh, 'N' major, timestamp'2020-01-01' loaded_at").write.parquet(str(tmp_path / "mesh_heading.parquet"))
    monkeypatch.setattr(relational, "LIMIT", 3)
    assert sorted(r.pmid for r in relational.exclude_known(spark, str(tmp_path)).collect()) == [0, 2]


def test_all_chunks_are_read_and_folders_can_be_pruned(spark, tmp_path):
    rows = [(s, r, float(r)) for s in range(16) for r in range(3)] + [(3, 0, float("nan")), (3, 1, None)]
    spark.createDataFrame(rows, "src_pmid int, rel_pmid int, score double").write.parquet(str(tmp_path / "pp_score.parquet"))
    df = entry.queries()["chunked_scores"](spark, str(tmp_path))
    got = sorted((r.src_pmid, r.rel_pmid, r.score, r.chunk) for r in df.collect())
    assert got == [(s, r, float(r), s % 8) for s in range(16) for r in range(3)]
    pruned = df.filter("chunk <> 3")
    assert {r.chunk for r in pruned.collect()} == set(range(8)) - {3}
    assert "PartitionFilters: [isnotnull(chunk" in pruned._jdf.queryExecution().toString()
