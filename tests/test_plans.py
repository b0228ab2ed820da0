from __future__ import annotations

import pytest

from lexweave.operators.skew import fragment_join, keyed_join
from lexweave.plans import registry


def physical(df) -> str:
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan ==") :]


@pytest.mark.parametrize(
    "name",
    [
        "term_freq", "doc_freq", "similar_docs_rank", "explain_pairs", "heading_jaccard", "neighbor_rank", "posting_list", "synonym_count", "heading_synonym_sets", "concept_similarity",
        "composite_join", "lemma_terms", "dense_gram", "dense_tiles", "latent_topk", "svd_documents", "three_table_join", "pair_lookup", "p3_found", "p6_results",
    ],
)
def test_no_cross_joins_and_no_row_functions(spark, sf, name):
    plan = physical(registry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan


def test_scans_read_what_they_need(spark, sf):
    plan = physical(registry.queries()["term_freq"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = physical(registry.queries()["in_list"](spark, sf))
    assert "In(source" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    plan = physical(registry.queries()["neighbor_rank"](spark, sf))
    assert plan.count("WindowGroupLimit") == 2


def test_sums_are_taken_before_the_shuffle(spark, sf):
    plan = physical(registry.queries()["doc_freq"](spark, sf))
    assert "partial_count" in plan


def test_terms_are_counted_without_a_shuffle(spark, sf):
    assert "Exchange" not in physical(registry.queries()["term_freq"](spark, sf))


def test_texts_are_not_copied_for_their_synonyms(spark, sf):
    """The text is joined to one row of gathered synonyms, and only then are these exploded."""
    plan = physical(registry.queries()["synonym_count"](spark, sf))
    generate, join = plan.index("Generate explode"), plan.index("Join [pmid")
    assert generate < join


@pytest.mark.parametrize("limit", [100, 0])
def test_keyed_joins_are_the_same_either_way(spark, limit):
    big = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 50) as k", "id as v")
    small = spark.range(40).selectExpr("id as k", "id * 2 as w")
    out = keyed_join(big, small, "k", ["v"], limit)
    assert sorted(tuple(r) for r in out.select("v", "k", "w").collect()) == sorted((i, k, 2 * k) for i in range(3000) if (k := 0 if i % 3 == 0 else i % 50) < 40)
    assert ("BroadcastHashJoin [k" in physical(out)) == (limit == 100)


def test_a_hot_key_is_spread(spark):
    big = spark.range(4000).selectExpr("if(id % 4 > 0, 7, id) as k", "id as v")
    out = fragment_join(big, spark.range(4000).selectExpr("id as k"), "k", ["v"], 8)
    from pyspark.sql import functions as F

    per = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 4000 and max(r["count"] for r in per) < 1500
