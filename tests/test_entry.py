from __future__ import annotations

import sys

import __spark_entry__ as entry


def test_keys():
    q, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= q.keys() and len(q) > 100


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_doesnt_import_llm():
    import subprocess

    code = "import sys; sys.modules['lexweave.llm'] = None\nimport __spark_entry__ as e\nassert e.llm is None and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(entry.__file__).parent))


def test_core_queries_survive_empty_and_odd_tables(spark, empty_sf, odd_sf):
    from lexweave.plans import registry

    for name in ("p3_found", "p3_abstracts", "p6_found", "p6_results", "p6_weighted", "similar_docs_rank", "heading_jaccard", "concept_similarity", "report_text"):
        assert registry.queries()[name](spark, empty_sf).count() == 0, name
        registry.queries()[name](spark, odd_sf).count()
