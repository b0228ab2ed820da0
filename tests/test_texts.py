from __future__ import annotations

import duckdb

from lexweave.functions import text as X
from lexweave.plans import registry


def test_tokens_of_every_sentence(spark, tmp_path):
    texts = ["The Title (One)\nBut Not lost. And DNA, too!  \n\nEnd", "Only one line", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.value for r in registry.queries()["first_line_tokens"](spark, str(tmp_path)).collect()}
    assert got == {0: "the|Title|One|but|Not|lost|and|DNA|too|end", 1: "only|one|line", 2: "", 3: None}


def test_tokens_are_those_of_sql_over_whole_texts(spark, sf):
    low = "case when length(w[1]) = 1 or substr(w[1], 2) = lower(substr(w[1], 2)) then lower(w[1]) else w[1] end"
    marks = X.MARKS.replace("'", "''")
    sql = rf"""with s as (select doc_id, list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: string_split(x, ' ')) s from '{sf}/documents.parquet'),
    f as (select doc_id, flatten(list_transform(s, lambda w: [{low}] || w[2:])) w from s)
    select doc_id, array_to_string(list_filter(list_transform(w, lambda x: trim(x, '{marks}')), lambda x: x <> ''), '|') from f"""
    got = [tuple(r) for r in registry.queries()["first_line_tokens"](spark, sf).collect()]
    assert sorted(got) == sorted(duckdb.sql(sql).fetchall()) and len(got) > 0
