"""Problem 1: frequency of every distinct value or term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.terms import trie_counts
from lexweave.operators.current import current_rows
from lexweave.session import table

RARE, COMMON = 10, 0.3


def heading(col: str):
    """A heading as it is compared: outer spaces removed, lower case; null where nothing is left."""
    return F.nullif(F.lower(F.trim(F.col(col))), F.lit(""))


def marked(counts: DataFrame, total: int, rare: int = RARE, common: float = COMMON) -> DataFrame:
    """Adds `mark`: rare below `rare` records, else common above the share `common` of all records, else null."""
    return counts.withColumn(
        "mark", F.when(F.col("records") < rare, "rare").when(F.col("records") > F.lit(common * total), "common")
    )


def text_frequency(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(term, occurrences, records, mark) of the current text of every key.

    Null keys, null and empty texts count as no record. Repeated rows of a key count once.
    """
    counts, total = trie_counts(current_rows(df, key, order, [text]), text=text)
    return marked(counts, total)


def value_frequency(df: DataFrame, key: str, value: str) -> DataFrame:
    """(term, occurrences, records, mark) of the headings in `value`; records are distinct keys.

    Null and empty values are ignored; a row with a null key counts as an occurrence, of no record.
    """
    rows = df.select(F.col(key).alias("_k"), heading(value).alias("_t")).filter("_t is not null")
    pairs = rows.groupBy("_k", "_t").agg(F.count(F.lit(1)).alias("_n")).withColumn("_r", F.col("_k").isNotNull().cast("long"))
    total = rows.filter("_k is not null").select("_k").distinct().count()
    counts, _ = trie_counts(pairs, term="_t", n="_n", r="_r")
    return marked(counts, total)


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fld, term, occurrences, records, mark) for the terms of abstracts and the headings of posting_list."""
    text = text_frequency(table(spark, sf_dir, "abstracts"), "pmid", "abs", "loaded_at").withColumn("fld", F.lit("abs"))
    mesh = value_frequency(table(spark, sf_dir, "posting_list"), "pmid", "mesh").withColumn("fld", F.lit("mesh"))
    return text.unionByName(mesh).select("fld", "term", "occurrences", "records", "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fld, term, mark) of the terms and headings that are too rare or too common."""
    return p1_terms(spark, sf_dir).filter("mark is not null").select("fld", "term", "mark")


SQL_CURRENT = "select pmid, abs from abstracts where pmid is not null qualify row_number() over (partition by pmid order by loaded_at desc nulls last) = 1"

P1_TERMS_SQL = f"""
with cur as ({SQL_CURRENT}),
t as (select pmid, unnest(regexp_extract_all(lower(abs), '[a-z0-9]{{2,}}')) term from cur),
n as (select count(distinct pmid) n from t),
h as (select pmid, nullif(lower(trim(mesh, ' ')), '') term from posting_list),
hn as (select count(distinct pmid) n from h where term is not null),
a as (select 'abs' fld, term, count(*) occurrences, count(distinct pmid) records, (select n from n) n from t group by term
  union all select 'mesh', term, count(*), count(distinct pmid), (select n from hn) from h where term is not null group by term)
select fld, term, occurrences, records, case when records < {RARE} then 'rare' when records > {COMMON} * n then 'common' end mark from a
"""

P1_FOUND_SQL = f"select fld, term, mark from ({P1_TERMS_SQL}) where mark is not null"

QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms}
SQL = {"p1_found": P1_FOUND_SQL, "p1_terms": P1_TERMS_SQL}
