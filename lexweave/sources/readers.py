"""Readers. Each gives a DataFrame and reads nothing on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.functions.text import drop_non_ascii, strip_sections, tabs_to_spaces, yes_no
from lexweave.sources.embedded import is_embedded, read


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value) of every line."""
    return spark.read.text(path)


def _fields(value: Column) -> Column:
    """TAB fields of a trimmed line, trailing empty ones left out."""
    return F.split(F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "\t+$", ""), "\t", -1)


def parse_documents(df: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, title, body) of lines with exactly three fields, section tags stripped from the body.

    Lines with another number of fields are dropped, or raise an error if strict; so does an id that isn't a number, which
    otherwise drops the line.
    """
    cut = df.select(_fields(F.col("value")).alias("f"))
    number = F.get("f", F.lit(0)).cast("string").try_cast("long")
    if strict:
        bad = F.raise_error(F.concat(F.lit("not three fields with a number first: "), F.array_join("f", "\t")))
        number = F.when((F.size("f") == 3) & number.isNotNull(), number).otherwise(bad.cast("long"))
    else:
        cut = cut.filter(F.size("f") == 3)
    out = cut.select(number.alias("doc_id"), F.get("f", F.lit(1)).alias("title"), strip_sections(F.get("f", F.lit(2))).alias("body"))
    return out if strict else out.filter("doc_id is not null")


def documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return parse_documents(lines(spark, path), strict)


def ids(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(pmid) of a list of ids, one to a line; with a limit the least ones."""
    out = lines(spark, path).select(F.trim("value").try_cast("int").alias("pmid")).filter("pmid is not null")
    return out if limit is None else out.orderBy("pmid").limit(limit)


def tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=header, quote="", escape="")


def qualifiers(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, descriptor_name, qualifier_name, major) of a file with a header; a flag other than Y or N raises an error."""
    rows = tsv(spark, path, schemas.QUALIFIER, header=True)
    return rows.select("pmid", "descriptor_name", "qualifier_name", yes_no(F.col("qualifier_name_major_yn")).alias("major"))


def neighbours(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.NEIGHBOUR)


def fetched_neighbours(ids: DataFrame, ask: Callable[[int], list[tuple[int, int, str]]]) -> DataFrame:
    """(src_pmid, rel_pmid, score, link_name) of what a service answers for each distinct id: (rel, score, link) tuples.

    Tasks ask for their own ids. An id that the service doesn't know gives no rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(int(i), *found) for i in part["pmid"] for found in ask(int(i))]
            yield pd.DataFrame(rows, columns=["src_pmid", "rel_pmid", "score", "link_name"])

    return ids.select("pmid").dropna().distinct().mapInPandas(run, schemas.NEIGHBOUR)


def headings(spark: SparkSession, path: str) -> DataFrame:
    rows = tsv(spark, path, schemas.HEADING)
    return rows.select("pmid", "mesh", yes_no(F.col("major")).alias("major"))


def per_source_files(ids: DataFrame, folder: str, source: str) -> DataFrame:
    """(source, value) of the lines of the files of these sources; tasks open their own, so that no folder is listed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i in part[source]:
                with open(f"{folder}/{source}={i}/part.txt", encoding="utf-8", newline="") as f:
                    rows += [(i, x) for x in f.read().split("\n")[:-1]]
            yield pd.DataFrame(rows, columns=[source, "value"])

    return ids.select(source).mapInPandas(run, f"{source} int, value string")


def postings(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.POSTING)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.VOCABULARY)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(cui, str) of a quoted CSV file."""
    return spark.read.csv(path, schema=schemas.DICTIONARY, quote='"', escape='"')


def weight_lines(df: DataFrame, key: str, other: str, sep: str = "\t") -> DataFrame:
    """(key, other, weight) of lines `key<sep>other,weight<sep>...`; fields that aren't pairs of numbers are skipped."""
    cut = df.select(F.split("value", sep).alias("f"))
    pairs = cut.select(F.get("f", F.lit(0)).try_cast("int").alias(key), F.explode(F.slice("f", F.lit(2), F.greatest(F.size("f"), F.lit(1)))).alias("p"))
    pair = F.split("p", ",")
    out = pairs.filter(F.size(pair) == 2).select(key, F.get(pair, F.lit(0)).try_cast("int").alias(other), F.get(pair, F.lit(1)).try_cast("double").alias("weight"))
    return out.dropna()


def articles_json(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract) of JSON articles; missing and empty texts become placeholders."""
    rows = spark.read.json(path, schema=schemas.ARTICLE)
    get = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return rows.select("pmid", get("articleTitle", "no title").alias("title"), get("abstractText", "no abstract").alias("abstract"))


def citations_xml(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(pmid, title, abstract, headings, n_words) of XML citations; rows without a number are dropped."""
    rows = spark.read.format("xml").option("rowTag", "Citation").schema(schemas.CITATION).load(path).filter("PMID is not null")
    out = rows.select(F.col("PMID").alias("pmid"), F.col("ArticleTitle").alias("title"), F.col("AbstractText").alias("abstract"), F.col("DescriptorName").alias("headings"))
    out = out.withColumn("n_words", F.size(F.split(F.coalesce("abstract", F.lit("")), r"\s+")))
    return out if limit is None else out.orderBy("pmid").limit(limit)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, start, end, word, type, id) of annotation lines; those that don't begin with a number and a TAB are dropped,
    a missing sixth field is null."""
    f = F.split("value", "\t")
    rows = lines(spark, path).filter(F.col("value").rlike(r"^\d+\t")).select(f.alias("f"))
    names = ["pmid", "start", "end", "word", "type", "id"]
    return rows.select(F.get("f", F.lit(0)).try_cast("int").alias("pmid"), *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names) if i])


def entities(df: DataFrame, kind: str, symbols: DataFrame | None = None) -> DataFrame:
    """(pmid, word, id) of annotations of one type; with (id, symbol) the words are the symbols, unknown ids dropped."""
    rows = df.filter(F.col("type") == kind).select("pmid", "word", "id")
    return rows if symbols is None else rows.join(symbols, "id").select("pmid", F.col("symbol").alias("word"), "id")


def annotation_words(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, word): the distinct words of each document."""
    return annotations(spark, path).select("pmid", "word").dropDuplicates(["pmid", "word"])


def request_files(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, key, value) of the control lines of request files, and (file, doc_id, title, body) of their documents.

    df has (value, file). A control line has two fields, the key `output` or `callback`.
    """
    cut = df.select("file", "value", _fields(F.col("value")).alias("f"))
    control = cut.filter((F.size("f") == 2) & F.get("f", F.lit(0)).isin("output", "callback")).select("file", F.get("f", F.lit(0)).alias("key"), F.get("f", F.lit(1)).alias("value"))
    docs = cut.filter(F.size("f") == 3).select("file", F.get("f", F.lit(0)).try_cast("long").alias("doc_id"), F.get("f", F.lit(1)).alias("title"), strip_sections(F.get("f", F.lit(2))).alias("body"))
    return control, docs.filter("doc_id is not null")


def jdbc(spark: SparkSession, url: str, query: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """The rows of a query, fetched in steps; partitioning options go through, but for an embedded database, which only the driver reads."""
    if is_embedded(url):
        return read(spark, url, query, fetch)
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch), **options).load()


def citations_jdbc(spark: SparkSession, url: str, table_name: str = "medline_citation", **options: str) -> DataFrame:
    """(pmid, title, abstract) of articles with an abstract; TABs become spaces, other than ASCII is dropped."""
    if is_embedded(url):
        rows = read(spark, url, f"select * from {table_name}", 10_000)
    else:
        rows = spark.read.format("jdbc").options(url=url, dbtable=table_name, **options).load()
    rows = rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns]).filter("trim(abstract_text) <> ''")  # a database may or may not take blanks for nothing
    tidy = lambda c: drop_non_ascii(tabs_to_spaces(F.col(c)))
    return rows.select("pmid", tidy("article_title").alias("title"), tidy("abstract_text").alias("abstract"))


def title_and_abstract(rows: DataFrame, pmid: int, strip: bool = False) -> tuple[str, str]:
    """Title and abstract of one article; two empty strings if it is missing."""
    row = rows.filter(F.col("pmid") == pmid).select(F.coalesce("title", F.lit("")), strip_sections(F.coalesce("abstract", F.lit(""))) if strip else F.coalesce("abstract", F.lit(""))).first()
    return (row[0], row[1]) if row else ("", "")
