"""Queries that write a table in each of the formats and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import similarity as S
from lexweave.plans.headings import heads, neighbours, posts, texts
from lexweave.plans.matrix import _MAT, matrix
from lexweave.session import stage_path, table
from lexweave.sources import readers as R
from lexweave.sources import writers as W


def _one_line(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n\r]", " ")


def raw_documents(s, d):
    """Abstracts written as lines of three fields, and parsed; a line whose abstract is blank has too few fields."""
    path = stage_path(s, "raw")
    a = texts(s, d)
    W.text(a.select(F.concat_ws("\t", F.col("pmid").cast("string"), _one_line(F.col("title")), _one_line(F.col("abs"))).alias("value")), path)
    return R.documents(s, path)


def id_list(s, d):
    path = stage_path(s, "ids")
    W.text(matrix(s, d).select(F.col("pmid").cast("string").alias("value")).distinct(), path)
    return R.ids(s, path, 1000)


def qualifier_file(s, d):
    path = stage_path(s, "qualifiers")
    rows = table(s, d, "qualifier").filter("qualifier_name_major_yn in ('Y', 'N') and descriptor_name is not null and qualifier_name is not null")
    W.tsv(rows, path, header=True)
    return R.qualifiers(s, path)


def neighbour_file(s, d):
    path = stage_path(s, "neighbours")
    W.tsv(neighbours(s, d).select("src_pmid", "rel_pmid", F.floor("score").cast("int").alias("score"), "link_name"), path)
    return R.neighbours(s, path)


def posting_file(s, d):
    path = stage_path(s, "postings")
    W.tsv(posts(s, d).select("mesh", "pmid", "cnt", "major"), path)
    return R.postings(s, path)


def vocabulary_file(s, d):
    path = stage_path(s, "vocabulary")
    W.tsv(table(s, d, "vocab").select("term", "term_id").dropna(), path)
    return R.vocabulary(s, path)


def _round_trip(key, other):
    def run(s, d):
        path = stage_path(s, "lines")
        p = S.postings(matrix(s, d), key, other)
        W.text(p.select(X.line_of(F.col(key), F.array_join("pairs", "\t")).alias("value")), path)
        return R.weight_lines(R.lines(s, path), key, other).select("term_id", "pmid", "weight")

    return run


def double_tab_lines(s, d):
    path = stage_path(s, "lines")
    p = S.postings(matrix(s, d), "term_id", "pmid")
    W.text(p.select(F.concat_ws("\t\t", F.col("term_id").cast("string"), F.array_join("pairs", "\t\t")).alias("value")), path)
    return R.weight_lines(R.lines(s, path), "term_id", "pmid", "\t\t").select("term_id", "pmid", "weight")


def chunked(s, d):
    """Scores written in folders by chunk, and read as one table; a filter on the chunk would prune folders."""
    path = stage_path(s, "chunks")
    rows = table(s, d, "pp_score").filter("score is not null and not isnan(score)").groupBy("src_pmid", "rel_pmid").agg(F.max("score").alias("score"))
    W.chunked(rows.withColumn("chunk", F.col("src_pmid") % 8), path)
    return s.read.parquet(path).select("src_pmid", "rel_pmid", "score", "chunk")


def dictionary_file(s, d):
    path = stage_path(s, "dictionary")
    h = heads(s, d).select("mesh").distinct().select(F.md5("mesh").alias("cui"), F.col("mesh").alias("str"))
    h.write.csv(path, quoteAll=True, quote='"', escape='"')
    return R.dictionary(s, path)


def json_articles(s, d):
    path = stage_path(s, "json")
    a = texts(s, d)
    a.select("pmid", F.col("title").alias("articleTitle"), F.col("abs").alias("abstractText")).write.json(path)
    return R.articles_json(s, path)


def xml_articles(s, d):
    """Articles with their headings, written as XML and parsed."""
    path = stage_path(s, "xml")
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    h = heads(s, d).groupBy("pmid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("mesh")), lambda m: F.concat(F.lit("<DescriptorName>"), esc(m), F.lit("</DescriptorName>"))), "").alias("h"))
    a = texts(s, d).filter("title is not null").join(h, "pmid")
    each = F.concat(F.lit("<Citation><PMID>"), F.col("pmid").cast("string"), F.lit("</PMID><ArticleTitle>"), esc(F.col("title")), F.lit("</ArticleTitle>"), F.col("h"), F.lit("</Citation>"))
    W.xml_sets(a.select("pmid", each.alias("line")), path, "pmid", "line")
    return R.citations_xml(s, path).select("pmid", F.trim("title").alias("title"), F.array_join("headings", "|").alias("headings"))


def annotation_file(s, d):
    """Headings written as annotation lines of five or six fields, and those of one type read."""
    path = stage_path(s, "annotations")
    h = heads(s, d)
    kind = F.when(F.col("major"), "Gene").otherwise("Disease")
    line = F.concat_ws("\t", F.col("pmid").cast("string"), F.lit("0"), F.length("mesh").cast("string"), "mesh", kind, F.when(F.col("major"), F.md5("mesh")))
    W.text(h.select(F.explode(F.array(line, F.concat(F.col("pmid").cast("string"), F.lit("|t|title")))).alias("value")), path)
    rows = R.annotations(s, path)
    symbols = h.select(F.md5("mesh").alias("id"), F.upper("mesh").alias("symbol")).distinct()
    gene = R.entities(rows, "Gene", symbols)
    return gene.unionByName(R.entities(rows, "Disease"))


def distinct_ids(s, d):
    """The distinct article ids of the postings, in order."""
    return posts(s, d).select("pmid").distinct().orderBy("pmid")


QUERIES = {
    "raw_documents": raw_documents,
    "id_list": id_list,
    "qualifier_file": qualifier_file,
    "neighbour_file": neighbour_file,
    "posting_file": posting_file,
    "vocabulary_file": vocabulary_file,
    "posting_lines_parse": _round_trip("term_id", "pmid"),
    "doc_lines_parse": _round_trip("pmid", "term_id"),
    "double_tab_lines": double_tab_lines,
    "chunked_scores": chunked,
    "dictionary_file": dictionary_file,
    "json_articles": json_articles,
    "xml_parse": xml_articles,
    "annotation_file": annotation_file,
    "posting_ids": distinct_ids,
}


def SQL() -> dict[str, str]:
    from lexweave.plans.headings import _CUR, _HEADS, _NB, _POSTS

    flat = lambda c: f"regexp_replace(coalesce({c}, ''), '[\\t\\n\\r]', ' ', 'g')"
    strip = lambda c: f"replace(regexp_replace({c}, '<AbstractText\\s.+?>', '', 'g'), '</AbstractText>', '')"
    six = f"with {_MAT} select term_id, pmid, cast(printf('%.6f', weight) as double) weight from mat"
    return {
        "raw_documents": f"with {_CUR} select cast(pmid as bigint) doc_id, {flat('title')} title, {strip('rtrim(' + flat('abs') + ')')} body from cur where trim({flat('abs')}) <> ''",
        "id_list": f"with {_MAT} select distinct pmid from mat order by pmid limit 1000",
        "qualifier_file": "select pmid, descriptor_name, qualifier_name, qualifier_name_major_yn = 'Y' major from qualifier where qualifier_name_major_yn in ('Y', 'N') and descriptor_name is not null and qualifier_name is not null",
        "neighbour_file": f"with {_NB} select src_pmid, rel_pmid, cast(floor(score) as int) score, case when score >= 0 then 'article_article' else 'other' end link_name from nb",
        "posting_file": f"with {_POSTS} select mesh, pmid, cnt, major from posts",
        "vocabulary_file": "select term, term_id from vocab where term is not null and term_id is not null",
        "posting_lines_parse": six,
        "doc_lines_parse": six,
        "double_tab_lines": six,
        "chunked_scores": "select src_pmid, rel_pmid, max(score) score, src_pmid % 8 chunk from pp_score where score is not null and not isnan(score) group by 1, 2",
        "dictionary_file": f"with {_HEADS} select distinct md5(mesh) cui, mesh str from heads",
        "json_articles": f"with {_CUR} select pmid, coalesce(nullif(title, ''), 'no title') title, coalesce(nullif(abs, ''), 'no abstract') abstract from cur",
        "xml_parse": f"with {_CUR}, {_HEADS}, h as (select pmid, string_agg(mesh, '|' order by mesh) headings from heads group by 1) select pmid, trim(title) title, headings from cur join h using (pmid) where title is not null",
        "annotation_file": f"with {_HEADS} select pmid, case when major then upper(mesh) else mesh end word, case when major then md5(mesh) end id from heads",
        "posting_ids": f"with {_POSTS} select distinct pmid from posts",
    }
