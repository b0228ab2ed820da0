"""Queries that send tables through databases, stores, guarded paths and streams, and read back what arrived."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.functions import text as X
from lexweave.operators import similarity as S
from lexweave.operators import words as V
from lexweave.plans.headings import heads, neighbour_rank, texts
from lexweave.plans.matrix import documents
from lexweave.session import stage_path, staged, table
from lexweave.sources import embedded
from lexweave.sources import readers as R
from lexweave.sources import writers as W
from lexweave.streaming import requests

SHARE, SEED = 0.2, "7"


def _database(s) -> str:
    """An embedded database in the staging folder; other databases take another URL."""
    s.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:{_local(stage_path(s, 'db'))};create=true"


def _local(path: str) -> str:
    path = re.sub("^file:/+", "/", path)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return path


def _lower(df):
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


def _clean_headings(s, d):
    rows = table(s, d, "mesh_heading").select("pmid", F.trim("mesh").alias("mesh"), "major")
    return rows.filter("pmid is not null and mesh <> '' and major in ('Y', 'N')")


HEADING_COLUMNS = "mesh varchar(500), major varchar(10)"


def jdbc_headings(s, d):
    """The headings written to a database, scanned in steps, written as lines and read again."""
    url, path = _database(s), stage_path(s, "headings")
    W.jdbc(_clean_headings(s, d).coalesce(1), url, "headings", createTableColumnTypes=HEADING_COLUMNS)
    W.tsv(R.jdbc(s, url, 'select "pmid", "mesh", "major" from headings'), path)
    return R.headings(s, path)


def jdbc_focus(s, d):
    """A table of ids made and filled in a database, and joined there with the headings."""
    url = _database(s)
    W.jdbc(_clean_headings(s, d).coalesce(1), url, "headings", createTableColumnTypes=HEADING_COLUMNS)
    W.jdbc(table(s, d, "qualifier").select("pmid").dropna().distinct().coalesce(1), url, "focus")
    for name in ("headings", "focus"):
        embedded.index(s, url, name, "pmid")
    return _lower(R.jdbc(s, url, 'select h."pmid", h."mesh", h."major" from focus f inner join headings h on f."pmid" = h."pmid"'))


def _citations(s, d):
    """The current articles, written to a database."""
    url = _database(s)
    rows = texts(s, d).select("pmid", F.coalesce("title", F.lit("")).alias("article_title"), F.coalesce("abs", F.lit("")).alias("abstract_text"))
    W.jdbc(rows.coalesce(1), url, "medline_citation", createTableColumnTypes="article_title varchar(4000), abstract_text varchar(32000)")
    return R.citations_jdbc(s, url)


def jdbc_abstracts(s, d):
    """All articles with an abstract, read from a database; TABs become spaces, other than ASCII is dropped."""
    return _citations(s, d)


def jdbc_lookup(s, d):
    """Title, abstract and headings of the first and the last article and of one that isn't there."""
    ids = texts(s, d).agg(F.min("pmid"), F.max("pmid")).first()
    rows, h = _citations(s, d), heads(s, d)
    out = []
    for pmid in sorted({i for i in ids if i is not None} | {-1}):
        title, abstract = R.title_and_abstract(rows, pmid, strip=True)
        own = h.filter(F.col("pmid") == pmid).agg(F.array_join(F.array_sort(F.collect_list("mesh")), "|")).first()[0]
        out.append((pmid, title, abstract, own))
    return s.createDataFrame(out, "pmid int, title string, abstract string, headings string")


def strict_documents(s, d):
    """Lines of three fields read by the strict reader, which would raise an error at any other."""
    path = stage_path(s, "strict")
    a = texts(s, d).select("pmid", *[F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n\r]", " ")).alias(c) for c in ("title", "abs")]).filter("abs <> ''")
    W.text(a.select(F.concat_ws("\t", F.col("pmid").cast("string"), "title", "abs").alias("value")), path)
    return R.documents(s, path, strict=True)


def neighbour_fetch(s, d):
    """Neighbours asked from a service for every article, written as lines and read. The service is a function of the id here."""
    path = stage_path(s, "fetched")
    ask = lambda pmid: [((pmid * 7 + k) % 100_003, 100 - k, "article_article") for k in range(3)]
    W.tsv(R.fetched_neighbours(heads(s, d).select("pmid").distinct(), ask), path)
    return R.neighbours(s, path)


def vector_file(s, d):
    """Vectors with their ids, written and read as a typed file."""
    path = stage_path(s, "vectors")
    W.parquet(table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec")), path)
    v = s.read.schema(schemas.FACTORS).parquet(path).select("doc_id", F.posexplode("vec").alias("i", "x"))
    return v.select("doc_id", "i", F.round("x", 6).alias("x"))


def guarded_paths(s, d):
    """(case, refused): whether a job with several outputs is refused before it writes, if one of them is there."""
    there, free = stage_path(s, "there"), stage_path(s, "free")
    W.parquet(table(s, d, "region"), there)
    out = []
    for case, paths in (("all free", [free]), ("one there", [free, there])):
        try:
            W.guard(s, *paths)
            out.append((case, False))
        except W.PathExists:
            out.append((case, True))
    return s.createDataFrame(out, "case string, refused boolean")


def dictionary_table(s, d):
    """The idfs of the vocabulary, a bounded dictionary, held by the driver and written as a table of two columns."""
    path = stage_path(s, "idfs")
    known = table(s, d, "vocab").filter("term is not null and idf is not null").groupBy("term").agg(F.max("idf").alias("idf"))
    W.dictionary(s, {r.term: r.idf for r in known.collect()}, path)
    return s.read.parquet(path)


def store_puts(s, d):
    """Scores put into a store by partition, in batches, the last one flushed; the store is a folder of lines here."""
    folder = _local(stage_path(s, "store"))
    os.makedirs(folder, exist_ok=True)
    rows = table(s, d, "pp_score").filter("score is not null and not isnan(score)").groupBy("src_pmid", "rel_pmid").agg(F.max("score").alias("score"))

    def connect() -> str:
        return f"{folder}/{uuid.uuid4().hex}"

    def put(client: str, held: list) -> None:
        with open(client, "a") as f:
            f.write("".join(f"{r.src_pmid}\t{r.rel_pmid}\t{r.score!r}\n" for r in held))

    W.key_value(rows, connect, put, 1000)
    return R.tsv(s, folder, schemas.SCORE)


def annotation_word_list(s, d):
    """The distinct words of each article's annotations, from annotation lines."""
    path = stage_path(s, "annotated")
    h = heads(s, d).select("pmid", F.explode(F.split("mesh", " ")).alias("word")).filter("word <> ''")
    line = F.concat_ws("\t", F.col("pmid").cast("string"), F.lit("0"), F.length("word").cast("string"), "word", F.lit("Gene"))
    W.text(h.select(line.alias("value")), path)
    return R.annotation_words(s, path)


def report_files(s, d):
    """A text file of the three best neighbours for each source, in a folder of its own."""
    path = stage_path(s, "reports")
    best = S.ranked(neighbour_rank(s, d).select("src_pmid", "rel_pmid", "score"), "src_pmid", "score", 3, "row_number", "rel_pmid")
    best = best.select("src_pmid", F.concat_ws("\t", "rank", "rel_pmid").alias("line"))
    if re.match("file:|/", path):
        best, folder = staged(best, "best"), _local(path)
        W.per_source_files(best, folder, "src_pmid", "line")
        return R.per_source_files(best.select("src_pmid").distinct(), folder, "src_pmid")
    W.per_source(best, path, "src_pmid", "line")
    return s.read.text(path).select(F.col("src_pmid").cast("int").alias("src_pmid"), "value")


def printed_stream(s, d):
    """(n_lines, n_batches): lines of new files that went through a stream, and the batches whose first lines it showed."""
    inbox, check = stage_path(s, "inbox"), stage_path(s, "check")
    W.text(table(s, d, "feed_line").select(F.regexp_replace(F.coalesce("line", F.lit("")), r"[\n\r]", " ").alias("value")), inbox)
    shown: list[str] = []
    query = requests.printed(s, inbox, check, shown.append)
    query.awaitTermination()
    sizes = [int(x.split()[2]) for x in shown if re.fullmatch(r"Batch \d+: \d+ lines", x)]
    return s.createDataFrame([(sum(sizes), len(sizes))], "n_lines long, n_batches long")


def bernoulli(s, d):
    """A sample without replacement: every row by itself with the chance SHARE, the same each time."""
    return V.sampled(table(s, d, "mesh_heading").select("pmid", "mesh", "major").dropna(), ["pmid", "mesh", "major"], SHARE, SEED)


def row_lookup(s, d):
    """The vector of one id, entry by entry; an id that isn't there would raise an error."""
    row = V.lookup(table(s, d, "embeddings"), "vec_id", 3)
    return s.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(row.embedding)], "i int, x double")


def lemma_terms(s, d):
    """(doc_id, lemma, tf): words of two letters or more by their lemmas, stop words left out."""
    words = S.term_frequencies(documents(s, d), "doc_id", X.drop_stop_words(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0))).select("doc_id", "term", "tf")
    lemmas = V.lemmas(words.select("term").distinct(), "term", words.select("term").distinct())
    return V.by_lemma(words, lemmas).groupBy("doc_id", "lemma").agg(F.sum("tf").alias("tf"))


QUERIES = {
    "jdbc_headings": jdbc_headings,
    "jdbc_focus": jdbc_focus,
    "jdbc_abstracts": jdbc_abstracts,
    "jdbc_lookup": jdbc_lookup,
    "strict_documents": strict_documents,
    "neighbour_fetch": neighbour_fetch,
    "vector_file": vector_file,
    "guarded_paths": guarded_paths,
    "dictionary_table": dictionary_table,
    "store_puts": store_puts,
    "annotation_word_list": annotation_word_list,
    "report_files": report_files,
    "printed_stream": printed_stream,
    "bernoulli_sample": bernoulli,
    "row_lookup": row_lookup,
    "path_scheme": lambda s, d: table(s, d, "feed_line").select("line_id", X.has_scheme(F.col("file_name"), "hdfs").alias("hdfs"), X.has_scheme(F.concat(F.lit("hdfs://"), "file_name"), "hdfs").alias("with_scheme")),
    "ascii_table": lambda s, d: V.table_lines(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey"),
    "lemma_terms": lemma_terms,
}


def SQL() -> dict[str, str]:
    from lexweave.plans.headings import _CUR, _HEADS, _NB

    clean = "select pmid, trim(mesh, ' ') mesh, major from mesh_heading where pmid is not null and trim(mesh, ' ') <> '' and major in ('Y', 'N')"
    tidy = lambda c: rf"regexp_replace(replace({c}, chr(9), ' '), '[^\x00-\x7F]', '', 'g')"
    strip = lambda c: rf"replace(regexp_replace({c}, '<AbstractText\s.+?>', '', 'g'), '</AbstractText>', '')"
    flat = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '[\t\n\r]', ' ', 'g'), ' ')"
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)
    rules = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(V.RULES))
    wide = "max(length(c{0}))"
    cell = "rpad(c{0}, cast(w{0} as int), ' ')"
    return {
        "jdbc_headings": f"select pmid, mesh, major = 'Y' major from ({clean})",
        "jdbc_focus": f"select pmid, mesh, major from ({clean}) where pmid in (select pmid from qualifier)",
        "jdbc_abstracts": f"with {_CUR} select pmid, coalesce({tidy('title')}, '') title, {tidy('abs')} abstract from cur where trim(abs, ' ') <> ''",
        "jdbc_lookup": f"with {_CUR}, {_HEADS}, i as (select min(pmid) pmid from cur union select max(pmid) from cur union select -1) select i.pmid, coalesce({tidy('title')}, '') title, coalesce({strip(tidy('abs'))}, '') abstract, coalesce((select string_agg(mesh, '|' order by mesh) from heads h where h.pmid = i.pmid), '') headings from i left join (select * from cur where trim(abs, ' ') <> '') c on c.pmid = i.pmid where i.pmid is not null",
        "strict_documents": f"with {_CUR} select cast(pmid as bigint) doc_id, {flat('title')} title, {strip(flat('abs'))} body from cur where {flat('abs')} <> ''",
        "neighbour_fetch": f"with {_HEADS} select pmid src, cast((cast(pmid as bigint) * 7 + k) % 100003 as int) rel, cast(100 - k as int) score, 'article_article' link_name from (select distinct pmid from heads), range(3) r(k)".replace("pmid src", "pmid src_pmid").replace("as int) rel,", "as int) rel_pmid,"),
        "vector_file": "with u as (select vec_id doc_id, unnest(embedding) x, unnest(range(len(embedding))) i from embeddings) select doc_id, cast(i as int) i, round(cast(x as double), 6) x from u",
        "guarded_paths": "select * from (values ('all free', false), ('one there', true)) t(\"case\", refused)",
        "dictionary_table": "select term as key, max(idf) as value from vocab where term is not null and idf is not null group by 1",
        "store_puts": "select src_pmid, rel_pmid, max(score) score from pp_score where score is not null and not isnan(score) group by 1, 2",
        "annotation_word_list": f"with {_HEADS} select distinct pmid, word from (select pmid, unnest(string_split(mesh, ' ')) word from heads) where word <> ''",
        "report_files": f"with {_NB} select src_pmid, row_number() over (partition by src_pmid order by score desc, rel_pmid) || chr(9) || rel_pmid as value from nbr qualify row_number() over (partition by src_pmid order by score desc, rel_pmid) <= 3",
        "printed_stream": "select count(*) n_lines, cast(count(*) > 0 as bigint) n_batches from feed_line",
        "bernoulli_sample": f"select pmid, mesh, major from mesh_heading where pmid is not null and mesh is not null and major is not null and cast('0x' || left(md5(concat_ws(chr(1), pmid, mesh, major, '{SEED}')), 8) as bigint) < {int(SHARE * (1 << 32))}",
        "row_lookup": "with u as (select unnest(embedding) x, unnest(range(len(embedding))) i from embeddings where vec_id = 3) select cast(i as int) i, round(cast(x as double), 6) x from u",
        "path_scheme": "select line_id, starts_with(file_name, 'hdfs') hdfs, starts_with('hdfs://' || file_name, 'hdfs') with_scheme from feed_line",
        "ascii_table": f"""with t as (select n_nationkey k, cast(n_nationkey as varchar) c0, n_name c1, cast(n_regionkey as varchar) c2 from nation),
w as (select greatest({wide.format(0)}, 11) w0, greatest({wide.format(1)}, 6) w1, greatest({wide.format(2)}, 11) w2 from t),
r as (select '+' || repeat('-', w0) || '+' || repeat('-', w1) || '+' || repeat('-', w2) || '+' rule from w),
l as (select 3 + row_number() over (order by k) as i, '|' || {cell.format(0)} || '|' || {cell.format(1)} || '|' || {cell.format(2)} || '|' line from t, w
  union all select 1, rule from r union all select 2, '|' || rpad('n_nationkey', cast(w0 as int), ' ') || '|' || rpad('n_name', cast(w1 as int), ' ') || '|' || rpad('n_regionkey', cast(w2 as int), ' ') || '|' from w union all select 3, rule from r)
select i, line from l union all select (select max(i) + 1 from l), rule from r""",
        "lemma_terms": f"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) term from documents), f as (select doc_id, term, count(*) tf from t where term not in ({stops}) group by all), v as (select distinct term from f),
r as (select * from (values {rules}) r(i, a, b)), c as (select term, i, left(term, length(term) - length(a)) || b base from v join r on ends_with(term, a)),
m as (select c.term, arg_min(c.base, i) lemma from c join v on v.term = c.base where length(c.base) >= {V.SHORTEST} group by 1)
select doc_id, coalesce(lemma, term) lemma, cast(sum(tf) as bigint) tf from f left join m using (term) group by 1, 2""",
    }
