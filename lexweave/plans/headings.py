"""Queries over headings, qualifiers, postings and external neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.functions import weights as W
from lexweave.operators import headings as H
from lexweave.operators import similarity as S
from lexweave.operators.current import current_rows
from lexweave.operators.skew import keyed_join
from lexweave.operators.standing import among_best
from lexweave.plans.matrix import _PROD, matrix, sources
from lexweave.session import staged, table

RELATED = 1000


def heads(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "mesh_heading").withColumn("mesh", F.nullif(F.lower(F.trim("mesh")), F.lit("")))
    return H.flagged(rows, ["mesh"], "major")


def quals(spark: SparkSession, sf: str) -> DataFrame:
    return H.flagged(table(spark, sf, "qualifier"), ["descriptor_name", "qualifier_name"], "qualifier_name_major_yn")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """(mesh, pmid, cnt, major): a heading's mentions in an article; rows repeated are one."""
    rows = table(spark, sf, "posting_list").withColumn("mesh", F.nullif(F.lower(F.trim("mesh")), F.lit(""))).dropna(subset=["mesh", "pmid"])
    return rows.groupBy("mesh", "pmid").agg(F.max("cnt").alias("cnt"), F.max(F.coalesce("major", F.lit(False))).alias("major"))


def small(df: DataFrame) -> DataFrame:
    return df.filter("pmid % 100 = 0")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return current_rows(table(spark, sf, "abstracts"), "pmid", "loaded_at", ["title", "abs"])


def heading_pivot(spark, sf):
    """The pivot of every record with every other, not only of the stated set."""
    h = staged(heads(spark, sf), "heads")
    return H.pivot(h, h, "mesh")


def _q_pivot(spark, sf):
    q = staged(quals(spark, sf), "quals")
    return H.relation_pivot(H.relations(q, small(q), ["descriptor_name", "qualifier_name"]))


def heading_jaccard(spark, sf):
    h = staged(heads(spark, sf), "heads")
    return H.jaccard(h, small(h), "mesh")


def summed_jaccard(spark, sf):
    """The ratios of headings and qualifiers in one: their counts add up, so each is a key of the same table."""
    keyed = lambda df, *cols: df.select("pmid", F.array(*cols).alias("key"), "major")
    both = staged(keyed(heads(spark, sf), "mesh").unionByName(keyed(quals(spark, sf), "descriptor_name", "qualifier_name")), "both")
    return H.jaccard(both, small(both), "key")


def heading_rank(spark, sf):
    h = staged(heads(spark, sf), "heads")
    return S.ranked(H.best_jaccard(h, small(h), "mesh", RELATED), "pmid", "ratio", RELATED)


def small_postings(spark, sf):
    """Of each heading of each record: its rows, and whether the last seen was major."""
    rows = table(spark, sf, "mesh_heading").withColumn("mesh", F.nullif(F.lower(F.trim("mesh")), F.lit(""))).dropna(subset=["mesh", "pmid"])
    major = F.coalesce(F.upper(F.trim("major")) == "Y", F.lit(False))
    return rows.groupBy("pmid", "mesh").agg(F.count(F.lit(1)).alias("n"), F.max_by(major, F.struct("loaded_at", major)).alias("is_topic"))


def synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """(mesh, fuzzy): the words of each heading stand in for its synonyms."""
    return heads(spark, sf).select("mesh").distinct().select("mesh", F.explode(F.array_distinct(X.terms(F.col("mesh")))).alias("fuzzy"))


def hits(spark, sf):
    t = texts(spark, sf).filter("abs is not null").select("pmid", F.lower("abs").alias("abs"))
    return H.synonym_hits(t, heads(spark, sf), synonyms(spark, sf), X.substring_count)


def heading_synonym_sets(spark, sf):
    """Synonym hits with the synonyms of a heading gathered first; each is used as a pattern."""
    sets = synonyms(spark, sf).groupBy("mesh").agg(F.collect_set("fuzzy").alias("all"))
    t = texts(spark, sf).filter("abs is not null").select("pmid", F.lower("abs").alias("abs"))
    mine = keyed_join(heads(spark, sf), sets, "mesh", ["pmid"]).groupBy("pmid").agg(F.collect_list(F.struct("mesh", "major", "all")).alias("sets"))
    total = lambda s: F.aggregate(F.transform(s["all"], lambda f: F.regexp_count("abs", f)), F.lit(0).cast("long"), lambda n, x: n + x)
    out = t.join(mine, "pmid").select("pmid", F.explode(F.transform("sets", lambda s: F.struct(s["mesh"].alias("mesh"), s["major"].alias("major"), total(s).alias("n")))).alias("h"))
    return out.select("h.mesh", "pmid", "h.major", "h.n")


def concept_inputs(spark, sf):
    p = staged(posts(spark, sf), "posts")
    lengths = texts(spark, sf).filter("abs is not null").select("pmid", X.word_count(F.col("abs")).alias("len"))
    df = p.groupBy("mesh").agg(F.count(F.lit(1)).alias("df"))
    n = p.select("pmid").distinct().count()
    return p, lengths, df.select("mesh", W.idf(F.lit(n), F.col("df")).alias("idf"))


def concept_similarity(spark, sf):
    p, lengths, idfs = concept_inputs(spark, sf)
    return H.concept_scores(p, lengths, idfs)


def concept_top(spark, sf):
    p, lengths, idfs = concept_inputs(spark, sf)
    w = staged(H.concept_weights(p, lengths, idfs), "concepts")
    top = S.ranked(H.best_concepts(small(w), w, 10), "src", "units", 10)
    return top.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "rel"))).alias("r")).select("src", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["rank"], x["rel"])), " ").alias("related"))


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """(src_pmid, rel_pmid, score, link_name): scored pairs in the place of an external list."""
    rows = table(spark, sf, "pp_score").filter("score is not null and not isnan(score) and src_pmid <> rel_pmid")
    best = rows.groupBy("src_pmid", "rel_pmid").agg(F.max("score").alias("score"))
    return best.withColumn("link_name", F.when(F.col("score") >= 0, "article_article").otherwise("other"))


def neighbour_rank(spark, sf):
    return S.ranked(neighbours(spark, sf).filter(F.col("link_name") == "article_article"), "src_pmid", "score", 20)


def results(spark, sf):
    """The headings' own ranking of the sources, to be held against the neighbours."""
    src = neighbours(spark, sf).select(F.col("src_pmid").alias("pmid")).distinct().filter("pmid % 100 = 0")
    h = heads(spark, sf)
    rel = H.relations(h, h.join(src, "pmid", "left_semi"), ["mesh"]).groupBy("pmid", "related").agg(F.sum("n").alias("n"))
    return S.ranked(rel.filter("pmid <> related"), "pmid", "n", 50).select(F.col("pmid").alias("src_pmid"), F.col("related").alias("rel_pmid"), "rank")


def overlap(how: str):
    def run(spark, sf):
        nb = neighbour_rank(spark, sf).filter("src_pmid % 100 = 0").select("src_pmid", "rel_pmid", F.col("rank").alias("nb_rank"))
        found = results(spark, sf)
        joined = nb.join(found, ["src_pmid", "rel_pmid"], how)
        return joined.groupBy("src_pmid").agg(F.count("rank").alias("n_common"))

    return run


def neighbor_overlap_inner(spark, sf):
    """The overlap of every source of the neighbours that has any; only the ranks of the neighbours are taken."""
    nb = neighbour_rank(spark, sf).select(F.col("src_pmid").alias("src"), F.col("rel_pmid").alias("rel"))
    return among_best(nb, staged(heads(spark, sf), "heads"), "mesh", 50).select(F.col("src").alias("src_pmid"), F.col("n").alias("n_common"))


def overlap_hist(spark, sf):
    return overlap("left")(spark, sf).groupBy("n_common").agg(F.count(F.lit(1)).alias("n_sources"))


def report(spark, sf):
    """One line for each of the ten best neighbours of the sources, with title and placeholder texts, in order of rank."""
    nb = neighbour_rank(spark, sf).filter("rank <= 10")
    t = texts(spark, sf).select(F.col("pmid").alias("rel_pmid"), F.coalesce("title", F.lit("no title")).alias("title"), F.length(F.coalesce("abs", F.lit("no abstract"))).alias("len"))
    lines = nb.join(t, "rel_pmid", "left").select("src_pmid", "rank", "rel_pmid", F.concat_ws("\t", "rank", "rel_pmid", F.coalesce("title", F.lit("no title")), F.coalesce("len", F.lit(11))).alias("line"))
    return lines.groupBy("src_pmid").agg(F.array_sort(F.collect_list(F.struct("rank", "rel_pmid", "line"))).alias("l")).select("src_pmid", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def report_terms(spark, sf):
    """The pairs of the best matrix neighbours with the terms that they share, the strongest first."""
    mat = staged(matrix(spark, sf), "matrix")
    pairs = staged(S.closest(mat, sources(mat), 5, "drop_before", "row_number"), "pairs")
    words = table(spark, sf, "vocab").groupBy("term_id").agg(F.min("term").alias("term"))
    shared = S.explained(pairs, mat).join(words, "term_id").groupBy("src", "rel").agg(F.array_sort(F.collect_list(F.struct((-F.col("units")).alias("u"), "term"))).alias("t"))
    out = shared.join(pairs.select("src", "rel", "rank"), ["src", "rel"])
    return out.select("src", "rel", "rank", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("terms"))


def posting_maps(spark, sf):
    p = posts(spark, sf)
    by_doc = p.groupBy("pmid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mesh", "cnt")))).alias("m"))
    return by_doc.select("pmid", F.size("m").alias("n"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x).alias("cnt"), F.array_max(F.map_keys("m")).alias("last"))


def topic_test(spark, sf):
    """Whether any of three spellings of a posting's heading is among the headings of its article."""
    tree = heads(spark, sf).groupBy("pmid").agg(F.collect_set("mesh").alias("h"))
    p = posts(spark, sf).join(tree, "pmid", "left")
    test = lambda c: F.coalesce(F.array_contains("h", c), F.lit(False))
    return p.select("mesh", "pmid", (test(F.col("mesh")) | test(X.sort_words(F.col("mesh"))) | test(F.concat("mesh", F.lit("s")))).alias("is_topic"))


def heading_self_join(spark, sf):
    """(mesh, n_pairs, n_both_major): the pairs of articles that share a heading, joined and counted by heading, self pairs included.

    A heading of a tenth of all rows has pairs without end, so the rows of each heading that join alike, those of the same
    flag, are counted first, and the counts are joined: the same pairs, none of them made.
    """
    groups = heads(spark, sf).groupBy("mesh", "major").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("mesh", F.col("major").alias("other_major"), F.col("n").alias("m"))
    pairs = F.col("n") * F.col("m")
    joined = groups.join(other, "mesh")
    return joined.groupBy("mesh").agg(F.sum(pairs).alias("n_pairs"), F.sum(F.when(F.col("major") & F.col("other_major"), pairs).otherwise(0)).alias("n_both_major"))


QUERIES = {
    "heading_relations": lambda s, d: (lambda h: H.relations(h, small(h), ["mesh"]))(heads(s, d)),
    "qualifier_relations": lambda s, d: (lambda q: H.relations(q, small(q), ["descriptor_name", "qualifier_name"]))(quals(s, d)),
    "heading_pivot": heading_pivot,
    "qualifier_pivot": _q_pivot,
    "heading_counts": lambda s, d: H.count_pivot(heads(s, d)),
    "qualifier_counts": lambda s, d: H.count_pivot(quals(s, d)),
    "heading_jaccard": heading_jaccard,
    "full_outer_counts": lambda s, d: H.summed(H.count_pivot(heads(s, d)), H.count_pivot(quals(s, d)), ["pmid"], ["c0", "c1", "total"]),
    "summed_jaccard": summed_jaccard,
    "heading_rank": heading_rank,
    "heading_self_join": heading_self_join,
    "heading_set_groups": lambda s, d: H.set_groups(heads(s, d), "pmid", "mesh").select("joined", F.array_join(F.transform("pmids", lambda p: p.cast("string")), ",").alias("pmids"), "n"),
    "topic_tree": lambda s, d: heads(s, d).groupBy("pmid").agg(F.array_join(F.array_sort(F.collect_set("mesh")), "|").alias("headings")),
    "main_topics": lambda s, d: posts(s, d).filter("major").select("mesh", "pmid", "cnt"),
    "concept_df": lambda s, d: posts(s, d).groupBy("mesh").agg(F.count(F.lit(1)).alias("df"), F.sum((F.col("cnt") > 0).cast("long")).alias("df_positive")),
    "posting_maps": posting_maps,
    "small_postings": small_postings,
    "topic_test": topic_test,
    "synonym_count": hits,
    "posting_list": lambda s, d: H.postings(hits(s, d)),
    "heading_synonym_sets": heading_synonym_sets,
    "concept_similarity": concept_similarity,
    "concept_top": concept_top,
    "neighbor_rank": neighbour_rank,
    "neighbor_overlap": overlap("left"),
    "neighbor_overlap_inner": neighbor_overlap_inner,
    "neighbor_overlap_hist": overlap_hist,
    "report_text": report,
    "report_terms": report_terms,
}

_HEADS = "heads as (select pmid, lower(trim(mesh, ' ')) mesh, coalesce(max(upper(trim(major, ' ')) = 'Y'), false) major from mesh_heading where pmid is not null and nullif(trim(mesh, ' '), '') is not null group by 1, 2)"
_QUALS = "quals as (select pmid, descriptor_name, qualifier_name, coalesce(max(upper(trim(qualifier_name_major_yn, ' ')) = 'Y'), false) major from qualifier where pmid is not null and descriptor_name is not null and qualifier_name is not null group by all)"
_POSTS = "posts as (select lower(trim(mesh, ' ')) mesh, pmid, max(cnt) cnt, max(coalesce(major, false)) major from posting_list where pmid is not null and nullif(trim(mesh, ' '), '') is not null group by 1, 2)"
_CUR = "cur as (select pmid, title, abs from abstracts where pmid is not null qualify row_number() over (partition by pmid order by loaded_at desc nulls last) = 1)"


def _rel(t: str, on: str, of: str = " where a.pmid % 100 = 0") -> str:
    return f"(select a.pmid, b.pmid related, a.major, b.major related_major, count(*) n from {t} a join {t} b using ({on}){of} group by all)"


def _piv(rel: str) -> str:
    cells = ", ".join(f"cast(coalesce(sum(n) filter ({'' if a else 'not '}major and {'' if b else 'not '}related_major), 0) as bigint) c{int(a)}{int(b)}" for a, b in H.FLAGS)
    return f"(select pmid, related, {cells}, cast(sum(n) as bigint) total from {rel} group by all)"


def _cnt(t: str) -> str:
    return f"(select pmid, count(*) filter (not major) c0, count(*) filter (major) c1, count(*) total from {t} group by pmid)"


def _ratio(piv: str, cnt: str) -> str:
    def one(c: str, a: str, b: str, name: str) -> str:
        return f"round(case when {a} + {b} - {c} = 0 then 0.0 else {c} / ({a} + {b} - {c}) end, 9) {name}"

    cells = ", ".join(one(f"p.c{int(x)}{int(y)}", f"x.c{int(x)}", f"y.c{int(y)}", f"r{int(x)}{int(y)}") for x, y in H.FLAGS)
    return f"(select p.pmid, p.related, {cells}, {one('p.total', 'x.total', 'y.total', 'ratio')} from {piv} p join {cnt} x on x.pmid = p.pmid join {cnt} y on y.pmid = p.related)"


def _sum(a: str, b: str, keys: str, values: list[str]) -> str:
    return f"(select {keys}, {', '.join(f'coalesce(a.{v}, 0) + coalesce(b.{v}, 0) {v}' for v in values)} from {a} a full join {b} b using ({keys}))"


_HR, _QR = _rel("heads", "mesh"), _rel("quals", "descriptor_name, qualifier_name")
_V = ["c00", "c01", "c10", "c11", "total"]
_COUNTS = _sum(_cnt("heads"), _cnt("quals"), "pmid", ["c0", "c1", "total"])
_JACCARD = _ratio(_piv(_HR), _cnt("heads"))
_SYN = "syn as (select distinct mesh, unnest(regexp_extract_all(mesh, '[a-z0-9]{2,}')) fuzzy from heads)"
_HITS = f"{_HEADS}, {_CUR}, {_SYN}, hits as (select mesh, pmid, major, fuzzy, cast((length(lower(abs)) - length(replace(lower(abs), fuzzy, ''))) // length(fuzzy) as int) n from heads join syn using (mesh) join cur using (pmid) where abs is not null)"
_W_CNT = f"sqrt(idf) / (1 + pow({W.MU / W.LAMBDA!r}, cnt - 1) * exp({W.LAMBDA - W.MU!r} * len))"
_CONCEPT = f"{_POSTS}, {_CUR}, lens as (select pmid, (case when regexp_replace(abs, ' +$', '') = '' and abs <> '' then 0 else len(string_split(regexp_replace(abs, ' +$', ''), ' ')) end) len from cur where abs is not null), idfs as (select mesh, ln((select count(distinct pmid) from posts) / count(*)) idf from posts group by mesh), w as (select mesh, pmid, cast(round({_W_CNT} * 1000000) as bigint) w from posts join idfs using (mesh) join lens using (pmid)), sim as (select a.pmid src, b.pmid rel, cast(sum(a.w * b.w) as bigint) units from w a join w b using (mesh) where a.pmid % 100 = 0 group by all)"
_NB = "nb as (select src_pmid, rel_pmid, max(score) score from pp_score where score is not null and not isnan(score) and src_pmid <> rel_pmid group by all), nbr as (select *, 'article_article' link_name, rank() over (partition by src_pmid order by score desc) r from nb where score >= 0 qualify r <= 20)"
_RES = f"{_HEADS}, {_NB}, src as (select distinct src_pmid pmid from nb where src_pmid % 100 = 0), rel as (select a.pmid, b.pmid related, count(*) n from heads a join heads b using (mesh) where a.pmid in (select pmid from src) group by all), res as (select pmid src_pmid, related rel_pmid, rank() over (partition by pmid order by n desc) k from rel where pmid <> related qualify k <= 50)"
_OVER = "select src_pmid, count(k) n_common from nbr {} join res using (src_pmid, rel_pmid) where src_pmid % 100 = 0 group by 1"
SQL = {
    "heading_relations": f"with {_HEADS} select * from {_HR}",
    "qualifier_relations": f"with {_QUALS} select * from {_QR}",
    "heading_pivot": f"with {_HEADS} select * from {_piv(_rel('heads', 'mesh', ''))}",
    "qualifier_pivot": f"with {_QUALS} select * from {_piv(_QR)}",
    "heading_counts": f"with {_HEADS} select * from {_cnt('heads')}",
    "qualifier_counts": f"with {_QUALS} select * from {_cnt('quals')}",
    "heading_jaccard": f"with {_HEADS} select * from {_JACCARD}",
    "full_outer_counts": f"with {_HEADS}, {_QUALS} select * from {_COUNTS}",
    "summed_jaccard": f"with {_HEADS}, {_QUALS} select * from {_ratio(_sum(_piv(_HR), _piv(_QR), 'pmid, related', _V), _COUNTS)}",
    "heading_rank": f"with {_HEADS} select pmid, related, ratio, rank() over (partition by pmid order by ratio desc) as rank from {_JACCARD} qualify rank <= {RELATED}",
    "heading_self_join": f"with {_HEADS} select mesh, count(*) n_pairs, count(*) filter (a.major and b.major) n_both_major from heads a join heads b using (mesh) group by 1",
    "heading_set_groups": f"with {_HEADS}, s as (select pmid, string_agg(mesh, '|' order by mesh) joined from heads group by pmid) select joined, string_agg(pmid, ',' order by pmid) pmids, count(*) n from s group by joined",
    "topic_tree": f"with {_HEADS} select pmid, string_agg(mesh, '|' order by mesh) headings from heads group by pmid",
    "main_topics": f"with {_POSTS} select mesh, pmid, cnt from posts where major",
    "concept_df": f"with {_POSTS} select mesh, count(*) df, count(*) filter (cnt > 0) df_positive from posts group by mesh",
    "posting_maps": f"with {_POSTS} select pmid, cast(count(*) as int) n, cast(sum(cnt) as bigint) cnt, max(mesh) as last from posts group by pmid",
    "small_postings": "select pmid, lower(trim(mesh, ' ')) mesh, count(*) n, arg_max(coalesce(upper(trim(major, ' ')) = 'Y', false), (loaded_at, coalesce(upper(trim(major, ' ')) = 'Y', false))) is_topic from mesh_heading where pmid is not null and nullif(trim(mesh, ' '), '') is not null group by 1, 2",
    "topic_test": f"with {_HEADS}, {_POSTS} select mesh, pmid, exists (select 1 from heads h where h.pmid = p.pmid and h.mesh in (p.mesh, array_to_string(list_sort(string_split(p.mesh, ' ')), ' '), p.mesh || 's')) is_topic from posts p",
    "synonym_count": f"with {_HITS} select * from hits",
    "posting_list": f"with {_HITS} select mesh, pmid, major, cast(sum(n) as bigint) n from hits group by all",
    "heading_synonym_sets": f"with {_HITS} select mesh, pmid, major, cast(sum(n) as bigint) n from hits group by all",
    "concept_similarity": f"with {_CONCEPT.replace(' where a.pmid % 100 = 0', '')} select src, rel, round(units / 1e12, 6) score from sim",
    "concept_top": f"with {_CONCEPT}, r as (select src, rel, rank() over (partition by src order by units desc) r from sim qualify r <= 10) select src, string_agg(r || ':' || rel, ' ' order by r, rel) related from r group by src",
    "neighbor_rank": f"with {_NB} select src_pmid, rel_pmid, score, link_name, r as rank from nbr",
    "neighbor_overlap": f"with {_RES} {_OVER.format('left')}",
    "neighbor_overlap_inner": f"with {_RES} {_OVER.format('inner')}".replace(" where src_pmid % 100 = 0", ""),
    "neighbor_overlap_hist": f"with {_RES}, o as ({_OVER.format('left')}) select n_common, count(*) n_sources from o group by 1",
    "report_text": f"with {_NB}, {_CUR}, l as (select src_pmid, r, rel_pmid, concat_ws(chr(9), r, rel_pmid, coalesce(title, 'no title'), length(coalesce(abs, 'no abstract'))) line from nbr left join cur on cur.pmid = rel_pmid where r <= 10) select src_pmid, string_agg(line, chr(10) order by r, rel_pmid, line) as text from l group by 1",
    "report_terms": f"with {_PROD}, pairs as (select src, rel, row_number() over (partition by src order by units desc, rel) r from prod where src <> rel qualify r <= 5), v as (select term_id, min(term) term from vocab group by 1), t as (select p.src, p.rel, r, term, cast(round(a.weight * 1000000) as bigint) * cast(round(b.weight * 1000000) as bigint) u from pairs p join mat a on a.pmid = p.src join mat b on b.pmid = p.rel and b.term_id = a.term_id join v on v.term_id = a.term_id) select src, rel, r as rank, string_agg(term, ' ' order by u desc, term) terms from t group by all",
}
