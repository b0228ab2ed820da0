"""Set operations, joins, limits and other relational shapes of the pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import similarity as S
from lexweave.operators.skew import keyed_join
from lexweave.plans.headings import heads, quals, texts
from lexweave.plans.matrix import matrix
from lexweave.session import small_or_shuffled, staged, table

CHUNK = 50
#: Rows that the scan before an exclusion takes at most, as in the reference.
LIMIT = 5_000_000


def best_scores(s, d):
    rows = table(s, d, "pp_score").filter("score is not null and not isnan(score)")
    return rows.groupBy("src_pmid", "rel_pmid").agg(F.max("score").alias("score"))


def by_text_id(s, d):
    """All scored pairs in the order of the source id as a string, the best of each source first."""
    return best_scores(s, d).orderBy(F.col("src_pmid").cast("string"), F.desc("score"), "rel_pmid")


def id_chunks(s, d):
    """The ids of the matrix in order, in chunks of a fixed number."""
    ids = S.with_ids(matrix(s, d).select("pmid").distinct(), "pmid", "at")
    return ids.select("pmid", F.floor(F.col("at") / CHUNK).cast("long").alias("chunk"))


def prefer_left(s, d):
    """All of the headings' articles, and of the qualifiers only those of other articles."""
    a = heads(s, d).select("pmid", F.col("mesh").alias("value"))
    b = quals(s, d).select("pmid", F.col("descriptor_name").alias("value"))
    return a.unionAll(b.join(a.select("pmid").distinct(), "pmid", "left_anti"))


def union_branches(s, d):
    """Distinct texts of the source and related articles of scored pairs, of headings, and of qualifiers."""
    t = texts(s, d).select("pmid", "title")
    pairs = best_scores(s, d)
    parts = [p.distinct() for p in (pairs.select(F.col("src_pmid").alias("pmid")), pairs.select(F.col("rel_pmid").alias("pmid")), heads(s, d).select("pmid"), quals(s, d).select("pmid"))]
    out = t.join(parts[0], "pmid")
    for p in parts[1:]:
        out = out.union(t.join(p, "pmid"))
    return out.distinct()


def run_length_ids(s, d):
    """The rows of term_doc_weight, in order of article and term, at which another article begins."""
    order = Window.partitionBy("term_id").orderBy("pmid")
    rows = table(s, d, "term_doc_weight").dropna(subset=["term_id", "pmid"]).select("term_id", "pmid")
    return rows.withColumn("prev", F.lag("pmid").over(order)).filter("prev is null or prev <> pmid").select("term_id", "pmid")


def left_fill(s, d):
    n = heads(s, d).groupBy("pmid").agg(F.count(F.lit(1)).alias("n_head"))
    q = quals(s, d).groupBy("pmid").agg(F.count(F.lit(1)).alias("n_qual"))
    return n.join(q, "pmid", "left").fillna(0, ["n_qual"]).withColumn("n", F.col("n_head") + F.col("n_qual"))


def three_tables(s, d):
    """Articles, their headings and the postings of these."""
    p = table(s, d, "posting_list").withColumn("mesh", F.lower(F.trim("mesh"))).groupBy("mesh", "pmid").agg(F.max("cnt").alias("cnt"))
    return texts(s, d).filter("abs is not null").select("pmid", F.length("abs").alias("n")).join(heads(s, d), "pmid").join(p, ["pmid", "mesh"])


def pair_lookup(s, d):
    """Scores of articles with one another: both directions of a scored pair."""
    a, b = best_scores(s, d), best_scores(s, d)
    back = b.select(F.col("src_pmid").alias("rel_pmid"), F.col("rel_pmid").alias("src_pmid"), F.col("score").alias("back"))
    return a.join(back, ["src_pmid", "rel_pmid"])


def composite(s, d):
    """Scored pairs with the number of headings they share, joined on both ids; pairs that share none are left out.

    The headings of an article go along as one array of numbers, so that no pair is multiplied by them.
    """
    h = staged(heads(s, d).select("pmid", "mesh"), "heads")
    numbers = S.with_ids(h.select("mesh").distinct(), "mesh", "at").select("mesh", F.col("at").cast("int").alias("at"))
    sets = staged(keyed_join(h, numbers, "mesh", ["pmid"]).groupBy("pmid").agg(F.collect_list("at").alias("own")), "sets")
    pairs = best_scores(s, d).select(F.col("src_pmid").alias("pmid"), "rel_pmid", "score")
    left = keyed_join(pairs, sets, "pmid", ["rel_pmid"])
    both = keyed_join(left, sets.select(F.col("pmid").alias("rel_pmid"), F.col("own").alias("other")), "rel_pmid", ["pmid"])
    out = both.select("pmid", "rel_pmid", "score", F.size(F.array_intersect("own", "other")).cast("long").alias("n_shared"))
    return out.filter("n_shared > 0")


def exclude_known(s, d):
    """The first LIMIT non-empty abstracts in order of id, without the articles that have headings; the limit comes first.

    They are numbered in ranges, as a limit so large would gather all rows in one task.
    """
    rows = S.with_ids(texts(s, d).filter("abs is not null and abs <> ''").select("pmid", "title"), "pmid", "at").filter(F.col("at") < LIMIT)
    return rows.select("pmid", "title").join(small_or_shuffled(heads(s, d).select("pmid").distinct()), "pmid", "left_anti")


def qualifier_flags(s, d):
    rows = table(s, d, "qualifier").filter("qualifier_name_major_yn in ('Y', 'N')")
    return rows.select("pmid", "descriptor_name", "qualifier_name", X.yes_no(F.col("qualifier_name_major_yn")).alias("major"))


QUERIES = {
    "chunk_ids": id_chunks,
    "prefer_left_union": prefer_left,
    "union_branches": union_branches,
    "union_distinct_ids": lambda s, d: best_scores(s, d).select(F.col("src_pmid").alias("pmid")).distinct().union(best_scores(s, d).select("rel_pmid").distinct()).distinct(),
    "id_difference": lambda s, d: heads(s, d).select("pmid").subtract(quals(s, d).select("pmid")),
    "anti_by_null": lambda s, d: heads(s, d).select("pmid").distinct().join(quals(s, d).select("pmid").distinct().withColumn("_x", F.lit(1)), "pmid", "left").filter("_x is null").select("pmid"),
    "semi_ids": lambda s, d: matrix(s, d).join(heads(s, d).select("pmid").distinct(), "pmid", "left_semi"),
    "run_length_ids": run_length_ids,
    "left_fill": left_fill,
    "three_table_join": three_tables,
    "pair_lookup": pair_lookup,
    "composite_join": composite,
    "exclude_known": exclude_known,
    "qualifier_flags": qualifier_flags,
    "in_list": lambda s, d: table(s, d, "documents").filter(F.col("source").isin("labnotes", "fieldlog")).select("doc_id", "source"),
    "nan_filter": lambda s, d: table(s, d, "pp_score").filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("src_pmid").agg(F.count(F.lit(1)).alias("n")),
    "self_pairs_out": lambda s, d: S.ranked(best_scores(s, d).filter("src_pmid <> rel_pmid"), "src_pmid", "score", 5).select("src_pmid", "rel_pmid", "score", "rank"),
    "rank_merge": lambda s, d: S.ranked(best_scores(s, d).unionAll(best_scores(s, d).select(F.col("rel_pmid").alias("src_pmid"), F.col("src_pmid").alias("rel_pmid"), "score")).groupBy("src_pmid", "rel_pmid").agg(F.max("score").alias("score")), "src_pmid", "score", 3, "row_number", "rel_pmid"),
    "related_lists": lambda s, d: S.ranked(best_scores(s, d), "src_pmid", "score", 5, "row_number", "rel_pmid").groupBy("src_pmid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rel_pmid"))), lambda x: x["rel_pmid"].cast("string")), ",").alias("related")),
    "scores_by_text_id": by_text_id,
    "first_scores": lambda s, d: by_text_id(s, d).limit(1000),
    "order_histogram": lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")),
    "having_total": lambda s, d: table(s, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c")).filter("c <= 30").agg(F.sum("c").alias("total")),
    "market_segments": lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")),
    "events_by_type": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.max("ts").alias("last")),
}

_MAT = "mat as (select term_id, pmid, max(weight) weight from term_doc_weight where term_id is not null and pmid is not null and weight is not null and not isnan(weight) group by all)"
_B = "b as (select src_pmid, rel_pmid, max(score) score from pp_score where score is not null and not isnan(score) group by all)"


def SQL() -> dict[str, str]:
    from lexweave.plans.headings import _CUR, _HEADS, _QUALS

    return {
        "chunk_ids": f"with {_MAT} select pmid, (row_number() over (order by pmid) - 1) // {CHUNK} chunk from (select distinct pmid from mat)",
        "prefer_left_union": f"with {_HEADS}, {_QUALS} select pmid, mesh as value from heads union all select pmid, descriptor_name from quals where pmid not in (select pmid from heads)",
        "union_branches": f"with {_CUR}, {_B}, {_HEADS}, {_QUALS} select distinct pmid, title from cur where pmid in (select src_pmid from b union all select rel_pmid from b union all select pmid from heads union all select pmid from quals)",
        "union_distinct_ids": f"with {_B} select src_pmid pmid from b union select rel_pmid from b",
        "id_difference": f"with {_HEADS}, {_QUALS} select pmid from heads except select pmid from quals",
        "anti_by_null": f"with {_HEADS}, {_QUALS} select distinct pmid from heads where pmid not in (select pmid from quals)",
        "semi_ids": f"with {_MAT}, {_HEADS} select * from mat where pmid in (select pmid from heads)",
        "run_length_ids": "select distinct term_id, pmid from term_doc_weight where term_id is not null and pmid is not null",
        "left_fill": f"with {_HEADS}, {_QUALS}, h as (select pmid, count(*) n_head from heads group by 1), q as (select pmid, count(*) n_qual from quals group by 1) select pmid, n_head, coalesce(n_qual, 0) n_qual, n_head + coalesce(n_qual, 0) n from h left join q using (pmid)",
        "three_table_join": f"with {_CUR}, {_HEADS}, p as (select lower(trim(mesh, ' ')) mesh, pmid, max(cnt) cnt from posting_list group by 1, 2) select pmid, mesh, cast(length(abs) as int) n, major, cnt from cur join heads using (pmid) join p using (pmid, mesh) where abs is not null",
        "pair_lookup": f"with {_B} select a.src_pmid, a.rel_pmid, a.score, c.score back from b a join b c on a.src_pmid = c.rel_pmid and a.rel_pmid = c.src_pmid",
        "composite_join": f"with {_B}, {_HEADS} select b.src_pmid pmid, b.rel_pmid, score, count(*) n_shared from b join heads x on x.pmid = src_pmid join heads y on y.pmid = rel_pmid and x.mesh = y.mesh group by all",
        "exclude_known": f"with {_CUR}, {_HEADS}, l as (select * from cur where abs is not null and abs <> '' order by pmid limit {LIMIT}) select pmid, title from l where pmid not in (select pmid from heads)",
        "qualifier_flags": "select pmid, descriptor_name, qualifier_name, qualifier_name_major_yn = 'Y' major from qualifier where qualifier_name_major_yn in ('Y', 'N')",
        "in_list": "select doc_id, source from documents where source in ('labnotes', 'fieldlog')",
        "nan_filter": "select src_pmid, count(*) n from pp_score where score is not null and not isnan(score) group by 1",
        "self_pairs_out": f"with {_B} select *, rank() over (partition by src_pmid order by score desc) as rank from b where src_pmid <> rel_pmid qualify rank <= 5",
        "rank_merge": f"with {_B}, u as (select src_pmid, rel_pmid, score from b union all select rel_pmid, src_pmid, score from b), m as (select src_pmid, rel_pmid, max(score) score from u group by 1, 2) select *, row_number() over (partition by src_pmid order by score desc, rel_pmid) as rank from m qualify rank <= 3",
        "related_lists": f"with {_B}, r as (select *, row_number() over (partition by src_pmid order by score desc, rel_pmid) k from b qualify k <= 5) select src_pmid, string_agg(rel_pmid, ',' order by k) related from r group by 1",
        "scores_by_text_id": f"with {_B} select * from b order by cast(src_pmid as varchar), score desc, rel_pmid",
        "first_scores": f"with {_B} select * from b order by cast(src_pmid as varchar), score desc, rel_pmid limit 1000",
        "order_histogram": "select c, count(*) n from (select o_custkey, count(*) c from orders group by 1) group by 1",
        "having_total": "select cast(sum(c) as bigint) total from (select l_partkey, count(*) c from lineitem group by 1 having c <= 30)",
        "market_segments": "select c_mktsegment, l_returnflag, count(*) n, round(sum(l_quantity), 2) qty from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2",
        "events_by_type": "select event_type, count(*) n, count(distinct user_id) users, max(ts) as last from events group by 1",
    }
