"""Problem 5: how distinctive a term is for its record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.frequency import SQL_CURRENT
from lexweave.llm.terms import TERM, trie_counts
from lexweave.operators.current import current_rows
from lexweave.session import small_or_shuffled, staged, table

#: Terms this close to one another co-occur: each is linked with the next WINDOW - 1.
WINDOW = 3
#: Most terms of two or more records that are sent to the workers; if there are more, the vocabulary is joined. The terms
#: of one record needn't be sent: their rarity is known.
VOCABULARY = 1_000_000
#: Terms of more than this share of the records are joined by broadcast where the vocabulary is joined; there are at
#: most (mean terms of a record) / HOT_SHARE of them.
HOT_SHARE = 0.001
MARGIN = 1.7
#: Most neighbours that one occurrence of a term adds.
NEIGHBOURS = 2 * (WINDOW - 1)

NODES = "_key long, term string, occurrences long, degree long"
SCORED = NODES + ", graph_weight double, tf_idf double"


def _graph(texts: list[str | None], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of each distinct term of each text: the text, the term's code, its occurrences, and its distinct neighbours.

    The terms that aren't known have the codes after those; they are given last.
    """
    words = [TERM.findall(t.lower()) if t else [] for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    code = np.fromiter((known.get(w, -1) for w in flat), np.int64, len(flat))
    other: dict[str, int] = {}
    for i in np.flatnonzero(code < 0).tolist():
        code[i] = len(known) + other.setdefault(flat[i], len(other))
    if not len(code):
        return code, code, code, code, []
    doc = np.repeat(np.arange(len(words)), size)
    wide = int(code.max()) + 1
    node, at, occurrences = np.unique(doc * wide + code, return_inverse=True, return_counts=True)
    edges = []
    for d in range(1, WINDOW):
        a, b = at[:-d], at[d:]
        ok = (doc[:-d] == doc[d:]) & (a != b)
        a, b = a[ok], b[ok]
        edges.append(np.minimum(a, b) * len(node) + np.maximum(a, b))
    edge = np.sort(np.concatenate(edges))
    if len(edge):
        edge = edge[np.append(True, edge[1:] != edge[:-1])]
    degree = np.bincount(edge // len(node), minlength=len(node)) + np.bincount(edge % len(node), minlength=len(node))
    return node // wide, node % wide, occurrences, degree, list(other)


def _next_best(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each node the highest value among the other nodes of its text; minus infinity where it is alone. Nodes are in order of text."""
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    of = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    top = np.maximum.reduceat(values, start)
    first = np.full(len(start), len(doc))
    np.minimum.at(first, of[values == top[of]], np.flatnonzero(values == top[of]))
    rest = values.copy()
    rest[first] = -np.inf
    out = top[of]
    out[first] = np.maximum.reduceat(rest, start)
    return out


def _standing_out(doc: np.ndarray, graph: np.ndarray, tf_idf: np.ndarray, margin: float) -> np.ndarray:
    """The nodes whose tf_idf is more than `margin` times that of every other node of their text.

    The graph selects: a term has at most NEIGHBOURS neighbours for each of its occurrences, so every other term's tf_idf is
    at least its graph weight / NEIGHBOURS, and a node that doesn't exceed `margin` times that can't stand out. Of the
    nodes that are left, the exact scores decide.
    """
    left = np.flatnonzero(tf_idf * NEIGHBOURS * (1 + 1e-9) > margin * _next_best(doc, graph))
    return left[tf_idf[left] > margin * _next_best(doc, tf_idf)[left]]


def _weighted(shared, margin: float | None):
    """Graph and term weights of every text, with the vocabulary at hand; with a margin, only terms that exceed it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, rarity, once = shared.value
        known = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            doc, code, occurrences, degree, other = _graph(batch.column(1).to_pylist(), known)
            if not len(doc):
                continue
            idf = np.append(rarity, np.full(len(other), once))
            tf_idf = occurrences * idf[code]
            graph = degree * idf[code]
            keep = np.arange(len(doc))
            if margin is not None:
                keep = _standing_out(doc, graph, tf_idf, margin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[doc[keep]]), pa.array([vocabulary[c] if c < len(vocabulary) else other[c - len(vocabulary)] for c in code[keep].tolist()], pa.string()), pa.array(occurrences[keep]), pa.array(degree[keep]), pa.array(graph[keep]), pa.array(tf_idf[keep])],
                names=["_key", "term", "occurrences", "degree", "graph_weight", "tf_idf"],
            )

    return run


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        doc, code, occurrences, degree, other = _graph(batch.column(1).to_pylist(), {})
        names = np.array(other, object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[doc]), pa.array(names[code], pa.string()), pa.array(occurrences, pa.int64()), pa.array(degree, pa.int64())], names=["_key", "term", "occurrences", "degree"]
        )


def distinctive_terms(df: DataFrame, key: str, text: str, margin: float | None = None, vocabulary: int = VOCABULARY) -> DataFrame:
    """(_key, term, occurrences, degree, graph_weight, tf_idf) of every term of every record; df has one row for each key.

    The terms of a record form a graph: distinct terms that stand within WINDOW of one another are linked. graph_weight
    is the number of a term's distinct neighbours times its rarity ln(N / records with the term), N being the records
    that have a term; tf_idf has the occurrences in place of the neighbours. With `margin`, only the term of each record
    whose tf_idf is more than `margin` times that of every other comes out; a record's only term always does. The graph weights
    preselect it, and the exact scores decide.

    Null and empty texts have no terms. Rarity comes from all records. Up to `vocabulary` terms of several records are sent
    to the workers; more are joined, the few hot ones by broadcast and the rest by a shuffle.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    counts, total = trie_counts(rows, text="_text")
    counts = staged(counts.select("term", "records"), "terms")
    several = counts.filter("records > 1")
    if several.count() <= vocabulary:
        known = several.select("term", F.log(F.lit(float(total)) / F.col("records")).alias("rarity")).toPandas()
        once = spark.range(1).select(F.log(F.lit(float(max(total, 1))))).first()[0]
        shared = spark.sparkContext.broadcast((known["term"].tolist(), known["rarity"].to_numpy(np.float64), once))
        return rows.mapInArrow(_weighted(shared, margin), SCORED)
    nodes = rows.mapInArrow(_nodes, NODES)
    hot = counts.filter(F.col("records") > F.lit(HOT_SHARE * total))
    cold = counts.filter(F.col("records") <= F.lit(HOT_SHARE * total))
    nodes = nodes.join(F.broadcast(hot.select("term", F.col("records").alias("_hot"))), "term", "left")
    joined = nodes.filter("_hot is not null").withColumnRenamed("_hot", "records").unionByName(nodes.filter("_hot is null").drop("_hot").join(cold, "term"))
    idf = F.log(F.lit(float(total)) / F.col("records"))
    scored = joined.select("_key", "term", "occurrences", "degree", (F.col("degree") * idf).alias("graph_weight"), (F.col("occurrences") * idf).alias("tf_idf"))
    if margin is None:
        return scored
    order = Window.partitionBy("_key").orderBy(F.desc("tf_idf"), "term")
    ranked = scored.withColumn("_next", F.lead("tf_idf").over(order)).withColumn("_r", F.row_number().over(order))
    return ranked.filter((F.col("_r") == 1) & (F.col("_next").isNull() | (F.col("tf_idf") > margin * F.col("_next")))).drop("_r", "_next")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "abstracts"), "pmid", "loaded_at", ["abs"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, term): the term of an abstract that stands far above its others."""
    return distinctive_terms(_current(spark, sf_dir), "pmid", "abs", MARGIN).select(F.col("_key").cast("int").alias("pmid"), "term")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, term, occurrences, degree, graph_weight, tf_idf) of every term of every abstract."""
    out = distinctive_terms(_current(spark, sf_dir), "pmid", "abs")
    return out.select(F.col("_key").cast("int").alias("pmid"), "term", "occurrences", "degree", F.round("graph_weight", 6).alias("graph_weight"), F.round("tf_idf", 6).alias("tf_idf"))


def p5_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term_id, pmid, weight, degree, rarity, score, graph_score): the vocabulary terms of term_doc_weight.

    rarity is ln(N / articles with the term) over the articles that have a weight, score is weight times rarity, graph_score is
    the term's distinct neighbours in the graph of the article's current abstract times rarity, 0 if it doesn't stand there.
    Of several weights of a pair the highest counts. Null and NaN weights are left out; of several terms with an id the
    first counts. The articles of a term are counted before they are joined, and terms of more than HOT_SHARE of all pairs,
    of which there are at most 1 / HOT_SHARE, are joined by broadcast.
    """
    w = table(spark, sf_dir, "term_doc_weight").filter("term_id is not null and pmid is not null and weight is not null and not isnan(weight)")
    pairs = w.groupBy("term_id", "pmid").agg(F.max("weight").alias("weight"))
    per_term = staged(pairs.groupBy("term_id").agg(F.count(F.lit(1)).alias("n")), "per_term")
    total, n_pairs = pairs.select("pmid").distinct().count(), per_term.agg(F.sum("n")).first()[0] or 0
    hot = per_term.filter(F.col("n") > F.lit(HOT_SHARE * n_pairs))
    cold = per_term.filter(F.col("n") <= F.lit(HOT_SHARE * n_pairs))
    tagged = pairs.join(F.broadcast(hot.withColumnRenamed("n", "_hot")), "term_id", "left")
    joined = tagged.filter("_hot is not null").withColumnRenamed("_hot", "n").unionByName(tagged.filter("_hot is null").drop("_hot").join(cold, "term_id"))
    vocab = table(spark, sf_dir, "vocab").filter("term_id is not null and term is not null").groupBy("term_id").agg(F.min("term").alias("term"))
    texts = _current(spark, sf_dir).select(F.col("pmid").cast("long").alias("_key"), F.col("abs").alias("_text")).filter("_text is not null")
    nodes = texts.mapInArrow(_nodes, NODES).join(small_or_shuffled(vocab), "term").select("term_id", F.col("_key").cast("int").alias("pmid"), "degree")
    joined = joined.join(nodes, ["term_id", "pmid"], "left").fillna(0, ["degree"])
    rarity = F.log(F.lit(float(total)) / F.col("n"))
    return joined.select(
        "term_id", "pmid", "weight", "degree", F.round(rarity, 6).alias("rarity"), F.round(F.col("weight") * rarity, 6).alias("score"), F.round(F.col("degree") * rarity, 6).alias("graph_score")
    )


_SCORED_SQL = f"""
with cur as ({SQL_CURRENT}),
t as (select pmid, unnest(regexp_extract_all(lower(abs), '[a-z0-9]{{2,}}')) term from cur),
n as (select count(distinct pmid) n from t),
c as (select pmid, term, count(*) occurrences from t group by all),
d as (select term, count(*) df from c group by term),
s as (select pmid, term, occurrences * ln((select n from n) / df) score from c join d using (term))
"""
_EDGES_SQL = f"""
cur as ({SQL_CURRENT}),
l as (select pmid, regexp_extract_all(lower(abs), '[a-z0-9]{{2,}}') ws from cur),
t as (select pmid, unnest(ws) term, unnest(range(len(ws))) i from l),
e as (select a.pmid, a.term, count(distinct b.term) degree from t a join t b on a.pmid = b.pmid and abs(a.i - b.i) between 1 and {WINDOW - 1} and a.term <> b.term group by all)
"""
QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms, "p5_weights": p5_weights}
SQL = {
    "p5_found": _SCORED_SQL + f"select pmid, term from (select *, lead(score) over w nxt, row_number() over w r from s window w as (partition by pmid order by score desc, term)) where r = 1 and (nxt is null or score > {MARGIN} * nxt)",
    "p5_terms": f"""
with {_EDGES_SQL},
n as (select count(distinct pmid) n from t),
c as (select pmid, term, count(*) occurrences from t group by all),
d as (select term, count(*) df from c group by term)
select pmid, term, occurrences, coalesce(degree, 0) degree, round(coalesce(degree, 0) * ln((select n from n) / df), 6) graph_weight, round(occurrences * ln((select n from n) / df), 6) tf_idf
from c join d using (term) left join e using (pmid, term)""",
    "p5_weights": f"""
with {_EDGES_SQL},
p as (select term_id, pmid, max(weight) weight from term_doc_weight where term_id is not null and pmid is not null and weight is not null and not isnan(weight) group by all),
c as (select term_id, count(*) n from p group by all),
v as (select term_id, min(term) term from vocab where term_id is not null and term is not null group by all),
g as (select term_id, pmid, degree from e join v using (term)),
s as (select term_id, pmid, weight, coalesce(degree, 0) degree, ln((select count(distinct pmid) from p) / n) r from p join c using (term_id) left join g using (term_id, pmid))
select term_id, pmid, weight, degree, round(r, 6) rarity, round(weight * r, 6) score, round(degree * r, 6) graph_score from s""",
}
