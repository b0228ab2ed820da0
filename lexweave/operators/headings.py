"""Heading relations, pivots and overlap ratios; concept postings and concept similarity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.weights import in_units, overlap_ratio, two_poisson
from lexweave.operators.products import all_pairs, best, best_ratios
from lexweave.operators.similarity import with_ids
from lexweave.operators.skew import keyed_join
from lexweave.session import small_or_shuffled, spread, staged

FLAGS = [(False, False), (False, True), (True, False), (True, True)]
#: Bits of the count of minor headings in a record's size, and most bits of each of the four counts of a pair.
MINOR, COUNT = 26, 15


def flagged(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(pmid, *keys, major): a record's headings once each; a heading is major if any of its rows is. Null flags are not."""
    major = F.coalesce(F.upper(F.trim(flag)) == "Y", F.lit(False))
    return df.dropna(subset=["pmid", *keys]).groupBy("pmid", *keys).agg(F.max(major).alias("major"))


def relations(heads: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """(pmid, related, major, related_major, n): shared headings of each small-set record with each other record.

    The large side is spread by its records before it is joined, so that the pairs, many times its rows, are counted and
    pivoted where they arise.
    """
    a = small.select(F.col("pmid"), *keys, F.col("major"))
    b = heads.select(F.col("pmid").alias("related"), *keys, F.col("major").alias("related_major"))
    return spread(b, "related").join(small_or_shuffled(a), keys).groupBy("pmid", "related", "major", "related_major").agg(F.count(F.lit(1)).alias("n"))


def relation_pivot(rel: DataFrame) -> DataFrame:
    """(pmid, related, c00, c01, c10, c11, total): shared headings by whether they are major in either record."""
    cell = lambda a, b: F.sum(F.when((F.col("major") == a) & (F.col("related_major") == b), F.col("n")).otherwise(0))
    return rel.groupBy("pmid", "related").agg(*[cell(a, b).alias(f"c{int(a)}{int(b)}") for a, b in FLAGS], F.sum("n").alias("total"))


def count_pivot(heads: DataFrame) -> DataFrame:
    """(pmid, c0, c1, total): headings of each record, minor and major."""
    one = lambda a: F.sum((F.col("major") == a).cast("long"))
    return heads.groupBy("pmid").agg(one(False).alias("c0"), one(True).alias("c1"), F.count(F.lit(1)).alias("total"))


def ratios(pivot: DataFrame, counts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(pmid, related, r00, r01, r10, r11, ratio): shared headings over those in either record, 0 for a zero denominator.

    own has the counts of the first records, if fewer are known to do. The pairs lie by their second record, so that its
    counts are joined where the pairs are, and those of the first are few.
    """
    a = (counts if own is None else own).select("pmid", F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("total").alias("a"))
    b = counts.select(F.col("pmid").alias("related"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("total").alias("b"))
    return pivot.join(small_or_shuffled(a), "pmid").join(small_or_shuffled(b), "related").select("pmid", "related", *_ratio_columns())


def pivot(heads: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """relation_pivot() of relations(heads, small, [key]), in blocks."""
    out = _flag_pairs(heads, small, key, _pivot_cells, "c00 long, c01 long, c10 long, c11 long, total long")
    return relation_pivot(relations(heads, small, [key])) if out is None else out


def jaccard(heads: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """(pmid, related, r00, r01, r10, r11, ratio) of the pairs of relations(heads, small, [key]), in blocks."""
    out = _flag_pairs(heads, small, key, _ratio_cells, "r00 double, r01 double, r10 double, r11 double, ratio double")
    if out is not None:
        return out
    counts = staged(count_pivot(heads), "counts")
    return ratios(relation_pivot(relations(heads, small, [key])), counts, counts.join(small_or_shuffled(small.select("pmid").distinct()), "pmid", "left_semi"))


def _flag_pairs(heads: DataFrame, small: DataFrame, key: str, cells: Callable, schema: str) -> DataFrame | None:
    """(pmid, related, *schema) of the pairs that share a heading. None if a record of the small set has 32768 headings or more.

    The four counts of a pair are the digits of one product: a minor heading weighs 1, a major one the base in a source and
    its square in the other record. cells takes the digits and the minor and major headings of both.
    """
    ids = staged(with_ids(small.select(key).distinct(), key, "_t"), "ids")
    sets = heads.groupBy("pmid").agg(F.collect_list(F.struct(key, "major")).alias("_k"))
    n, n1 = F.size("_k").cast("long"), F.size(F.filter("_k", lambda k: k["major"])).cast("long")
    rows = sets.select("pmid", n.alias("_all"), (n - n1 + F.shiftleft(n1, MINOR)).alias("_n"), F.explode("_k").alias("_h")).select("pmid", "_all", "_n", F.col(f"_h.{key}").alias(key), "_h.major")
    coded = staged(rows.join(small_or_shuffled(ids), key).select("_t", "pmid", "_n", "_all", "major"), "coded")
    mine = coded if small is heads else coded.join(small_or_shuffled(small.select("pmid").distinct()), "pmid", "left_semi")
    bits = int(mine.agg(F.max("_all")).first()[0] or 0).bit_length()
    if bits > COUNT:
        return None
    weight = lambda of: F.when(F.col("major"), F.lit(of)).otherwise(F.lit(1)).cast("long")
    a = mine.select("_t", F.col("pmid").alias("src"), weight(1 << bits).alias("_a"), "_n")
    b = coded.select("_t", F.col("pmid").alias("rel"), weight(1 << 2 * bits).alias("_b"), "_n")

    def columns(units: np.ndarray, mine: np.ndarray, other: np.ndarray) -> dict[str, np.ndarray]:
        low = (1 << bits) - 1
        counts = {(False, False): units & low, (True, False): units >> bits & low, (False, True): units >> 2 * bits & low, (True, True): units >> 3 * bits}
        return cells(counts, *[(n & ((1 << MINOR) - 1), n >> MINOR) for n in (mine.astype(np.int64), other.astype(np.int64))])

    return all_pairs(a, b, columns, schema).withColumnsRenamed({"src": "pmid", "rel": "related"})


def _pivot_cells(counts: dict, mine: tuple, other: tuple) -> dict[str, np.ndarray]:
    return {f"c{int(x)}{int(y)}": counts[x, y] for x, y in FLAGS} | {"total": sum(counts.values())}


def _ratio_cells(counts: dict, mine: tuple, other: tuple) -> dict[str, np.ndarray]:
    each = {f"r{int(x)}{int(y)}": _rounded(counts[x, y], mine[x] + other[y]) for x, y in FLAGS}
    return each | {"ratio": _rounded(sum(counts.values()), sum(mine) + sum(other))}


def _rounded(common: np.ndarray, both: np.ndarray) -> np.ndarray:
    """common / (both - common) at nine decimals, halves up, 0 for a zero denominator.

    A ratio of denominator d that isn't a half is 1 / 2d away from it at least, in units of the last decimal: more than the
    1e-6 that lift halves over their error, up to 250 000 headings.
    """
    return np.floor(common / np.maximum(both - common, 1) * 1e9 + (0.5 + 1e-6)) / 1e9


def best_jaccard(heads: DataFrame, small: DataFrame, key: str, k: int) -> DataFrame:
    """(pmid, related, ratio): of each record of the small set at least the k highest ratios of jaccard(), with ties.

    The pairs are counted in blocks, and only the best are rows.
    """
    ids = staged(with_ids(small.select(key).distinct(), key, "_t"), "ids")
    sets = heads.groupBy("pmid").agg(F.collect_list(key).alias("_k")).select("pmid", F.size("_k").alias("_n"), F.explode("_k").alias(key))
    coded = staged(sets.join(small_or_shuffled(ids), key).select("_t", "pmid", "_n"), "coded")
    a = coded.join(small_or_shuffled(small.select("pmid").distinct()), "pmid", "left_semi").select("_t", F.col("pmid").alias("src"), F.lit(1).alias("_a"), "_n")
    out = best_ratios(a, coded.select("_t", F.col("pmid").alias("rel"), F.lit(1).alias("_b"), "_n"), k)
    return out.select(F.col("src").alias("pmid"), F.col("rel").alias("related"), F.round(F.col("units") / F.col("of"), 9).alias("ratio"))


def _ratio_columns() -> list[Column]:
    each = [F.round(overlap_ratio(F.col(f"c{int(x)}{int(y)}"), F.col(f"a{int(x)}"), F.col(f"b{int(y)}")), 9).alias(f"r{int(x)}{int(y)}") for x, y in FLAGS]
    return [*each, F.round(overlap_ratio(F.col("total"), F.col("a"), F.col("b")), 9).alias("ratio")]


def summed(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join of two count tables; missing counts are 0."""
    b = b.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return a.join(b, keys, "full").select(*keys, *[(F.coalesce(v, F.lit(0)) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])


def set_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """(joined, pmids, n): the records that have exactly the same set of values, by the values joined in order."""
    sets = df.dropna(subset=[key, value]).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias("joined"))
    return sets.groupBy("joined").agg(F.array_sort(F.collect_set(key)).alias("pmids"), F.count(F.lit(1)).alias("n"))


def synonym_hits(texts: DataFrame, heads: DataFrame, synonyms: DataFrame, count: Callable[[Column, Column], Column]) -> DataFrame:
    """(mesh, pmid, major, fuzzy, n): how often a text holds each synonym of each heading of its record.

    texts has (pmid, abs), synonyms (mesh, fuzzy), count takes a text and a synonym. The synonyms of a record are gathered
    before its text is joined, so that no text is copied for each of them.
    """
    sets = synonyms.groupBy("mesh").agg(F.collect_list("fuzzy").alias("_all"))
    mine = keyed_join(heads.select("mesh", "pmid", "major"), sets, "mesh", ["pmid"]).groupBy("pmid").agg(F.collect_list(F.struct("mesh", "major", "_all")).alias("_sets"))
    each = F.flatten(F.transform("_sets", lambda s: F.transform(s["_all"], lambda f: F.struct(s["mesh"].alias("mesh"), s["major"].alias("major"), f.alias("fuzzy"), count(F.col("abs"), f).alias("n")))))
    return texts.join(mine, "pmid").select("pmid", F.explode(each).alias("_h")).select("_h.mesh", "pmid", "_h.major", "_h.fuzzy", "_h.n")


def postings(hits: DataFrame) -> DataFrame:
    """(mesh, pmid, major, n): the sum of the hits; rows without a hit stay."""
    return hits.groupBy("mesh", "pmid", "major").agg(F.sum("n").alias("n"))


def concept_weights(corpus: DataFrame, lengths: DataFrame, idfs: DataFrame) -> DataFrame:
    """(mesh, pmid, w): two-Poisson weights of the concepts of each record, in whole units of 1e-6."""
    return keyed_join(corpus, idfs, "mesh", ["pmid"]).join(lengths, "pmid").select("mesh", "pmid", in_units(two_poisson(F.col("idf"), F.col("cnt"), F.col("len"))).alias("w"))


def best_concepts(src: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(src, rel, units): of each record of src at least the k highest sums of concept_similarity(), with ties.

    Both have (mesh, pmid, w). The sums are taken in blocks, and only the best are rows.
    """
    ids = staged(with_ids(src.select("mesh").distinct(), "mesh", "_t"), "ids")
    coded = lambda df, name, weight: df.join(small_or_shuffled(ids), "mesh").select("_t", F.col("pmid").alias(name), F.col("w").alias(weight))
    return best(coded(src, "src", "_a"), coded(corpus, "rel", "_b"), k)


def concept_scores(corpus: DataFrame, lengths: DataFrame, idfs: DataFrame) -> DataFrame:
    """(src, rel, score): concept_similarity() of every record with every other at six decimals, in blocks.

    Blocks know no null sums. Where a count is null, the pairs are joined.
    """
    w = staged(concept_weights(corpus, lengths, idfs), "concepts")
    if not w.filter("w is null").isEmpty():
        return concept_similarity(corpus, corpus, lengths, idfs).select("src", "rel", F.round(F.col("units") / 1e12, 6).alias("score"))
    ids = staged(with_ids(w.select("mesh").distinct(), "mesh", "_t"), "ids")
    coded = staged(w.join(small_or_shuffled(ids), "mesh").select("_t", "pmid", "w"), "coded")
    side = lambda name, weight: coded.select("_t", F.col("pmid").alias(name), F.col("w").alias(weight), F.lit(0).alias("_n"))
    return all_pairs(side("src", "_a"), side("rel", "_b"), _score_cells, "score double")


def _score_cells(units: np.ndarray, mine: np.ndarray, other: np.ndarray) -> dict[str, np.ndarray]:
    return {"score": (units + 500_000) // 1_000_000 / 1e6}


def concept_similarity(src: DataFrame, corpus: DataFrame, lengths: DataFrame, idfs: DataFrame) -> DataFrame:
    """(src, rel, units): sums over shared concepts of the products of their two-Poisson weights.

    src and corpus have (mesh, pmid, cnt). Weights are rounded to six decimals, so that sums are exact.
    """
    weighted = concept_weights(corpus, lengths, idfs)
    mine = src.select("mesh", "pmid").distinct().join(weighted, ["mesh", "pmid"]).select("mesh", F.col("pmid").alias("src"), F.col("w").alias("_a"))
    other = weighted.select("mesh", F.col("pmid").alias("rel"), F.col("w").alias("_b"))
    return spread(other, "rel").join(small_or_shuffled(mine), "mesh").groupBy("src", "rel").agg(F.sum(F.col("_a") * F.col("_b")).alias("units"))
