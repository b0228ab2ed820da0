"""Problem 4: all pairs of records whose sets of values overlap above a threshold."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.frequency import heading
from lexweave.session import staged, table

#: A set is small if it has at most so many threshold-sized subsets.
MAX_SUBSETS = 4096
#: A value counts as common from one in HOT_VALUES of all rows on; there are at most so many, which bounds their broadcast.
HOT_VALUES = 100_000
#: Values, the rarest of a subset, that must occur together in another set for the subset to be listed.
SEEDS = 2


def needed(a: int, b: int, threshold: Fraction) -> int:
    """Least overlap of sets of a and b values whose Jaccard similarity is at least the threshold."""
    return -(-(a + b) * threshold.numerator // (threshold.numerator + threshold.denominator))


def sizes_for(n: int, threshold: Fraction, least: int) -> range:
    """Sizes of partners that a set of n values can reach the threshold with."""
    return range(max(least, -(-n * threshold.numerator // threshold.denominator)), n * threshold.denominator // threshold.numerator + 1)


@lru_cache(maxsize=None)
def overlaps_for(n: int, threshold: Fraction, least: int) -> tuple[int, ...]:
    """The overlaps that a set of n values needs with one or another size of partner."""
    return tuple(sorted({c for b in sizes_for(n, threshold, least) if (c := needed(n, b, threshold)) <= min(n, b)}))


@lru_cache(maxsize=None)
def largest_small(threshold: Fraction, least: int, max_subsets: int) -> int:
    """The largest size of a small set."""
    n = least
    while sum(comb(n + 1, c) for c in overlaps_for(n + 1, threshold, least)) <= max_subsets:
        n += 1
    return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_overlap(n: int, threshold: Fraction, least: int) -> int:
    """The smallest overlap that a set of n values can need."""
    return min(overlaps_for(n, threshold, least), default=n + 1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, rows, hashes) for the sets of each size of a batch of (id, values, ...)."""
    values = batch.column(1)
    sizes = np.diff(values.offsets.to_numpy())
    flat = _mixed(values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, rows, flat[starts[rows][:, None] + np.arange(n)]


def _seeds(threshold: Fraction, least: int):
    """(key, id, seed): the SEEDS-sized choices among the values of each set that can be the rarest of a threshold-sized subset.

    A subset of c of n values leaves out n - c, so its rarest SEEDS values are among the first n - c + SEEDS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for n, rows, hashes in _by_size(batch):
                reach = min(n, n - least_overlap(n, threshold, least) + SEEDS)
                picks = np.array(list(combinations(range(reach), SEEDS)), np.int64).reshape(-1, SEEDS)
                if not len(picks):
                    continue
                keys = _mixed(hashes[:, picks].sum(axis=2, dtype=np.uint64)).view(np.int64)
                code = (picks * 256 ** np.arange(SEEDS)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[rows], len(picks))), pa.array(np.tile(code, len(rows)))], names=["key", "id", "seed"])

    return run


def _subsets(threshold: Fraction, least: int, larger: bool, name: str):
    """(key, id) for the threshold-sized subsets of each set (id, values, seeds) whose rarest values are one of its seeds.

    A set of n values is the smaller of a pair, or the larger (or either, of two of one size). The key holds a subset of c
    values, c itself and the smaller size a; the larger set lists it for every a that it may meet, the smaller for every c
    that it may need. So the pairs that agree in a key are those that share c(a, b) values.
    """
    known: dict[int, tuple] = {}

    def picks_of(n: int) -> tuple:
        if n not in known:
            wanted = {(needed(n, b, threshold), min(n, b)) for b in sizes_for(n, threshold, least) if (b <= n if larger else b >= n)}
            picks = [(c, a, p) for c, a in sorted(wanted) if c <= a for p in combinations(range(n), c)]
            mask = np.zeros((n, len(picks)), bool)
            for k, (_, _, p) in enumerate(picks):
                mask[list(p), k] = True
            seed = np.array([sum(v * 256**i for i, v in enumerate(p[:SEEDS])) for _, _, p in picks], np.int64)
            order = np.argsort(seed, kind="stable")
            known[n] = mask[:, order], np.array([c * 65536 + a for c, a, _ in picks], np.uint64)[order], seed[order]
        return known[n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            seeds = batch.column(2)
            of, seed = np.repeat(np.arange(len(ids)), np.diff(seeds.offsets.to_numpy())), seeds.flatten().to_numpy(zero_copy_only=False)
            for n, rows, hashes in _by_size(batch):
                mask, tag, own = picks_of(n)
                place = np.full(len(ids), -1)
                place[rows] = np.arange(len(rows))
                mine = place[of] >= 0
                row, want = place[of[mine]], seed[mine]
                low, high = np.searchsorted(own, want), np.searchsorted(own, want, "right")
                for at in range(0, len(row), 20_000):
                    part = slice(at, at + 20_000)
                    many = high[part] - low[part]
                    line = np.repeat(row[part], many)
                    pick = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[part], many)
                    keys = np.zeros(len(line), np.uint64)
                    for j in range(n):
                        keys += np.where(mask[j][pick], hashes[line, j], np.uint64(0))
                    keys = _mixed(keys + _mixed(tag[pick])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[rows][line])], names=["key", name])

    return run


def _rarest_first(shared):
    """(class, n, values, names) to (id, values, n): the hashes of a set's values, common ones last in the order of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = shared.value
        for batch in batches:
            values = batch.column(1)
            offsets = values.offsets.to_numpy()
            flat = values.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.searchsorted(hot, flat)
            at[at == len(hot)] = 0
            f = np.where(hot[at] == flat, count[at], 0) if len(hot) else np.zeros(len(flat), np.int64)
            order = np.lexsort((flat, f, of))
            ordered = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flat[order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), ordered, pa.array(np.diff(offsets).astype(np.int32))], names=["id", "values", "n"])

    return run


def set_classes(df: DataFrame, key: str, value: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Membership (key, class) of the records with at least `least` values, and the sets (class, values, n) once each.

    Records with equal sets form a class, named by the least of them. Null keys and values are ignored, repeated rows count
    once; values come in ascending order.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value)
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values")).filter(F.size("values") >= least)
    sets = staged(sets, "sets")
    heads = staged(sets.groupBy("values").agg(F.min(key).alias("class"), F.count(F.lit(1)).alias("_n")), "heads")
    single, several = heads.filter("_n = 1"), heads.filter("_n > 1")
    shared = sets.join(several.select("values", "class"), "values").select(key, "class")
    member = single.select(F.col("class").alias(key), "class").unionByName(shared)
    return member, heads.select("class", "values", F.size("values").alias("n"))


def overlap_join(sets: DataFrame, threshold: Fraction, least: int, max_subsets: int = MAX_SUBSETS) -> DataFrame:
    """(a, b, similarity): the pairs of classes, a < b, whose Jaccard similarity is at least the threshold.

    Two sets of sizes x and y reach the threshold if they share c(x, y) values. Small sets, those with at most
    `max_subsets` subsets of the sizes they may need, list these subsets by c and the smaller size; two that list the same
    are a result, so that no pair is tried in vain, however common the values are. A subset whose SEEDS rarest values no
    other set has among its own can't be shared and isn't listed, which spares most sets of all theirs. Large sets scan the
    inverted lists of their rarest n - c + 1 values, among which a partner must have one. All pairs found are compared
    in full at the end, by the values themselves.
    """
    spark = sets.sparkSession
    named = sets.select(F.col("class").alias("id"), "values", "n")
    values = named.select(F.explode("values").alias("v"))
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = values.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") > F.lit(total / HOT_VALUES)).filter("f > 1").toPandas().sort_values("h")
    shared = spark.sparkContext.broadcast((hot["h"].to_numpy(np.int64), hot["f"].to_numpy(np.int64)))
    hashed = named.select("id", F.transform("values", lambda v: F.xxhash64(v)).alias("values"))
    ordered = staged(hashed.mapInArrow(_rarest_first(shared), "id long, values array<long>, n int"), "distinct")
    top = largest_small(threshold, least, max_subsets)
    small = ordered.filter(F.col("n") <= top)
    seeds = small.select("id", "values").mapInArrow(_seeds(threshold, least), "key long, id long, seed long")
    seeds = staged(seeds, "seeds")
    met = seeds.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    useful = seeds.join(met, "key").groupBy("id").agg(F.collect_set("seed").alias("seeds"))
    listing = staged(small.select("id", "values").join(useful, "id"), "listing")
    lists = lambda larger, name: listing.mapInArrow(_subsets(threshold, least, larger, name), f"key long, {name} long")
    p, q = threshold.numerator, threshold.denominator
    pairs = lists(False, "x").join(lists(True, "y"), "key").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if not ordered.filter(F.col("n") > top).isEmpty():
        pairs = pairs.unionByName(_by_lists(ordered, top, threshold, least))
    pairs = pairs.distinct()
    va, vb = named.select(F.col("id").alias("a"), F.col("values").alias("_va")), named.select(F.col("id").alias("b"), F.col("values").alias("_vb"))
    both = pairs.join(va, "a").join(vb, "b").withColumn("_o", F.size(F.array_intersect("_va", "_vb")))
    union = F.size("_va") + F.size("_vb") - F.col("_o")
    return both.filter(F.col("_o") * q >= union * p).select("a", "b", (F.col("_o") / union).alias("similarity"))


def _by_lists(sets: DataFrame, top: int, threshold: Fraction, least: int) -> DataFrame:
    """Candidate pairs with at least one large set, from inverted lists over the prefixes of rarest values."""
    p, q = threshold.numerator, threshold.denominator
    low = F.greatest(F.lit(least), F.ceil(F.col("n") * p / q))
    prefix = F.col("n") - F.ceil((F.col("n") + low) * p / F.lit(p + q)) + 1
    lists = sets.select("id", "n", F.explode(F.slice("values", F.lit(1), prefix.cast("int"))).alias("v"))
    large = lists.filter(F.col("n") > top).select("v", F.col("id").alias("x"), F.col("n").alias("nx"))
    found = large.join(lists, "v").filter((F.col("x") != F.col("id")) & (F.least("n", "nx") * q >= F.greatest("n", "nx") * p))
    return found.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))


THRESHOLD, LEAST = Fraction(3, 5), 6


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "mesh_heading").select(F.col("pmid").cast("long").alias("pmid"), heading("mesh").alias("mesh"))
    member, sets = set_classes(rows, "pmid", "mesh", LEAST)
    return staged(member, "member"), staged(overlap_join(sets, THRESHOLD, LEAST), "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid_a, pmid_b): every pair of articles with at least six headings each and a similarity of at least 0.6."""
    member, links = _linked(spark, sf_dir)
    m = lambda c, as_: member.select(F.col("class").alias(c), F.col("pmid").alias(as_))
    across = links.join(m("a", "x"), "a").join(m("b", "y"), "b").select("x", "y")
    within = m("c", "x").join(m("c", "y"), "c").filter("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").cast("int").alias("pmid_a"), F.greatest("x", "y").cast("int").alias("pmid_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, class, n_copies, n_links): every article with six headings, the class of its equal sets, and its partners."""
    member, links = _linked(spark, sf_dir)
    size = member.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("class"), F.col("a").alias("other")))
    linked = ends.join(size.select(F.col("class").alias("other"), "n"), "other").groupBy("class").agg(F.sum("n").alias("k"))
    out = member.join(size, "class").join(linked, "class", "left")
    return out.select(F.col("pmid").cast("int").alias("pmid"), F.col("class").cast("int").alias("class"), F.col("n").alias("n_copies"), (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("n_links"))


P4_SQL = """
with h as (select distinct pmid, lower(trim(mesh, ' ')) m from mesh_heading where pmid is not null and nullif(trim(mesh, ' '), '') is not null),
s as (select pmid, count(*) n from h group by pmid having count(*) >= 6),
t as (select h.pmid, m, n from h join s using (pmid)),
o as (select a.pmid pmid_a, b.pmid pmid_b, a.n na, b.n nb, count(*) c from t a join t b on a.m = b.m and a.pmid < b.pmid group by all)
select pmid_a, pmid_b from o where c * 5 >= (na + nb - c) * 3
"""
P4_CLASSES_SQL = P4_SQL.replace("\nselect pmid_a, pmid_b from o", ",\nr as (select pmid_a, pmid_b from o").rstrip() + """),
e as (select pmid_a pmid from r union all select pmid_b from r),
k as (select pmid, count(*) k from e group by pmid),
v as (select pmid, list(m order by m) vs from t group by pmid)
select pmid, min(pmid) over w as class, count(*) over w n_copies, coalesce(k, 0) n_links from v left join k using (pmid) window w as (partition by vs)
"""
QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}
SQL = {"p4_found": P4_SQL, "p4_classes": P4_CLASSES_SQL}
