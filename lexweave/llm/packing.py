"""Problem 8: filling fixed-capacity containers with items."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.tokens import sized, vocabulary_of
from lexweave.session import staged, table

#: Items that are packed together in one task.
GROUP_ITEMS = 50_000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, none larger than the capacity.

    Items above a third of the capacity stand at most two to a container: the largest takes the largest other that fits
    beside it, and so on. The smaller ones then go, largest first, into the container whose gap they fill best, or open
    a new one.
    """
    bins = np.full(len(sizes), -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    large = [int(i) for i in order if sizes[i] * 3 > capacity]
    length = [int(sizes[i]) for i in large]
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0
    opened = 0

    def free(b: int, gap: int) -> None:
        nonlocal filled
        gaps[gap].append(b)
        filled |= 1 << gap

    while large:
        i, gap = large.pop(), capacity - length.pop()
        bins[i] = opened
        at = bisect_right(length, gap) - 1
        if at >= 0:
            bins[large.pop(at)] = opened
            gap -= length.pop(at)
        free(opened, gap)
        opened += 1
    for i in order[::-1]:
        size = int(sizes[i])
        if size * 3 > capacity:
            continue
        rest = filled >> size
        if rest:
            gap = size + (rest & -rest).bit_length() - 1
            b = gaps[gap].pop()
            if not gaps[gap]:
                filled &= ~(1 << gap)
        else:
            b, gap = opened, capacity
            opened += 1
        bins[i] = b
        free(b, gap - size)
    return bins


def packed(items: DataFrame, limits: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(limit_name, capacity_tokens, container_id, doc_id, part, start_token, n_tokens): a container for every item.

    items has (doc_id, n_tokens), limits (limit_name, capacity_tokens). An item above a capacity is split into full
    containers' worth and a rest, each a part of its own; no other is split. Items without tokens take no space. Items are
    dealt by hash into groups of about `group_items`, each packed by itself, so that no task grows with the data and at
    most one container in thousands is left part full for it. The limits are parameters, a few rows; those with a null or no
    positive capacity are left out.
    """
    n = items.count()
    groups = max(1, -(-n // group_items))
    caps = [F.struct(F.lit(r.limit_name).alias("limit_name"), F.lit(r.c).alias("capacity_tokens")) for r in limits.filter("capacity_tokens > 0").select("limit_name", F.col("capacity_tokens").cast("int").alias("c")).collect()]
    none = F.array().cast("array<struct<limit_name:string,capacity_tokens:int>>")
    each = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"), F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(groups)).alias("grp"))
    each = each.select("doc_id", "n", "grp", F.explode(F.array(*caps) if caps else none).alias("_l")).select("doc_id", "n", "grp", "_l.*")
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity_tokens")) - 1, F.lit(0)).cast("int")
    each = each.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("part").cast("long") * F.col("capacity_tokens")
    each = each.select("limit_name", "capacity_tokens", "grp", "doc_id", "part", start.alias("start_token"), F.least(F.col("n") - start, F.col("capacity_tokens").cast("long")).alias("n_tokens"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"], kind="stable", ignore_index=True)
        bins = pack(pdf["n_tokens"].to_numpy(), int(pdf["capacity_tokens"].iloc[0]))
        pdf["container_id"] = pdf["grp"].astype("int64") * (1 << 32) + bins
        return pdf.drop(columns="grp")[["limit_name", "capacity_tokens", "container_id", "doc_id", "part", "start_token", "n_tokens"]]

    return each.groupBy("limit_name", "capacity_tokens", "grp").applyInPandas(
        run, "limit_name string, capacity_tokens int, container_id long, doc_id long, part int, start_token long, n_tokens long"
    )


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers of all documents for each of the limits."""
    items = staged(sized(table(spark, sf_dir, "documents"), "text", ["doc_id"], vocabulary_of(spark)), "sizes")
    return packed(items, table(spark, sf_dir, "pack_limit"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(limit_name, n_items, n_containers, n_tokens, least_containers, fill) of each limit."""
    per = p8_pack(spark, sf_dir).groupBy("limit_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
    out = per.groupBy("limit_name", "capacity_tokens").agg(F.sum("k").alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))
    return out.select(
        "limit_name", "n_items", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"),
    )


def p8_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(limit_name, n_docs, overfull, broken, needless, well_filled): what must hold of the containers of each limit.

    overfull counts containers above the capacity, broken documents whose parts don't follow one another without a gap,
    needless those that were split though they fit. well_filled says whether at most one container in twenty, and one more,
    could be spared.
    """
    items = staged(p8_pack(spark, sf_dir), "packed")
    cap = F.col("capacity_tokens")
    per = items.groupBy("limit_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"))
    bins = per.groupBy("limit_name").agg(F.sum((F.col("n") > cap).cast("long")).alias("overfull"), (F.count(F.lit(1)) <= F.ceil(F.sum("n") / F.max(cap)) * 1.05 + 1).alias("well_filled"))
    whole = items.groupBy("limit_name", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.countDistinct("start_token").alias("starts"))
    broken = (F.col("n") != F.col("end")) | (F.col("starts") != F.col("k"))
    docs = whole.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(broken.cast("long")).alias("broken"), F.sum(((F.col("k") > 1) & (F.col("n") <= cap)).cast("long")).alias("needless"))
    return docs.join(bins, "limit_name").select("limit_name", "n_docs", "overfull", "broken", "needless", "well_filled")


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill, "p8_holds": p8_holds}
SQL = {
    "p8_holds": "select limit_name, (select count(*) from documents) n_docs, 0::bigint overfull, 0::bigint broken, 0::bigint needless, true well_filled from pack_limit where capacity_tokens > 0",
}
