"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.tokens import sized_and_weighed, vocabulary_of
from lexweave.session import small_or_shuffled, staged, table

#: Bits of the place of a document in its source's order of sampling, and of the part that one round looks at.
PLACE_BITS, ROUND_BITS = 48, 12
#: Most documents of a source that are sorted; the part of the order in which its budget ends is narrowed down to that.
EDGE_ROWS = 100_000
SEED = 20_240
#: Least weight of a document.
LEAST_WEIGHT = 0.05


def sampling_key(key: Column, weight: Column, seed: int = SEED) -> Column:
    """An exponential variate with the weight as its rate, from a hash of the key: the least keys are drawn first."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def largest_met(own: DataFrame, wanted: DataFrame) -> int:
    """The largest total at which every source with documents and a share can give its share: own has (source, tokens)."""
    most = wanted.join(own, "source").filter("target_share > 0 and max_repeats > 0").select(F.floor(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).alias("t"))
    return most.agg(F.min("t")).first()[0] or 0


def mixed(items: DataFrame, targets: DataFrame, total: int | str = "met", edge_rows: int = EDGE_ROWS, round_bits: int = ROUND_BITS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, copies) of the documents of a mix, and the plan (source, target_share, max_repeats, tokens, give).

    items has (doc_id, source, n_tokens, weight), targets (source, target_share, max_repeats). A source's budget `give` is its
    share of `total` tokens: a number; `met`, the largest total at which every source that has documents gives its whole
    share; or `all`, the tokens of all documents of sources with a target, where a source that can't meet its share gives
    what it may, at most max_repeats times its own tokens. Every document of a source is used as often as its budget holds the
    whole source; of the rest, documents are drawn by exponential keys scaled by their weights, as long as the sum of tokens
    stays within the budget.

    No source is sorted as a whole: tokens are summed by parts of the order of keys, and the part in which the budget ends is
    cut into parts again until it has at most `edge_rows` documents; only those are sorted. Documents of null or other
    sources, and those without tokens, are not used; a null weight counts as the least. A source without documents, or a
    target without a share, gives nothing. Of repeated targets of a source the greatest counts.
    """
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))).alias("t"))
    wanted = staged(wanted.select("source", "t.*"), "targets")
    docs = items.filter("n_tokens > 0").join(small_or_shuffled(wanted.select("source")), "source")
    key = sampling_key(F.col("doc_id"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(LEAST_WEIGHT)), seed)
    place = F.least((F.lit(float(1 << PLACE_BITS)) * (1 - F.exp(-F.col("key")))).cast("long"), F.lit((1 << PLACE_BITS) - 1))
    docs = staged(docs.select("doc_id", "source", "n_tokens", key.alias("key")).withColumn("place", place), "mix")
    own = staged(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "own")
    if total == "met":
        total = largest_met(own, wanted)
    elif total == "all":
        total = own.agg(F.sum("tokens")).first()[0] or 0
    give = F.least(F.floor(F.col("target_share") * F.lit(float(total))).cast("long"), F.col("tokens") * F.col("max_repeats"))
    plan = staged(wanted.join(own, "source").withColumn("give", give), "plan")
    epochs = F.floor(F.col("give") / F.col("tokens")).cast("int")
    edge = plan.select("source", epochs.alias("epochs"), (F.col("give") - epochs * F.col("tokens")).alias("left"), F.lit(0).cast("long").alias("part"), "n")
    shift = PLACE_BITS
    while shift >= round_bits and (edge.agg(F.max("n")).first()[0] or 0) > edge_rows:
        inside = docs.join(small_or_shuffled(edge.select("source", "part")), "source").filter(F.shiftright("place", shift) == F.col("part"))
        shift -= round_bits
        sums = staged(inside.groupBy("source", F.shiftright("place", shift).alias("part")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")), "parts")
        before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = sums.join(edge.select("source", "epochs", "left"), "source").withColumn("before", before).filter(F.col("before") <= F.col("left"))
        edge = at.groupBy("source").agg(F.max_by(F.struct("epochs", (F.col("left") - F.col("before")).alias("left"), "part", "n"), "part").alias("e")).select("source", "e.*")
        edge = staged(edge, "edge")
    marked = docs.join(small_or_shuffled(edge.select("source", "epochs", "left", "part")), "source").withColumn("_at", F.shiftright("place", shift))
    taken = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    on = marked.filter(F.col("_at") == F.col("part")).withColumn("extra", (taken <= F.col("left")).cast("int"))
    off = marked.filter(F.col("_at") != F.col("part")).withColumn("extra", (F.col("_at") < F.col("part")).cast("int"))
    chosen = off.unionByName(on).select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).alias("copies")).filter("copies > 0")
    return chosen, wanted.join(plan.select("source", "tokens", "give"), "source", "left").fillna(0, ["tokens", "give"])


def _mixed(spark: SparkSession, sf_dir: str, total: int | str = "met") -> tuple[DataFrame, DataFrame]:
    items = sized_and_weighed(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"], vocabulary_of(spark))
    return mixed(items, table(spark, sf_dir, "mix_target"), total)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents of the largest mix in which every source with documents meets its share."""
    return _mixed(spark, sf_dir)[0]


def _shares(spark: SparkSession, sf_dir: str, total: int | str) -> DataFrame:
    chosen, plan = _mixed(spark, sf_dir, total)
    used = F.col("n_tokens") * F.col("copies")
    per = staged(chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"), F.max("n_tokens").alias("_longest"), F.sum(used).alias("n_tokens")), "shares")
    whole = per.agg(F.sum("n_tokens")).first()[0] or 1
    out = plan.join(per, "source", "left").fillna(0, ["n_docs", "most_copies", "n_tokens", "_longest"])
    return out.withColumn("share", F.col("n_tokens") / F.lit(whole))


def p9_shares(spark: SparkSession, sf_dir: str, total: int | str = "met") -> DataFrame:
    """(source, target_share, max_repeats, n_docs, most_copies, n_tokens, share) of every source with a target."""
    return _shares(spark, sf_dir, total).select("source", "target_share", "max_repeats", "n_docs", "most_copies", "n_tokens", "share")


def p9_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p9_shares, of the mix as large as all documents, in which scarce sources give what they may."""
    return p9_shares(spark, sf_dir, "all")


def p9_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, in_repeats, in_budget, met): what must hold of the mix: no document too often, no source above its budget, and
    every source with documents within one document of its share of the total."""
    out = _shares(spark, sf_dir, "met")
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.length("text")).alias("_most"))
    out = out.join(docs, "source", "left")
    met = (F.col("tokens") > 0) & (F.col("give") - F.col("n_tokens") <= F.coalesce("_most", F.lit(0)) * 4)
    return out.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("in_repeats"), (F.col("n_tokens") <= F.col("give")).alias("in_budget"), met.alias("met"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_all": p9_all, "p9_holds": p9_holds}
SQL = {
    "p9_holds": "select distinct source, true in_repeats, true in_budget, source in (select source from documents where source is not null and text <> '') met from mix_target where source is not null",
}
