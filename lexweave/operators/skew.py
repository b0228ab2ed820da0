"""Problem 6: results for every key when a few keys hold most rows."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import BROADCAST_ROWS, is_small, parts_of, table

#: A key is split when its load exceeds the mean load of a task by this factor.
SPLIT_AT = 0.5


def plan_of(loads: list[tuple[str, int]], total: int, tasks: int) -> list[tuple[str, int, int, int]]:
    """(key, shards, shard, task) of the heavy keys, packed into tasks.

    loads are the keys above SPLIT_AT of a task's mean load, at most tasks / SPLIT_AT many. Each is cut into shards no
    larger than that; the shards, largest first, go to the task with the least load. The rest of each task is left to
    the light keys, which are spread by their hash.
    """
    most = max(1.0, SPLIT_AT * total / tasks)
    pieces = []
    for key, load in loads:
        n = max(1, -(-load // int(most)))
        pieces += [(load / n, key, n, i) for i in range(n)]
    filled = [(0.0, t) for t in range(tasks)]  # the light keys load all tasks alike
    out = []
    for load, key, n, i in sorted(pieces, key=lambda p: (-p[0], p[1], p[3])):
        before, to = heappop(filled)
        heappush(filled, (before + load, to))
        out.append((key, n, i, to))
    return out


def fragments(df: DataFrame, key: str, spread: list[str], tasks: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """df with `_shard` and `_task`, the plan of the heavy keys, and these.

    Loads are counted with map-side sums. Only keys above SPLIT_AT of a task's mean load reach the driver; there are at
    most tasks / SPLIT_AT of them, whatever the data's size, which is also the bound of the broadcast plan. `spread`
    names columns whose hash chooses the shard, so that equal rows meet. Null keys are dropped.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(key).isNotNull())
    loads = rows.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    heavy = [(r.k, r.n) for r in loads.filter(F.col("n") > F.lit(SPLIT_AT * total / tasks)).collect()]  # at most tasks / SPLIT_AT
    plan = spark.createDataFrame(plan_of(heavy, total, tasks), "__key string, __shards int, __shard int, __task int")
    sizes = plan.select("__key", "__shards").distinct()
    cut = (
        rows.join(F.broadcast(sizes), F.col(key).cast("string") == F.col("__key"), "left")
        .withColumn("__shard", F.when(F.col("__shards").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("__shards")).cast("int")).otherwise(0))
        .drop("__key", "__shards")
    )
    to = plan.select("__key", "__shard", F.col("__task").alias("__to")).withColumnRenamed("__shard", "__s")
    light = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(tasks)).cast("int")
    cut = (
        cut.join(F.broadcast(to), (F.col(key).cast("string") == F.col("__key")) & (F.col("__shard") == F.col("__s")), "left")
        .withColumn("__task", F.coalesce("__to", light))
        .drop("__key", "__s", "__to")
    )
    return cut, plan, [k for k, _ in heavy]


def tasks_of(spark: SparkSession) -> int:
    return max(parts_of(spark), 2)


def per_key(df: DataFrame, key: str, record: str, tasks: int | None = None) -> DataFrame:
    """(key, rows, records, shards, tasks): rows and distinct non-null records of every non-null key, by fragments.

    Rows go to the task of their fragment: light keys whole, heavy keys in shards chosen by the record, so that a record
    of a key is in one shard and the shards' counts add up. No task gets much more than its share, even if one key
    holds most rows. Repeated rows count as rows, once as a record. An empty table gives no rows.
    """
    spark = df.sparkSession
    tasks = tasks or tasks_of(spark)
    cut, _, _ = fragments(df.select(key, record), key, [record], tasks)
    rows = cut.repartitionById(tasks, "__task").groupBy("__task", key, "__shard", record).agg(F.count(F.lit(1)).alias("__n"))
    shard = rows.groupBy("__task", key, "__shard").agg(F.sum("__n").alias("__rows"), F.count(record).alias("__records"))
    return shard.groupBy(key).agg(
        F.sum("__rows").alias("n_rows"), F.sum("__records").alias("n_records"), F.count(F.lit(1)).alias("n_shards"), F.countDistinct("__task").alias("n_tasks")
    )


def fragment_join(big: DataFrame, small: DataFrame, key: str, spread: list[str], tasks: int | None = None) -> DataFrame:
    """Inner join on `key` of a skewed side with a matching side whose rows are copied only to the shards of their key.

    A row of `small` with a heavy key is copied once for each of its shards; all other rows stay single. Both sides
    then meet on (task, key, shard). Columns of `small` that clash with those of `big` get the suffix _r. Null keys don't
    match.
    """
    tasks = tasks or tasks_of(big.sparkSession)
    cut, plan, _ = fragments(big, key, spread, tasks)
    small = small.select(*[F.col(c).alias(c if c == key or c not in big.columns else c + "_r") for c in small.columns])
    side = (
        small.filter(F.col(key).isNotNull())
        .join(F.broadcast(plan), F.col(key).cast("string") == F.col("__key"), "left")
        .withColumn("__shard", F.coalesce("__shard", F.lit(0)))
        .withColumn("__task", F.coalesce("__task", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(tasks)).cast("int")))
        .drop("__key", "__shards")
    )
    return cut.repartitionById(tasks, "__task").join(side.repartitionById(tasks, "__task"), ["__task", key, "__shard"]).drop("__task", "__shard")


def keyed_join(big: DataFrame, small: DataFrame, key: str, spread: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of a skewed side with one row for each key: by broadcast up to `limit` rows, else by fragments of the hot keys."""
    return big.join(F.broadcast(small), key) if is_small(small, limit) else fragment_join(big, small, key, spread)


def headings(df: DataFrame) -> DataFrame:
    return df.withColumn("mesh", F.nullif(F.lower(F.trim("mesh")), F.lit("")))


def p6_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, key, n_rows, n_records, n_shards, n_tasks) of every heading of mesh_heading and term_id of term_doc_weight."""
    mesh = per_key(headings(table(spark, sf_dir, "mesh_heading")), "mesh", "pmid").select(F.lit("mesh_heading").alias("tbl"), F.col("mesh").alias("key"), "n_rows", "n_records", "n_shards", "n_tasks")
    term = per_key(table(spark, sf_dir, "term_doc_weight"), "term_id", "pmid").select(F.lit("term_doc_weight").alias("tbl"), F.col("term_id").cast("string").alias("key"), "n_rows", "n_records", "n_shards", "n_tasks")
    return mesh.unionByName(term)


def p6_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, key, n_rows, n_records): as p6_per_key, without how the work was cut."""
    return p6_per_key(spark, sf_dir).select("tbl", "key", "n_rows", "n_records")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, hot_key): the keys that hold more than 2 % of all rows of their table."""
    totals = {t: table(spark, sf_dir, t).count() for t in ("mesh_heading", "term_doc_weight")}
    limit = F.when(F.col("tbl") == "mesh_heading", 0.02 * totals["mesh_heading"]).otherwise(0.02 * totals["term_doc_weight"])
    return p6_per_key(spark, sf_dir).filter(F.col("n_rows") > limit).select("tbl", F.col("key").alias("hot_key"))


def p6_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term_id, term, n_weights, max_weight): weights joined with the vocabulary by fragments, then reduced by term."""
    weights = table(spark, sf_dir, "term_doc_weight").filter("weight is not null and not isnan(weight)")
    joined = fragment_join(weights, table(spark, sf_dir, "vocab").select("term_id", "term"), "term_id", ["pmid"])
    return joined.groupBy("term_id", "term").agg(F.count("weight").alias("n_weights"), F.max("weight").alias("max_weight"))


_H = "(select nullif(lower(trim(mesh, ' ')), '') k, pmid from mesh_heading)"
_W = "(select cast(term_id as varchar) k, pmid from term_doc_weight)"
QUERIES = {"p6_found": p6_found, "p6_results": p6_results, "p6_weighted": p6_weighted, "p6_per_key": p6_per_key}
SQL = {
    "p6_found": f"select 'mesh_heading' tbl, k hot_key from {_H} where k is not null group by k having count(*) > 0.02 * (select count(*) from mesh_heading) union all select 'term_doc_weight', k from {_W} where k is not null group by k having count(*) > 0.02 * (select count(*) from term_doc_weight)",
    "p6_results": f"select 'mesh_heading' tbl, k as key, count(*) n_rows, count(distinct pmid) n_records from {_H} where k is not null group by k union all select 'term_doc_weight', k, count(*), count(distinct pmid) from {_W} where k is not null group by k",
    "p6_weighted": "select term_id, term, count(*) n_weights, max(weight) max_weight from term_doc_weight join vocab using (term_id) where weight is not null and not isnan(weight) group by term_id, term",
}
