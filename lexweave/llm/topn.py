"""Problem 7: the N highest-scoring items of every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.session import stage_path, table

#: Rows of a row group of the clustered copy; statistics are kept for each. It is what is read of a large group for its best.
ROW_GROUP = 4_000
#: Rows of a group's shard; a group with more is spread over several.
SHARD_ROWS = 500_000
#: Most groups that are split, whatever the data's size: a group is split from rows / SPLIT_GROUPS rows on, if that is more.
SPLIT_GROUPS = 100_000


def _best(group: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first n items of each group by descending score, then ascending item; of an item's scores the highest."""
    order = np.lexsort((item, -score, group))
    group, item, score = group[order], item[order], score[order]
    pair = np.lexsort((np.arange(len(group)), item, group))
    first = np.ones(len(group), bool)
    first[pair[1:]] = (group[pair[1:]] != group[pair[:-1]]) | (item[pair[1:]] != item[pair[:-1]])
    group, item, score = group[first], item[first], score[first]
    start = np.ones(len(group), bool)
    start[1:] = group[1:] != group[:-1]
    at = np.flatnonzero(start)
    rank = np.arange(len(group)) - np.repeat(at, np.diff(np.append(at, len(group))))
    keep = rank < n
    return group[keep], item[keep], score[keep]


def _skipping(n: int):
    """Reads the row groups of each clustered file in descending maximum score and skips those that can't matter.

    A row group is skipped if its maximum is strictly below the current n-th score of every group that it holds. A file
    is sorted by group and descending score, so a row group of several groups holds the best of all but its first, and only
    its last goes on in others: that one's n-th score is kept, and row groups inside it are those that can be skipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    file = pq.ParquetFile(source)
                    groups = []
                    for i in range(file.num_row_groups):
                        meta = file.metadata.row_group(i)
                        g, s = meta.column(0).statistics, meta.column(2).statistics
                        known = g is not None and s is not None and g.has_min_max and s.has_min_max
                        groups.append((i, g.min if known else None, g.max if known else None, s.max if known else np.inf))
                    groups.sort(key=lambda r: (-r[3], r[0]))
                    nth: dict[int, float] = {}
                    going_on: dict[int, tuple] = {}
                    parts = []
                    read = 0
                    for i, low, high, most in groups:
                        if low is not None and low == high and most < nth.get(low, -np.inf):
                            continue
                        read += 1
                        rows = file.read_row_group(i, columns=["g", "i", "s"])
                        part = _best(rows["g"].to_numpy(), rows["i"].to_numpy(), rows["s"].to_numpy(), n)
                        last = part[0][-1]
                        at = int(np.searchsorted(part[0], last))
                        parts.append(tuple(c[:at] for c in part))
                        own = tuple(c[at:] for c in part)
                        if last in going_on:
                            own = _best(*(np.concatenate(c) for c in zip(going_on[last], own)), n)
                        going_on[last] = own
                        if len(own[0]) >= n:
                            nth[last] = own[2][n - 1]
                parts += going_on.values()
                if parts:
                    g, i, s = _best(*(np.concatenate(c) for c in zip(*parts)), n)
                    stat = np.zeros(len(g), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(i), pa.array(s), pa.array(stat + read), pa.array(stat + len(groups))], names=["g", "i", "s", "n_read", "n_groups"])

    return run


def _uri(path: str) -> str:
    """A path of Hadoop's as the Arrow file systems know it."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        return path.replace("file:/", "file:///", 1)
    return path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path


def clustered(df: DataFrame, group: str, item: str, score: str, shard_rows: int = SHARD_ROWS, row_group: int = ROW_GROUP, path: str | None = None) -> str:
    """A copy of (group, item, score) clustered by group, each file sorted by group and descending score; its path.

    Rows with a null in any column or a NaN score are left out. A group with more than `shard_rows` rows, and more than one
    in SPLIT_GROUPS of all, goes to several files by the hash of its items, so that repeated pairs stay together; there are
    fewer than SPLIT_GROUPS such groups, which bounds the broadcast. The copy can be kept and asked again for any n.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).cast("long").alias("g"), F.col(item).cast("long").alias("i"), F.col(score).cast("double").alias("s"))
    rows = rows.filter("g is not null and i is not null and s is not null and not isnan(s)")
    most = max(shard_rows, -(-rows.count() // SPLIT_GROUPS))
    large = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most)
    large = large.select("g", F.ceil(F.col("c") / most).cast("int").alias("n"))
    cut = rows.join(F.broadcast(large), "g", "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("i"), "n"), F.lit(0)))
    path = path or stage_path(spark, "clustered")
    (
        cut.repartition("g", "shard")
        .sortWithinPartitions("g", F.desc("s"))
        .select("g", "i", "s")
        .write.option("parquet.block.row.count.limit", str(row_group))
        .option("parquet.enable.dictionary", "false")
        .parquet(path)
    )
    return path


def best_of(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(g, i, s, rank, n_read, n_groups): the n best items of every group of a clustered copy, by score, then by item."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    listing = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    files = [f.getPath().toString() for f in listing if f.getPath().getName().endswith(".parquet")]
    paths = spark.createDataFrame([(_uri(f), k) for k, f in enumerate(sorted(files))], "path string, _k int")
    best = paths.repartitionById(max(1, len(files)), "_k").select("path").mapInArrow(_skipping(n), "g long, i long, s double, n_read int, n_groups int")
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "i"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, shard_rows: int = SHARD_ROWS, row_group: int = ROW_GROUP) -> DataFrame:
    """(g, i, s, rank, n_read, n_groups): the n best items of every group, by score, then by ascending item.

    Of several scores of a pair the highest counts. Rows with null or NaN scores or null keys are no scores. n_read and
    n_groups tell how many row groups of the item's file were read, and how many it has. The best of a shard are found
    from statistics; those of all shards of a group, at most n times their number, are ranked at the end.
    """
    return best_of(df.sparkSession, clustered(df, group, item, score, shard_rows, row_group), n)


_kept: dict[tuple, str] = {}


def _scores(spark: SparkSession, sf_dir: str) -> str:
    """The clustered copy of pp_score, made once for a session and version of the table and kept until the driver ends."""
    df = table(spark, sf_dir, "pp_score")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    version = []
    for f in sorted(df.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        version.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, *version)
    at = jvm.org.apache.hadoop.fs.Path(f"{_kept[key]}/_SUCCESS") if key in _kept else None
    if at is None or not at.getFileSystem(conf).exists(at):
        _kept[key] = clustered(df, "src_pmid", "rel_pmid", "score")
    return _kept[key]


def p7_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_pmid, rel_pmid, score, rank): the ten best of every source."""
    best = best_of(spark, _scores(spark, sf_dir), 10)
    return best.select(F.col("g").cast("int").alias("src_pmid"), F.col("i").cast("int").alias("rel_pmid"), F.col("s").alias("score"), "rank")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_pmid, rel_pmid): the ten best of every source."""
    return p7_top(spark, sf_dir).select("src_pmid", "rel_pmid")


def p7_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_pmid, n_read, n_groups): of each source's files, how many row groups were read for its best, and how many there are."""
    best = best_of(spark, _scores(spark, sf_dir), 10).groupBy("g").agg(F.max("n_read").alias("n_read"), F.max("n_groups").alias("n_groups"))
    return best.select(F.col("g").cast("int").alias("src_pmid"), "n_read", "n_groups")


P7_SQL = """
with b as (select src_pmid, rel_pmid, max(score) score from pp_score where src_pmid is not null and rel_pmid is not null and score is not null and not isnan(score) group by all)
select *, row_number() over (partition by src_pmid order by score desc, rel_pmid) as rank from b qualify rank <= 10
"""
QUERIES = {"p7_found": p7_found, "p7_top": p7_top, "p7_reads": p7_reads}
SQL = {"p7_found": f"select src_pmid, rel_pmid from ({P7_SQL})", "p7_top": P7_SQL}
