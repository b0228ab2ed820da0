"""Writers. Nothing is gathered on the driver except where a single local file is asked for."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.embedded import is_embedded, put


class PathExists(Exception):
    """An output is there already."""


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def guard(spark: SparkSession, *paths: str) -> None:
    """Raises PathExists if any of the outputs of a job is there, before any is written."""
    there = [p for p in paths if exists(spark, p)]
    if there:
        raise PathExists(", ".join(there))


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet files; an existing path is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def dictionary(spark: SparkSession, values: dict, path: str) -> None:
    """(key, value) of a bounded dictionary."""
    kind = {int: "long", float: "double", str: "string"}[type(next(iter(values.values()), ""))]
    parquet(spark.createDataFrame(list(values.items()), f"key string, value {kind}"), path)


def text(df: DataFrame, path: str) -> None:
    """Text files of a column of lines."""
    df.write.mode("errorifexists").text(path)


def tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("errorifexists").csv(path, sep="\t", header=header, quote="", escapeQuotes=False, emptyValue="")


def local_file(df: DataFrame, path: str, key: str) -> None:
    """One local file of the lines in `line`, in the order of `key` as a string; rows stream through the driver."""
    with open(path, "w") as f:
        for row in df.orderBy(F.col(key).cast("string")).select("line").toLocalIterator():
            f.write(row[0] + "\n")


def chunked(df: DataFrame, path: str, chunk: str = "chunk") -> None:
    """One folder for each chunk."""
    parquet(df, path, [chunk])


def per_source(df: DataFrame, path: str, source: str, line: str) -> None:
    """A folder with a text report for each source."""
    df.select(source, line).repartition(source).write.mode("errorifexists").partitionBy(source).text(path)


def per_source_files(df: DataFrame, folder: str, source: str, line: str) -> None:
    """per_source() for a folder of the file system: tasks write the files of their sources themselves, their lines in order."""

    def run(rows: Iterable[Row]) -> None:
        for row in rows:
            at = f"{folder}/{source}={row[0]}"
            os.makedirs(at, exist_ok=True)
            with open(f"{at}/.{os.getpid()}", "w", encoding="utf-8", newline="") as f:
                f.write("".join(x + "\n" for x in row[1]))
            os.replace(f.name, f"{at}/part.txt")  # whole, also if a task is run again

    os.makedirs(folder)
    df.groupBy(source).agg(F.sort_array(F.collect_list(line)).alias(line)).foreachPartition(run)


def xml_sets(df: DataFrame, path: str, key: str, line: str, rows: int = 5000) -> None:
    """XML files of about `rows` elements each, below one root."""
    files = max(1, -(-df.count() // rows))
    sets = df.groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("_f")).agg(F.concat_ws("\n", F.collect_list(line)).alias("value"))
    sets = sets.select(F.concat(F.lit("<Set>\n"), F.col("value"), F.lit("\n</Set>")).alias("value"))
    sets.write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path)


def key_value(df: DataFrame, connect: Callable[[], object], put: Callable[[object, list[Row]], None], batch: int = 10_000) -> None:
    """Rows put into an external store, one connection for each partition, in batches; the last one is flushed too."""

    def run(rows: Iterable[Row]) -> None:
        client, held = connect(), []
        for row in rows:
            held.append(row)
            if len(held) >= batch:
                put(client, held)
                held = []
        if held:
            put(client, held)

    df.foreachPartition(run)


def jdbc(df: DataFrame, url: str, table_name: str, mode: str = "overwrite", **options: str) -> None:
    if is_embedded(url):
        return put(df, url, table_name, mode, **options)
    df.write.format("jdbc").options(url=url, dbtable=table_name, **options).mode(mode).save()


def bucketed(df: DataFrame, name: str, key: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by its key, so that later joins on it need no shuffle."""
    df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
