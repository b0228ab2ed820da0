"""Where given pairs of records stand among all, by the keys that they share, without a row for each pair that shares one.

The commonest keys are bits of a pattern, so that the records that share so many of these with a source are counted from the
counts of the patterns. What the other keys add is counted pair by pair in the tasks, in a histogram for each source; from that
comes the rank of any of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.products import _plain
from lexweave.operators.similarity import with_ids
from lexweave.session import parts_of, small_or_shuffled, staged

#: Keys that are bits, at most; records of a read, pairs that a task makes at once, sources of a task.
BITS, READ, PAIRS, OF_TASK = 12, 1 << 15, 1 << 22, 1 << 16


def _lists(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False)), col.flatten().to_numpy()


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, where the values of each begin (and those of the last end), and the values by key."""
    by = np.argsort(keys, kind="stable")
    out, first = np.unique(keys[by], return_index=True)
    return out, np.append(first, len(keys)), values[by]


def _expanded(keys: np.ndarray, start: np.ndarray, values: np.ndarray, wanted: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, of) for each value of each wanted key."""
    if not len(keys):
        return values[:0], of[:0]
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[i] == wanted
    i, of = i[there], of[there]
    n = start[i + 1] - start[i]
    return values[np.repeat(start[i] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(of, n)


class Sources:
    """The sources of a task; of each how many records share 0, 1, 2... keys with it, and what its own pairs share."""

    def __init__(self, rows: pa.Table, patterns: np.ndarray, counts: np.ndarray):
        self.ids, self.pattern = (rows[c].to_numpy() for c in ("src", "_p"))
        at, terms = _lists(rows["_k"])
        self.terms = _grouped(terms, at)
        at_rel, rels = _lists(rows["_r"])
        self.rels = _grouped(rels, at_rel)
        self.width = BITS + 2 + int(np.bincount(at, minlength=1).max())
        self.hist = np.zeros((len(self.ids), self.width), np.int64)
        own, which = np.unique(self.pattern, return_inverse=True)
        base = np.zeros((len(own), self.width), np.int64)
        for i, p in enumerate(own):
            base[i] = np.bincount(np.bitwise_count(patterns & p), counts, self.width)
        self.hist += base[which]
        np.add.at(self.hist, (np.arange(len(self.ids)), np.bitwise_count(self.pattern)), -1)  # itself
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, pattern: np.ndarray, at: np.ndarray, terms: np.ndarray) -> None:
        """Records, with the records' numbers and values of their other keys."""
        keys, start, _ = self.terms
        if len(keys) and len(ids) > 1:
            i = np.minimum(np.searchsorted(keys, terms), len(keys) - 1)
            if np.where(keys[i] == terms, start[i + 1] - start[i], 0).sum() > PAIRS:
                half = len(ids) // 2
                low = at < half
                self.add(ids[:half], pattern[:half], at[low], terms[low])
                self.add(ids[half:], pattern[half:], at[~low] - half, terms[~low])
                return
        s, d = _expanded(*self.terms, terms, at)
        pairs, shared = np.unique(s * len(ids) + d, return_counts=True)
        s, d = pairs // len(ids), pairs % len(ids)
        other = self.ids[s] != ids[d]
        hot = np.bitwise_count(self.pattern[s] & pattern[d]).astype(np.int64)
        cells = s * self.width + hot
        np.add.at(self.hist.reshape(-1), cells[other], -1)
        np.add.at(self.hist.reshape(-1), (cells + shared)[other], 1)
        s, d = _expanded(*self.rels, ids, np.arange(len(ids)))
        n = np.bitwise_count(self.pattern[s] & pattern[d]).astype(np.int64)
        if len(pairs):
            i = np.minimum(np.searchsorted(pairs, s * len(ids) + d), len(pairs) - 1)
            n += np.where(pairs[i] == s * len(ids) + d, shared[i], 0)
        self.found.append((s[n > 0], n[n > 0]))

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The sources of which pairs are among the first k, and how many."""
        above = np.zeros_like(self.hist)
        above[:, :-1] = self.hist[:, :0:-1].cumsum(axis=1)[:, ::-1]
        s, n = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 2
        count = np.bincount(s[above[s, n] < k], minlength=len(self.ids))
        return self.ids[count > 0], count[count > 0]


def _records(files: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            for part in parquet.ParquetFile(f).iter_batches(READ, columns=["rel", "_p", "_k"]):
                if part.num_rows:
                    yield part["rel"].to_numpy(), part["_p"].to_numpy(), *_lists(part["_k"])


def among_best(pairs: DataFrame, heads: DataFrame, key: str, k: int) -> DataFrame:
    """(src, n): of each src how many of its pairs (src, rel) are among the k others that share the most keys with it, ties included.

    heads has (pmid, key), pairs (src, rel), both without repeated rows; pairs share a key at least. Sources without such a
    pair are left out. The counts of the patterns, at most 2 ** BITS of them, go to the driver.
    """
    spark = heads.sparkSession
    counts = staged(heads.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "counts")
    hot = [r[0] for r in counts.orderBy(F.desc("_n"), key).limit(BITS).collect()]
    bits = spark.createDataFrame([(x, 1 << i) for i, x in enumerate(hot)], f"{key} {heads.schema[key].dataType.simpleString()}, _bit long")
    rare = staged(with_ids(counts.join(F.broadcast(bits), key, "left_anti").select(key), key, "_t"), "ids")
    names = staged(rare.select(key, "_t", F.lit(0).cast("long").alias("_bit")).unionByName(bits.withColumn("_t", F.lit(None).cast("long"))), "names")
    coded = heads.select("pmid", key).join(small_or_shuffled(names), key).groupBy("pmid").agg(F.sum("_bit").alias("_p"), F.collect_list("_t").alias("_k"))
    records = staged(coded.select(F.col("pmid").cast("long").alias("rel"), "_p", "_k").repartition(parts_of(spark)), "records")
    files = sorted(_plain(f) for f in records.inputFiles())
    seen = records.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).collect()
    patterns, numbers = (np.array([r[i] for r in seen], np.int64) for i in (0, 1))
    wanted = pairs.groupBy(F.col("src").cast("long").alias("src")).agg(F.collect_list(F.col("rel").cast("long")).alias("_r"))
    own = staged(wanted.join(records.withColumnRenamed("rel", "src"), "src"), "sources")
    n = own.count()
    tasks = max(1, min(n // 8, max(2 * spark.sparkContext.defaultParallelism, -(-n // OF_TASK))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            sources = Sources(pa.Table.from_batches(held), patterns, numbers)
            for record in _records(files):
                sources.add(*record)
            yield from pa.table(dict(zip(("src", "n"), sources.best(k), strict=True))).to_batches()

    out = own.repartition(tasks, "src").mapInArrow(run, "src long, n long")
    return out.select(F.col("src").cast(pairs.schema["src"].dataType), "n")
