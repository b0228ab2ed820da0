"""Products of a set of sources with all rows, in blocks: the best of them without a row for each pair, or all of them.

The rows are staged in the order of their documents. A task holds a share of the sources and leads all rows past them, some
thousands of documents at a time: terms that most pairs share by a dense product, the others pair by pair. Of the products,
only those that may be among the best of a source leave the block that they arise in; where all are asked for, they leave it
at once, so that pairs are neither shuffled nor held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import is_small, parts_of, staged

#: Documents and sources of a block, rows of a read, most sources of a task.
DOCS, SOURCES, READ, OF_TASK = 4096, 256, 1 << 16, 1024
#: Pairs that are looked at together where all are returned, and rows of a batch of these.
CELLS, SENT = 1 << 18, 1 << 16
#: Sums of whole numbers below this are exact in a double.
EXACT = float(1 << 53)
#: Ratios closer than this are left to be told apart by their rounded values.
NEAR = 2e-9


class Own:
    """The sources of a task: their rows by term, and of each its size."""

    def __init__(self, rows: pa.Table):
        src, term, weight, size = (rows[c].to_numpy() for c in ("src", "_t", "_a", "_n"))
        self.ids, at, first = np.unique(src, return_index=True, return_inverse=True)
        self.sizes = size[at].astype(float)
        self.terms, t = np.unique(term, return_inverse=True)
        by = np.argsort(t, kind="stable")
        self.src, self.weight = first[by], weight[by]
        self.ptr = np.searchsorted(t[by], np.arange(len(self.terms) + 1))
        self.most = float(np.bincount(first, np.abs(weight).astype(float)).max()) if len(src) else 0.0
        self.positive = bool((weight > 0).all())
        self.hot: np.ndarray | None = None

    def split(self, t: np.ndarray, n_docs: int) -> None:
        """Chooses the terms of the dense product by a first block: those whose pairs are many."""
        pairs = np.bincount(t, minlength=len(self.terms)) * np.diff(self.ptr)
        self.hot = np.flatnonzero(pairs > n_docs * len(self.ids) / 100)
        self.column = np.full(len(self.terms), -1)
        self.column[self.hot] = np.arange(len(self.hot))
        self.dense = self.dense_of(self.weight)

    def dense_of(self, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.ids), len(self.hot)), np.int64)
        for k, h in enumerate(self.hot):
            i = slice(self.ptr[h], self.ptr[h + 1])
            np.add.at(out[:, k], self.src[i], weight[i])
        return out


class Block:
    """Some documents: their rows as (own term, document, weight)."""

    def __init__(self, own: Own, t: np.ndarray, d: np.ndarray, w: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        self.own, self.ids, self.sizes = own, ids, sizes.astype(float)
        if own.hot is None:
            own.split(t, len(ids))
        self.exact = own.most * (float(np.abs(w).max()) if len(w) else 0.0) < EXACT
        self.positive = own.positive and bool((w > 0).all())
        self.rows = t, d, w
        self.sums = self._prepared(own.dense, own.weight, w)

    def _prepared(self, dense: np.ndarray, weight: np.ndarray, w: np.ndarray):
        own, (t, d, _) = self.own, self.rows
        kind = np.float64 if self.exact else np.int64
        at = own.column[t]
        hot = at >= 0
        right = np.zeros((len(own.hot), len(self.ids)), np.int64)
        np.add.at(right, (at[hot], d[hot]), w[hot])
        t, d, w = t[~hot], d[~hot], w[~hot]
        n = own.ptr[t + 1] - own.ptr[t]
        i = np.repeat(own.ptr[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        s, d, v = own.src[i], np.repeat(d, n), weight[i] * np.repeat(w, n)
        by = np.argsort(s, kind="stable")
        return dense.astype(kind), right.astype(kind), s[by], d[by], v[by].astype(kind)

    def product(self, lo: int, hi: int, prepared=None) -> np.ndarray:
        """The sums of the products of the sources lo to hi with all documents of the block."""
        left, right, s, d, v = prepared or self.sums
        out = left[lo:hi] @ right
        a, b = np.searchsorted(s, (lo, hi))
        if b > a:
            np.add.at(out.reshape(-1), (s[a:b] - lo) * out.shape[1] + d[a:b], v[a:b])
        return out

    def shared(self, lo: int, hi: int, units: np.ndarray) -> np.ndarray:
        """Whether they share any term, which a sum of 0 leaves open unless all weights are above 0."""
        if self.positive:
            return units > 0
        if not hasattr(self, "_ones"):
            one = np.ones_like(self.own.weight)
            self._ones = self._prepared(self.own.dense_of(one), one, np.ones_like(self.rows[2]))
        return self.product(lo, hi, self._ones) > 0


def _true_at(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero, faster for masks that are False nearly everywhere: eight cells are looked at at once."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


class Best:
    """Candidates for the best k of each source; a source's floor is what a product must reach to be one."""

    def __init__(self, own: Own, k: int, how: str, keep_self: bool, ratio: bool):
        self.own, self.k, self.how, self.keep_self, self.ratio = own, k, how, keep_self, ratio
        self.floor = np.full(len(own.ids), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n, self.limit = 0, 2 * k * len(own.ids) + 200_000

    def add(self, block: Block) -> None:
        for lo in range(0, len(self.own.ids), SOURCES):
            hi = min(lo + SOURCES, len(self.own.ids))
            units = block.product(lo, hi)
            order = units / (self.own.sizes[lo:hi, None] + block.sizes[None, :] - units) if self.ratio else units
            floor = self.floor[lo:hi]
            if self.how != "distinct" and np.isneginf(floor).all() and len(block.ids) > self.k + 1:
                best = np.partition(np.where(block.shared(lo, hi, units), order, -np.inf), -(self.k + 1), axis=1)[:, -(self.k + 1)]
                floor = np.maximum(floor, best - (NEAR if self.ratio else 0))
                self.floor[lo:hi] = floor
            if self.how == "distinct" and np.isneginf(floor).all() and len(block.ids) > 8 * (self.k + 1):
                floor = self.kth_value(np.where(block.shared(lo, hi, units), order, -np.inf))
                self.floor[lo:hi] = floor
            mask = order >= floor[:, None]
            if (floor <= 0).any():
                mask &= block.shared(lo, hi, units)
            at = _true_at(mask)
            if not self.keep_self:
                at = at[self.own.ids[lo + at // len(block.ids)] != block.ids[at % len(block.ids)]]
            if len(at):
                self.held.append((lo + at // len(block.ids), block.ids[at % len(block.ids)], order.reshape(-1)[at], units.reshape(-1)[at].astype(np.int64)))
                self.n += len(at)
            if self.n > self.limit:
                self.compact()

    def kth_value(self, order: np.ndarray) -> np.ndarray:
        """The k-th highest value of each row but its own pair's; -inf if the highest of them don't have as many values."""
        top = np.sort(np.partition(order, -8 * (self.k + 1), axis=1)[:, -8 * (self.k + 1) :], axis=1)[:, ::-1]
        values = np.cumsum(np.hstack([np.ones((len(top), 1), bool), top[:, 1:] != top[:, :-1]]), axis=1)
        return np.where(values[:, -1] > self.k, top[np.arange(len(top)), (values > self.k).argmax(axis=1)], -np.inf)

    def compact(self) -> tuple[np.ndarray, ...]:
        s, rel, order, units = (np.concatenate(x) for x in zip(*self.held, strict=True))
        by = np.lexsort((rel, -order, s))
        s, rel, order, units = s[by], rel[by], order[by], units[by]
        if self.how == "distinct":
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (order[1:] != order[:-1])
            s, rel, order, units = s[new], rel[new], order[new], units[new]
        first = np.searchsorted(s, np.arange(len(self.own.ids) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.floor[full] = np.maximum(self.floor[full], order[first[full] + self.k - 1] - (NEAR if self.ratio else 0))
        keep = order >= self.floor[s] if self.how == "rank" else np.arange(len(s)) - first[s] < self.k
        self.held = [(s[keep], rel[keep], order[keep], units[keep])]
        self.n = int(keep.sum())
        self.limit = max(self.limit, 2 * self.n)
        return self.held[0]

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            s, rel, order, units = self.compact()
            of = {"of": np.rint(units / order).astype(np.int64)} if self.ratio else {}
            yield from pa.table({"src": self.own.ids[s], "rel": rel, "units": units} | of).to_batches(100_000)


class Pairs:
    """All products of pairs that share a term, which leave with their block; columns makes what they have from (units, size of source, size of document)."""

    def __init__(self, own: Own, columns: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]):
        self.own, self.columns = own, columns

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        step = max(1, min(SOURCES, CELLS // n))
        for lo in range(0, len(self.own.ids), step):
            hi = min(lo + step, len(self.own.ids))
            units = block.product(lo, hi)
            mask = block.shared(lo, hi, units)
            at = np.flatnonzero(mask)
            if len(at):
                s = np.repeat(np.arange(hi - lo), np.count_nonzero(mask, axis=1))
                d = at - s * n
                s += lo
                made = self.columns(units.reshape(-1)[at].astype(np.int64), self.own.sizes[s], block.sizes[d])
                yield from pa.table({"src": self.own.ids[s], "rel": block.ids[d]} | made).to_batches(SENT)

    def result(self) -> Iterator[pa.RecordBatch]:
        yield from ()


class Totals:
    """Of each source, how many products aren't 0, and their sum."""

    def __init__(self, own: Own):
        self.own, self.n, self.units = own, np.zeros(len(own.ids), np.int64), np.zeros(len(own.ids), np.int64)

    def add(self, block: Block) -> None:
        for lo in range(0, len(self.own.ids), SOURCES):
            units = block.product(lo, min(lo + SOURCES, len(self.own.ids)))
            self.n[lo : lo + len(units)] += np.count_nonzero(units, axis=1)
            self.units[lo : lo + len(units)] += units.astype(np.int64).sum(axis=1)

    def result(self) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"src": self.own.ids, "n": self.n, "units": self.units}).to_batches()


def _documents(files: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """(term, document, weight, size) of whole documents, from files that have these in order."""
    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            held: list[tuple[np.ndarray, ...]] = []
            for part in parquet.ParquetFile(f).iter_batches(READ, columns=["_t", "rel", "_b", "_n"]):
                rows = tuple(part[c].to_numpy() for c in ("_t", "rel", "_b", "_n"))
                if not len(rows[0]):
                    continue
                cut = int(np.searchsorted(rows[1], rows[1][-1]))  # the last document may go on
                if cut:
                    yield tuple(np.concatenate(x) for x in zip(*held, tuple(r[:cut] for r in rows), strict=True))
                    held = []
                held.append(tuple(r[cut:] for r in rows))
            if held:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _blocks(own: Own, files: list[str]) -> Iterator[Block]:
    for term, rel, weight, size in _documents(files):
        t = np.minimum(np.searchsorted(own.terms, term), len(own.terms) - 1)
        mine = own.terms[t] == term
        t, rel, weight, size = t[mine], rel[mine], weight[mine], size[mine]
        ids, first, d = np.unique(rel, return_index=True, return_inverse=True)
        for lo in range(0, len(ids), DOCS):
            hi = min(lo + DOCS, len(ids))
            i = slice(first[lo], first[hi] if hi < len(ids) else None)
            yield Block(own, t[i], d[i] - lo, weight[i], ids[lo:hi], size[first[lo:hi]])


def _run(a: DataFrame, b: DataFrame, reduced: Callable[[Own], Best | Pairs | Totals], schema: str, laid: bool = False) -> DataFrame:
    """a has (_t, src, _a, _n), b (_t, rel, _b, _n), all of them whole numbers; only rows of b with a term of a are staged.

    laid: the rows of each rel lie in one partition of b, so that they aren't shuffled again.
    """
    spark = a.sparkSession
    whole = lambda df: df.select(*[F.col(c).cast("long").alias(c) for c in df.columns])
    a = staged(whole(a).dropna(), "sources")
    terms = a.select("_t").distinct()
    few = is_small(terms)
    rows = whole(b).dropna().join(F.broadcast(terms) if few else terms, "_t", "left_semi")
    rows = rows if laid and few else rows.repartition(parts_of(spark), "rel")
    files = sorted(_plain(f) for f in staged(rows.sortWithinPartitions("rel"), "rows").inputFiles())
    n = a.select("src").distinct().count()
    tasks = max(1, min(n // 8, max(2 * spark.sparkContext.defaultParallelism, -(-n // OF_TASK))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            own = Own(pa.Table.from_batches(held))
            out = reduced(own)
            for block in _blocks(own, files):
                yield from out.add(block) or ()
            yield from out.result()

    return a.repartition(tasks, "src").mapInArrow(run, schema)


def _plain(file: str) -> str:
    return "file://" + file.removeprefix("file:") if file.startswith("file:/") and not file.startswith("file://") else file


def best(a: DataFrame, b: DataFrame, k: int, how: str = "rank", keep_self: bool = True, laid: bool = False) -> DataFrame:
    """(src, rel, units): of each source at least its k highest sums of products of the weights of shared terms.

    a has (_t, src, _a), b (_t, rel, _b); a term may have any number of rows on either side. With `rank` rows that tie with
    the k-th are there too, with `row_number` exactly the first k by descending units and rel, with `distinct` the k highest
    values, each with its least rel. laid: the rows of each rel lie in one partition of b.
    """
    a, b = a.withColumn("_n", F.lit(0)), b.withColumn("_n", F.lit(0))
    out = _run(a, b, lambda own: Best(own, k, how, keep_self, False), "src long, rel long, units long", laid)
    return out.select(F.col("src").cast(a.schema["src"].dataType), F.col("rel").cast(b.schema["rel"].dataType), "units")


def best_ratios(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(src, rel, units, of): of each source at least the pairs with the k highest units / of, ties included.

    a has (_t, src, _a, _n), b (_t, rel, _b, _n), with weights above 0; _n is the size of a source or document, the same in
    all its rows, and `of` the sum of both less the units. Ratios that are equal when rounded to nine decimals count as ties.
    """
    out = _run(a, b, lambda own: Best(own, k, "rank", True, True), "src long, rel long, units long, of long")
    return out.select(F.col("src").cast(a.schema["src"].dataType), F.col("rel").cast(b.schema["rel"].dataType), "units", "of")


def all_pairs(a: DataFrame, b: DataFrame, columns: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(src, rel, *schema): every pair of a source and a document that share a term.

    a has (_t, src, _a, _n), b (_t, rel, _b, _n), _n as in best_ratios(), with whole weights of any sign. columns makes the
    columns of schema from the sums of the products and the sizes of both sides.
    """
    out = _run(a, b, lambda own: Pairs(own, columns), f"src long, rel long, {schema}")
    src, rel = a.schema["src"].dataType, b.schema["rel"].dataType
    return out.withColumns({"src": F.col("src").cast(src), "rel": F.col("rel").cast(rel)})


def totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, n, units): of each source the documents whose product with it isn't 0, and the sum of all its products."""
    out = _run(a.withColumn("_n", F.lit(0)), b.withColumn("_n", F.lit(0)), Totals, "src long, n long, units long")
    return out.select(F.col("src").cast(a.schema["src"].dataType), "n", "units")
