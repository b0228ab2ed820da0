"""Latent factors of the document-term matrix, similar documents by dense vectors, and dense products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.weights import dot, normalised
from lexweave.operators.blocks import BLOCK, BROADCAST_QUERIES, in_blocks
from lexweave.operators.similarity import ranked
from lexweave.session import staged

#: Directions beyond the wanted ones, and passes over the matrix, of the factorisation.
OVERSAMPLE, ROUNDS = 10, 8
#: Most bytes of the term side of the factors, which the driver and every worker hold. Prune the vocabulary to get below.
MOST_BYTES = 2 << 30


def indexed_rows(mat: DataFrame) -> DataFrame:
    """(pmid, terms, weights) of every document; its entries are gathered once."""
    docs = mat.groupBy("pmid").agg(F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("_e"))
    return docs.select(F.col("pmid").cast("long").alias("pmid"), F.col("_e.term_id").cast("array<int>").alias("terms"), F.col("_e.weight").cast("array<double>").alias("weights"))


def _projected(batch: pa.RecordBatch, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of indexed rows: the documents of the entries, their terms and weights, and the documents times `side`."""
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    of = np.repeat(np.arange(batch.num_rows), sizes)
    terms = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    weights = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros((batch.num_rows, side.shape[1]))
    if len(terms):
        out[sizes > 0] = np.add.reduceat(side[terms] * weights[:, None], starts)
    return of, terms, weights, out


def _back(shared):
    """(term, row): what the documents of a task, times the side, give when they are led back to the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        total, used = np.zeros_like(side), np.zeros(len(side), bool)
        for batch in batches:
            of, terms, weights, y = _projected(batch, side)
            if not len(terms):
                continue
            order = np.argsort(terms, kind="stable")
            sorted_terms = terms[order]
            first = np.flatnonzero(np.append(True, sorted_terms[1:] != sorted_terms[:-1]))
            total[sorted_terms[first]] += np.add.reduceat(y[of[order]] * weights[order][:, None], first)
            used[sorted_terms[first]] = True
        at = np.flatnonzero(used)
        for i in range(0, len(at), 5000):
            part = at[i : i + 5000]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * side.shape[1], pa.int32()), pa.array(total[part].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), rows], names=["term", "row"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for term, row in zip(batch.column(0).to_pylist(), rows):
                total[term] = total[term] + row if term in total else row
    for term, row in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([term], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], names=["term", "row"])


def _times(shared, key: str, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        for batch in batches:
            y = _projected(batch, side)[3]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * side.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=[key, what])

    return run


def factors(mat: DataFrame, k: int, rounds: int = ROUNDS, seed: int = 7) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, vec) of U times the k largest singular values, these, and the term vectors V (terms x k).

    Subspace iteration: a random block of k + OVERSAMPLE directions is led through the documents and back `rounds` times,
    one distributed pass each, and made orthogonal between; what is held outside the documents is terms x (k + OVERSAMPLE)
    numbers, at most MOST_BYTES, whatever the number of documents. Signs are such that the largest entry of each term
    vector is positive. There are fewer factors if the matrix has fewer.
    """
    spark = mat.sparkSession
    width = int(mat.agg((F.max("term_id") + 1).alias("w")).first()[0] or 1)
    n = min(k + OVERSAMPLE, width)
    if width * n * 8 > MOST_BYTES:
        raise ValueError(f"{width} terms x {n} factors are too many to hold; prune the vocabulary or ask for fewer")
    docs = staged(indexed_rows(mat), "indexed")
    share = lambda x: spark.sparkContext.broadcast(x)
    side = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, n)))[0]
    for _ in range(rounds):
        partial = docs.mapInArrow(_back(share(side)), "term int, row array<double>")
        led = partial.repartition("term").mapInArrow(_summed, "term int, row array<double>").toPandas()
        back = np.zeros((width, n))
        if len(led):
            back[led["term"].to_numpy()] = np.stack(led["row"].to_numpy())
        side = np.linalg.qr(back)[0]
    gram = dense_gram(docs.mapInArrow(_times(share(side), "id", "vec"), "id long, vec array<double>"), n)
    values, turn = np.linalg.eigh(gram)
    order = np.argsort(-values)[:k]
    s, v = np.sqrt(np.maximum(values[order], 0)), side @ turn[:, order]
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    us = docs.mapInArrow(_times(share(v), "doc_id", "vec"), "doc_id long, vec array<double>")
    return us, s, v


def _outer(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            column = batch.column(0).drop_null()
            if len(column):
                rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)
                total += rows.T @ rows
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    return run


def gram_entries(vectors: DataFrame, d: int, vec: str = "vec") -> DataFrame:
    """(i, j, v): the product of the transposed and the plain matrix of vectors of length d, summed where they are. Nulls are left out."""
    return vectors.select(vec).mapInArrow(_outer(d), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def dense_gram(vectors: DataFrame, d: int, vec: str = "vec") -> np.ndarray:
    """gram_entries as an array; its size is d x d, whatever the number of vectors."""
    out = np.zeros((d, d))
    got = gram_entries(vectors, d, vec).toPandas()
    out[got["i"], got["j"]] = got["v"]
    return out


def _best_of_batch(shared, k: int, slack: float):
    """(src, rel, score): of each query the k best rows of a batch, and those that tie with them but for `slack`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rel = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rel), -1)
            for at in range(0, len(ids), BLOCK):
                score = rows @ queries[at : at + BLOCK].T
                known = ~np.isnan(score)
                score[~known] = -np.inf
                if len(rel) > k:
                    known &= score >= np.partition(score, len(rel) - k, axis=0)[len(rel) - k] - slack
                r, c = np.nonzero(known)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + BLOCK][c]), pa.array(rel[r]), pa.array(score[r, c])], names=["src", "rel", "score"])

    return run


def similar_vectors(vectors: DataFrame, sources: DataFrame, k: int, cosine: bool = True, decimals: int = 6, limit: int = BROADCAST_QUERIES) -> DataFrame:
    """(src, rel, score, rank): the k most similar vectors of each of a stated set of sources.

    Both tables have (id, vec), vectors of one length. Up to `limit` sources are sent to the workers and held against every
    vector by products of blocks, of which only the best of each batch leave the task; more sources are held in blocks against
    every vector in the JVM. Scores are rounded before they are ranked; ties go to the smaller id. Null vectors are left
    out, and zero vectors have no cosine.
    """
    shape = (lambda c: normalised(F.col(c))) if cosine else (lambda c: F.col(c))
    a = sources.filter("vec is not null").select(F.col("id").alias("src"), shape("vec").alias("v"))
    b = vectors.filter("vec is not null").select(F.col("id").alias("rel"), shape("vec").alias("_v"))
    if a.count() <= limit:
        own = a.toPandas()
        queries = np.stack(own["v"].to_numpy()).astype(np.float64) if len(own) else np.zeros((0, 0))
        shared = vectors.sparkSession.sparkContext.broadcast((own["src"].to_numpy(), queries))
        kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((a, "src"), (b, "rel"))}
        scored = b.mapInArrow(_best_of_batch(shared, k, 2 * 10.0**-decimals), f"src {kinds['src']}, rel {kinds['rel']}, score double")
        scored = scored.withColumn("score", F.round("score", decimals))
    else:
        pairs = in_blocks(a, b).select("rel", "_v", F.explode("block").alias("s"))
        scored = pairs.select("s.src", "rel", F.round(dot(F.col("s.v"), F.col("_v")), decimals).alias("score")).filter("not isnan(score)")
    return ranked(scored, "src", "score", k, "row_number", "rel")


def top_of_concepts(v: np.ndarray, spark: SparkSession, k: int) -> DataFrame:
    """(concept, term_id, weight, rank): the terms of most weight in each latent concept."""
    rows = [(i, row) for i, row in enumerate(v.tolist())]
    terms = spark.createDataFrame(rows, "term_id int, vec array<double>").select("term_id", F.posexplode("vec").alias("concept", "weight"))
    return ranked(terms.withColumn("size", F.abs("weight")), "concept", "size", k, "row_number", "term_id").drop("size")


def top_documents(us: DataFrame, k: int) -> DataFrame:
    """(concept, doc_id, weight, rank): the documents of most weight in each latent concept."""
    docs = us.select("doc_id", F.posexplode("vec").alias("concept", "weight"))
    return ranked(docs.withColumn("size", F.abs("weight")), "concept", "size", k, "row_number", "doc_id").drop("size")


def times_block(vectors: DataFrame, block: np.ndarray, vec: str = "vec") -> DataFrame:
    """vectors with `vec` times a local block of columns, one Arrow pass; null vectors stay null."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(block, np.float64))
    others = [c for c in vectors.columns if c != vec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if r is None else (np.asarray(r, np.float64) @ shared.value).tolist() for r in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*others, vec])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*others).schema.fields)
    return vectors.select(*others, vec).mapInArrow(run, f"{kinds}, `{vec}` array<double>")


def dense_product(a: DataFrame, b: DataFrame, tile: int = 256) -> DataFrame:
    """(i, j, v): the product of two matrices given as (i, j, v), by square tiles that are zero beyond the edges.

    Tiles meet on their inner place and are multiplied in Arrow batches; their entries are summed by the map side first. Missing
    entries count as 0, and those of the product that are 0 are left out.
    """

    def tiled(m: DataFrame, inner: str, outer: str, name: str) -> DataFrame:
        place = lambda c: F.floor(F.col(c) / tile).cast("long")
        cell = F.struct((F.col("i") % tile).cast("int").alias("i"), (F.col("j") % tile).cast("int").alias("j"), F.col("v").cast("double").alias("v"))
        return m.filter("v is not null").groupBy(place(inner).alias("_k"), place(outer).alias(f"_{name}")).agg(F.collect_list(cell).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dense(cells: pa.Scalar) -> np.ndarray:
            out, c = np.zeros((tile, tile)), cells.values
            out[c.field("i").to_numpy(), c.field("j").to_numpy()] = c.field("v").to_numpy()
            return out

        for batch in batches:
            for ti, tj, x, y in zip(*batch.columns):
                product = dense(x) @ dense(y)
                i, j = np.nonzero(product)
                yield pa.RecordBatch.from_arrays([pa.array(i + ti.as_py() * tile), pa.array(j + tj.as_py() * tile), pa.array(product[i, j])], names=["i", "j", "v"])

    pairs = tiled(a, "j", "i", "x").join(tiled(b, "i", "j", "y"), "_k").select("_x", "_y", "x", "y")
    return pairs.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
