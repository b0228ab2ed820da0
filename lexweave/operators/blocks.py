"""A stated set of queries held against all rows, in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import parts_of

#: Queries in a block, and the most queries whose blocks are broadcast.
BLOCK, BROADCAST_QUERIES = 256, 20_000


def in_blocks(queries: DataFrame, rows: DataFrame, block: int = BLOCK, limit: int = BROADCAST_QUERIES, parts: int | None = None) -> DataFrame:
    """rows with a column `block` of up to about `block` queries (structs of their columns), once for each block.

    Blocks of up to `limit` queries are broadcast. More are copied to `parts` parts of the rows, as many as a shuffle has
    unless given, so that every row meets every block in the part that it is in.
    """
    parts = parts or parts_of(rows.sparkSession)
    n = queries.count()
    packed = queries.select(F.struct(*queries.columns).alias("_q")).groupBy(F.pmod(F.xxhash64("_q"), F.lit(max(1, -(-n // block)))).alias("_g"))
    blocks = packed.agg(F.collect_list("_q").alias("block")).drop("_g")
    if n <= limit:
        return rows.withColumn("_p", F.lit(0)).join(F.broadcast(blocks.withColumn("_p", F.lit(0))), "_p").drop("_p")
    copies = blocks.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns[:1]]), F.lit(parts)).cast("int")
    return rows.withColumn("_p", part).join(copies, "_p").drop("_p")
