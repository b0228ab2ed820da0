"""The latest version of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import BROADCAST_ROWS


def current_rows(df: DataFrame, key: str, order: str, cols: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row (key, *cols) for each non-null key: the one with the greatest `order`.

    A null `order` counts as earliest. Of rows equal in it the one with the greatest cols is taken, so the result is
    the same every time. Keys that occur once keep their rows where they are; only the rows of keys with several
    versions are shuffled. This takes the set of those keys, which is broadcast if it has at most `limit` rows and
    else left out, so that all rows are shuffled. An empty table gives an empty result.
    """
    cols = [c for c in cols if c != key]
    rows = df.filter(F.col(key).isNotNull()).select(key, order, *[c for c in cols if c != order])
    several = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)

    def latest(part: DataFrame) -> DataFrame:
        value = F.struct(*[F.col(c) for c in cols])
        rank = F.struct(F.col(order).isNotNull(), F.col(order), value)
        return part.groupBy(key).agg(F.max_by(value, rank).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in cols])

    if several.count() > limit:
        return latest(rows)
    several = F.broadcast(several)
    once = rows.join(several, key, "left_anti").select(key, *cols)
    return once.unionByName(latest(rows.join(several, key, "left_semi")))
