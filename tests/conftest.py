from __future__ import annotations

import shutil
from pathlib import Path

import pytest

from lexweave.session import get_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark(4, 4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory):
    """The test tables without their rows, and with columns of clashing names besides."""
    at = tmp_path_factory.mktemp("empty")
    for p in Path(SF).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(str(at / p.name))
    return str(at)


@pytest.fixture(scope="session")
def odd_sf(spark, tmp_path_factory):
    """The test tables with all-null rows, every row twice, and extra columns whose names are used inside."""
    from pyspark.sql import functions as F

    at = tmp_path_factory.mktemp("odd")
    extra = ["term", "n", "key", "value", "block", "rank", "_key", "_n", "_v", "_t", "shard", "weight", "units", "route", "slice", "k", "lang2"]
    for p in Path(SF).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        if p.stem not in ("documents", "feed_line", "mix_target", "pack_limit", "embeddings", "vocab"):
            df = df.unionByName(df)
        nulls = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        df = df.unionByName(nulls)
        df = df.withColumns({c: F.lit("x") for c in extra if c not in df.columns})
        df.coalesce(1).write.parquet(str(at / p.name))
    yield str(at)
    shutil.rmtree(at, ignore_errors=True)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
