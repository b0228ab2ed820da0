"""Session, shared staging folder and size-checked broadcast."""

from __future__ import annotations

import atexit
import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of a side that may be broadcast. Beyond them the callers take a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 256 << 20

_staged: list[tuple[SparkSession, str]] = []


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where that is unset, a temporary one if the session is a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext.getCheckpointDir()
        if not own:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors reach; a folder of one machine won't do on a cluster")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexweave-"))
            own = spark.sparkContext.getCheckpointDir()
        at = own
    return at.rstrip("/")


def drop_staged() -> None:
    """Removes what was staged so far. Results that read it must have been written or fetched before."""
    held, _staged[:] = list(_staged), []
    for spark, path in held:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            pass


atexit.register(drop_staged)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by drop_staged() or when the driver ends."""
    path = f"{shared_dir(spark)}/lexweave/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that later steps neither repeat it nor depend on one executor."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(df: DataFrame):
    """The bytes of a row's values: texts by their length, arrays by their elements, 8 for the rest."""
    kinds = {"StringType": lambda c: F.octet_length(c), "ArrayType": lambda c: F.size(c) * 16, "MapType": lambda c: F.size(c) * 32, "StructType": lambda c: F.lit(64)}
    each = [F.coalesce(kinds.get(type(f.dataType).__name__, lambda c: F.lit(8))(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields]
    return sum(each[1:], each[0]) + F.lit(16)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most limit rows and most_bytes bytes; both are counted, not estimated."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(_width(df).cast("long"))).first()
    return n <= limit and (size or 0) <= most_bytes


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, limit) else df


def parts_of(spark: SparkSession) -> int:
    """The parts that tables are cut into: those of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """df hashed by cols into spark.sql.shuffle.partitions parts that aren't merged at run time.

    It is for tables that a join with a broadcast side multiplies: merged by their own small size, a few tasks would do all
    of that join, and groupings that have cols among their keys need no shuffle of what the join gives.
    """
    return df.repartition(parts_of(df.sparkSession), *cols)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once for each application, so that they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_bytes())
    at = Path(tempfile.mkdtemp(prefix="lexweave-")) / f"lexweave-{hashlib.md5(data.getvalue()).hexdigest()[:12]}.zip"
    at.write_bytes(data.getvalue())
    context.addPyFile(str(at))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
