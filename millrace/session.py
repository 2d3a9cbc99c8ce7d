"""Session helpers: scratch location and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# What Spark raises for input it cannot open (the first) or finds broken while it reads (either).
FAILURES = (PySparkException, Py4JJavaError)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a folder of
    its own.  On a cluster a machine-local folder would be lost with its
    machine, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_roots.get(_app(spark))
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        root = _local_roots.setdefault(_app(spark), tempfile.mkdtemp(prefix="millrace-"))
    return root.rstrip("/")


_local_roots: dict[str, str] = {}


def _app(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", "")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that no earlier call has returned."""
    return f"{scratch_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet and return the table read back.

    Cuts lineage at a place that survives the loss of executors, keeps the
    result columnar (later readers prune columns and push filters), and makes
    values such as partition ids stable.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run meanwhile send rows to Python in Arrow batches of about ``size`` bytes.

    Spark holds a batch outside its heap, twice while it grows, and up to 64 MB of it by default.  A limit
    the session names itself stays as it is.
    """
    if spark.conf.get(BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its row bound ``rows`` allows one.

    For join sides with one short row per domain, shard run or rank.  Beyond
    the bound the planner is left to choose a shuffled join.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


SPREAD_SPLITS = 8


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rehashes an input of fewer than ``SPREAD_SPLITS`` splits and than the session has cores.

    The work on the texts of such an input would otherwise occupy a few cores only.
    A larger input is left as it is, however many cores there are, so what is shuffled stays below
    ``SPREAD_SPLITS`` times the split size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = min(cores, SPREAD_SPLITS)
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < few else df
