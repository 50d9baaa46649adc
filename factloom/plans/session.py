"""Session settings and lineage cuts shared by the iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession

# Runtime SQL settings every job of this library relies on.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows take up to 33 times their file in memory (stored fact types at 6 times sf0.1). Sizes of tables decide what is sent to
    # the driver and all executors, so they are estimated as rows: a table goes there only if it is small, not if it is well packed.
    "spark.sql.sources.fileCompressionFactor": "50",
    # A union of scans in batches has the partitions of both, whatever it claims: rows of one key would be counted in two tasks.
    "spark.sql.unionOutputPartitioning": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (adaptive skew splitting, sizes of rows, UTC) to a session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir. Only a local session, whose tasks all see one disk, may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="factloom-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Stored rows instead of a plan: the result survives the loss of the executors that computed it. Columns are written
    compressed, in one run; a checkpoint would compute them twice and write whole rows."""
    return materialize(df, "cut")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: durable, with file statistics and pushdown."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As :func:`materialize`, in buckets by key: joins and aggregations on the key, or on more columns, need no shuffle.

    df should already be dealt by key into as many partitions, else every task writes a file for every bucket."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{spark.sparkContext.getCheckpointDir()}/{table}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table, format="parquet")
    # joins on the key and other columns may meet in the buckets
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(table)


ROWS_A_TASK = 25_000  # rows of dear work that one task gets, however many there are


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df dealt by its keys in even shares, one per core at least and more as the rows grow, so that no task grows with them.
    For narrow rows before dear work, such as the keys of texts that are then made or read."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK)), *keys)


class HopTable:
    """A table that a loop adds to, in the shared folder: reading it is one scan, however many rounds have added."""

    def __init__(self, first: DataFrame, name: str, buckets: int | None = None):
        """With a number of buckets, rows are kept in buckets by model_id, as :func:`materialize_by` does."""
        ensure_checkpoint_dir(first.sparkSession)
        self.spark, self.schema, self.buckets = first.sparkSession, first.schema, buckets
        self.table = f"{name}_{uuid.uuid4().hex}"
        self.folder = f"{self.spark.sparkContext.getCheckpointDir()}/{self.table}"
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        writer = rows.write.mode("append").option("compression", "zstd")
        if self.buckets:
            writer.option("path", self.folder).bucketBy(self.buckets, "model_id").sortBy("model_id").saveAsTable(self.table, format="parquet")
        else:
            writer.parquet(self.folder)

    def read(self) -> DataFrame:
        return self.spark.table(self.table) if self.buckets else self.spark.read.schema(self.schema).parquet(self.folder)


AT_ONCE = 8  # jobs submitted side by side


def materialize_all(builds: Iterable[Callable[[], DataFrame | None]], name: str, spark: SparkSession) -> DataFrame | None:
    """Build and store tables of one schema, several jobs at a time, and read them back as one.

    Independent plans stay small: as branches of a single one, each would be planned anew whenever a stage of another
    ends, and they could not share the cluster. A build may give None; None is returned if all do."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def store(k: int, build: Callable[[], DataFrame | None]):
        df = build()
        if df is None:
            return None
        df.write.option("compression", "zstd").parquet(f"{folder}/{k}")
        return f"{folder}/{k}", df.schema

    with ThreadPoolExecutor(AT_ONCE) as pool:
        made = [m for m in pool.map(inheritable_thread_target(spark)(store), *zip(*enumerate(builds))) if m is not None]
    return spark.read.schema(made[0][1]).parquet(*[path for path, _ in made]) if made else None
