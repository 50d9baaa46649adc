"""Order-dependent operators that never sort one key's whole history in one task.

A plain window partitioned by a hot key puts all its rows in a single task. Here
the order axis is cut into buckets; rows are windowed per (key, bucket), and the
much smaller bucket summaries (one row per key and bucket) carry state across
bucket borders. Borders follow the data: rows are dealt by sampled quantiles of (keys, order), so a bucket holds about
as many rows as any other, whatever key or moment most rows have, and a key has no more buckets than there are
partitions. A bucket column of the caller's own, where it is given, must be monotone in the order columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.plans.session import materialize


def bucketed(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """df with its bucket in ``_b``. Sampled borders differ from run to run, so rows dealt by them are stored once, and
    every later step reads the same buckets."""
    if bucket is not None:
        return df.withColumn("_b", bucket)
    return materialize(df.repartitionByRange(*keys, *order).withColumn("_b", F.spark_partition_id()), "buckets")


def next_value(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, value: str, alias: str) -> DataFrame:
    """``lead(value)`` over (keys, order): the last row of a bucket takes the next bucket's first value."""
    return _neighbour(df, keys, order, bucket, value, alias, forward=True)


def previous_value(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, value: str, alias: str) -> DataFrame:
    """``lag(value)`` over (keys, order)."""
    return _neighbour(df, keys, order, bucket, value, alias, forward=False)


def _neighbour(df, keys, order, bucket, value, alias, forward):
    rows = dealt = bucketed(df, keys, order, bucket)
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    step = F.lead if forward else F.lag
    # The edge row of a bucket is recognised by position, so NULL values stay correct.
    rows = rows.withColumn("_v", step(value).over(within)).withColumn("_edge", step(F.lit(1)).over(within).isNull())
    pick = F.min_by if forward else F.max_by
    borders = dealt.groupBy(*keys, "_b").agg(pick(F.struct(value), F.struct(*order)).alias("_f"))
    across = Window.partitionBy(*keys).orderBy("_b")
    borders = borders.select(*keys, "_b", step("_f").over(across).alias("_n"))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]])
    joined = rows.alias("l").join(borders.alias("r"), on, "left")
    filled = F.when(F.col("_edge"), F.col(f"_n.{value}")).otherwise(F.col("_v"))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], filled.alias(alias))


def number_rows(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, alias: str) -> DataFrame:
    """``row_number()`` over (keys, order): position in the bucket plus the rows of earlier buckets."""
    dealt = bucketed(df, keys, order, bucket)
    rows = dealt.withColumn(
        "_p", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)).cast("bigint"))
    sizes = dealt.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]])
    return rows.alias("l").join(offsets.alias("r"), on).select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("_p") + F.col("_o")).alias(alias))


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key. Every task cuts its own rows to n per key before they are shuffled."""
    within = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_p", F.row_number().over(within)).filter(F.col("_p") <= n).drop("_p")


def extreme_rows(df: DataFrame, keys: list[str], order: Column, latest: bool = True) -> DataFrame:
    """One whole row per key: the latest (or earliest) by order, as a combinable aggregate."""
    pick = F.max_by if latest else F.min_by
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(pick(row, order).alias("_r")).select(*keys, "_r.*")
