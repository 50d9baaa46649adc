"""Work is dealt in even shares: many small groups, texts made from narrow keys, and files of repositories."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.operators import rings, sql_mining
from factloom.plans.session import ROWS_A_TASK, ensure_checkpoint_dir, spread, tune
from factloom.workloads import mining
from factloom.workloads.registry import Tables


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_small_groups_share_batches(spark, batch):
    big = 2**60
    rows = [(None, "a", "b"), (None, "b", "a"), (big, "a", "b"), (big, "b", "c"), (big + 1, "a", "b"), (big + 1, "b", "c"), (big + 1, "c", "a"), (big + 2, "x", "x"), (big + 3, "a", None)]
    rows += [(k, "a", "b") for k in range(200)] + [(k, "b", "a") for k in range(0, 200, 7)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        found = rings.cyclic_groups(spark.createDataFrame(rows, "g LONG, a STRING, b STRING"), "g")
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.g for r in found.collect()} == {None, big + 1, big + 2, *range(0, 200, 7)}
        assert found.count() == 3 + len(range(0, 200, 7))
    finally:
        spark.conf.set(name, before)


def test_tasks_do_not_grow_with_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = 2 * cores * ROWS_A_TASK
    dealt = spread(spark.range(rows, numPartitions=cores), "id")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 2 * cores and sum(sizes) == rows and max(sizes) < 1.1 * ROWS_A_TASK
    assert spread(spark.range(5), "id").rdd.getNumPartitions() == cores


def test_a_repository_is_written_by_one_task(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("p_partkey"), F.lit(5).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    ensure_checkpoint_dir(spark)
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(root.glob("code-*"))
    found = mining.s10(Tables(tune(spark), str(tmp_path)))
    (written,) = set(root.glob("code-*")) - before
    assert sorted(p.parent.name for p in written.rglob("*.txt")) == [f"repo_id=r{k}" for k in range(4)]
    assert {tuple(r) for r in found.collect()} == {(f"r{k}", 25) for k in range(3)}


def test_trimming_is_that_of_the_pattern(spark):
    texts = ["", " ", " \t\n\x0b\f\r", "\xa0a\xa0", "  a b\n\n", "a", "\x1ca\x1c", "\u3000x\u2028", "\r\na;\x85\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    rows = df.select(sql_mining._trimmed(F.col("t")).alias("x"), F.regexp_replace("t", r"^\s+|\s+\z", "").alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows]
