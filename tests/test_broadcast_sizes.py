"""What is sent to the driver is decided by the size of the rows, not of the files that hold them."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.plans.session import materialize, materialize_by, tune

LIMIT = 1_000_000


@pytest.mark.parametrize("store", [lambda df: materialize(df, "packed"), lambda df: materialize_by(df, "packed", "model_id", 2)])
@pytest.mark.parametrize(("rows", "sent"), [(50_000, False), (200, True)])
def test_well_packed_tables_are_not_broadcast(spark, store, rows, sent):
    limits = [f"spark.sql.{a}autoBroadcastJoinThreshold" for a in ("", "adaptive.")]
    for limit in limits:
        spark.conf.set(limit, str(LIMIT))
    try:
        tune(spark)
        stored = store(spark.range(rows).select((F.col("id") / 64).cast("bigint").alias("model_id"), F.concat(F.lit("OrderHas Part-"), F.col("id") % 20).alias("name"), F.concat(F.lit("f"), "id").alias("fact_type_id")).repartition(2, "model_id"))
        large = materialize(spark.range(400_000).select(F.xxhash64("id").alias("model_id")), "large")
        assert rows < 1000 or sum(f.stat().st_size for f in map(Path, (u.removeprefix("file:") for u in stored.inputFiles()))) < LIMIT
        # as planned: sizes known only at run time are those of rows in any case
        plan = large.join(stored, "model_id")._jdf.queryExecution().sparkPlan().toString()
        assert ("BroadcastHashJoin" in plan) == sent
        assert stored.count() == rows
    finally:
        for limit in limits:
            spark.conf.unset(limit)
