"""What is distinct over a union of stored tables is distinct, though both are dealt alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.session import materialize_by, tune


def test_a_key_in_two_stored_tables_is_one(spark):
    tune(spark)
    one, other = (materialize_by(spark.range(200).select((F.col("id") % 40).alias("model_id")).repartition(4, "model_id"), name, "model_id", 4) for name in ("one", "other"))
    both = one.union(other)
    assert both.distinct().count() == 40
    assert sorted(r["count"] for r in both.groupBy("model_id").count().collect()) == [10] * 40
    assert both.join(both.distinct(), "model_id", "left_anti").count() == 0
