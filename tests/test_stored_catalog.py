"""The derived catalog is stored by model, and only the tables that are read."""

from __future__ import annotations

from factloom.operators import diff as D
from factloom.plans.session import tune
from factloom.sources.catalog import SCHEMAS
from factloom.workloads.catalog_data import catalog
from factloom.workloads.registry import Tables


def test_joins_within_models_need_no_shuffle(spark, tmp_path):
    columns = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, "
               "l_discount double, l_tax double")
    rows = [(k, n, k * n % 50, k % 7, float(k % 50 + 1), "ANR"[k % 3], "FO"[n % 2], k % 11 / 100, (k + n) % 9 / 100) for k in range(300) for n in (1, 2, 3)]
    rows.append((None, 1, 5, 5, 20.0, "A", "F", 0.01, 0.03))
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    limits = [f"spark.sql.{a}autoBroadcastJoinThreshold" for a in ("", "adaptive.")]
    for limit in limits:
        spark.conf.set(limit, "-1")
    try:
        cat = catalog(Tables(tune(spark), str(tmp_path)))
        keys = D.constraint_keys(cat)
        assert "Exchange" not in keys._jdf.queryExecution().executedPlan().toString()
        assert {name for name in vars(cat) if name in SCHEMAS} == {"roles", "constraints", "operands"}
        assert keys.count() == cat.constraints.count() > 0
        assert cat.fact_types.count() == len(rows)
    finally:
        for limit in limits:
            spark.conf.unset(limit)
