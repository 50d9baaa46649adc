"""Constraints are cleaned within their models: no shuffle of the stored catalog, every row judged once."""

from __future__ import annotations

from factloom.operators import cleansing as K
from factloom.plans.session import tune
from factloom.sources.catalog import SCHEMAS, Catalog
from factloom.workloads.registry import Tables
from factloom.workloads.upkeep import doubled


def test_cleaning_stored_constraints_needs_no_shuffle(spark, tmp_path):
    lines = [(k, n, k * n % 50, k % 7, float(k % 50 + 1), "ANR"[k % 3], "FO"[n % 2], k % 11 / 100, (k + n) % 9 / 100) for k in range(200) for n in (1, 2, 3)]
    spark.createDataFrame([*lines, (None, 1, 5, 5, 20.0, "A", "F", 0.01, 0.03)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_returnflag string, l_linestatus string, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "FOP"[k % 3], f"{k % 5 + 1}-LOW") for k in range(200)], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"part {k}", "SMALL", "b", k % 20) for k in range(50)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, f"supplier {k}") for k in range(7)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    limits = [f"spark.sql.{a}autoBroadcastJoinThreshold" for a in ("", "adaptive.")]
    for limit in limits:
        spark.conf.set(limit, "-1")
    try:
        kept = K.clean_constraints(doubled(Tables(tune(spark), str(tmp_path)))).kept
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() > 0
    finally:
        for limit in limits:
            spark.conf.unset(limit)


def test_repeats_nulls_and_misplaced_preferences(spark):
    def constraint(model, fact, ord_, roles, preferred=False):
        return model, fact, ord_, f"{fact}-{ord_}", "internal_uniqueness", "alethic", roles, None, None, None, None, None, None, preferred

    constraints = [
        constraint(1, "f", 0, ["r", "q"], True), constraint(1, "f", 1, ["q", "r"]), constraint(1, "f", 1, ["q"]),  # the repeat takes what shares its place with it
        constraint(1, "f", None, ["q"]), constraint(1, "f", 3, ["q"]),  # a null comes first
        constraint(1, "f", 4, ["x"]), constraint(1, "g", 0, ["s"], True), constraint(None, "f", 0, ["r"]),
    ]
    roles = [(1, "f", "r", 0, "r", "e"), (1, "f", "q", 1, "q", "v"), (1, "g", "s", 0, "s", "e")]
    types = [(1, "e", "e", "entity", "id", None, None, None, None, None, None, None, 1), (1, "v", "v", "value", *[None] * 8, 2)]
    rows = {"constraints": constraints, "roles": roles, "object_types": types, "fact_types": [(1, "f", "f", None, None, None, 1)]}
    clean = K.clean_constraints(Catalog(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}))
    kept = sorted(map(str, (tuple(r) for r in clean.kept.select("fact_type_id", "ord", "is_preferred").collect())))
    assert kept == ["('f', 0, False)", "('f', 0, True)", "('f', None, False)", "('g', 0, False)"]  # a constraint without a model has no roles to judge it by
    found = sorted(tuple(r) for r in clean.corrections.select("category", "element").collect())
    assert found == [("duplicate_constraint", "f")] * 3 + [("invalid_role_player", "f")] + [("misplaced_is_preferred", "g")]
