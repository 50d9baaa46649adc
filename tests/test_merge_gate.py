"""The gate after a merge against the SQL of its rules, run on the merged models."""

from __future__ import annotations

from dataclasses import fields

import duckdb

from factloom.workloads import evolution
from factloom.workloads.catalog import LINT
from factloom.workloads.registry import QUERIES, Tables

FOLDER = "/root/testdata/sf0.001"
RULES = ("l01_dangling_roles", "l02_duplicate_names", "l04_subtype_references", "l05_subtype_cycle", "l06_objectification")


def test_gate(spark, tmp_path):
    merged, con = evolution.merged(Tables(spark, FOLDER)), duckdb.connect()
    for field in fields(merged):
        getattr(merged, field.name).write.parquet(str(tmp_path / field.name))
        con.sql(f"CREATE VIEW {field.name} AS SELECT * FROM '{tmp_path}/{field.name}/*.parquet'")
    want: dict = {}
    for name in RULES:
        select, ctes = LINT[name]
        text = f"WITH RECURSIVE {', '.join(ctes)} {select}" if ctes else select
        for model, rule, n in con.sql(f"SELECT model_id, rule_id, count(*) FROM ({text}) WHERE severity = 'error' GROUP BY ALL").fetchall():
            want[model, rule] = want.get((model, rule), 0) + n
    got = {(r.model_id, r.rule_id): r.n for r in QUERIES["d07_merge_gate"](spark, FOLDER).collect()}
    assert got == want and want
