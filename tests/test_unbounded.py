"""Searches end by themselves, whatever the depth of the data, and paths are compared as written out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import catalog_queries as Q, lineage as G, rings, sql_mining as R


def ladder(levels: int, back: bool = False) -> list[tuple[str, str, str]]:
    """Two objects a level, each before both of the next: no chain to shorten."""
    rows = [("g", f"{a}{k}", f"{b}{k + 1}") for k in range(levels) for a in "xy" for b in "xy"]
    return rows + [("g", f"x{levels}", "y0")] * back


@pytest.mark.parametrize("levels, small", [(500, 100_000), (24, 0)])
def test_acyclic_ladder(spark, levels, small):
    for back in (False, True):
        edges = spark.createDataFrame(ladder(levels, back) + [("h", "a", None), ("i", "a", "a")], "pop_id STRING, a STRING, b STRING")
        assert sorted(r.pop_id for r in rings.cyclic_groups(edges, small=small).collect()) == ["g"] * back + ["i"]


def test_one_cycle_without_chain_is_found_at_once(spark):
    """Every object of the group has a predecessor, so nothing can be taken away."""
    rows = [("g", str(a), str(b)) for a in range(12) for b in range(12) if a != b and (a + b) % 3]
    assert rings.cyclic_groups(spark.createDataFrame(rows, "pop_id STRING, a STRING, b STRING"), small=0).count() == 1


def test_closure_of_a_chain(spark):
    pairs = spark.createDataFrame([(1, f"n{k}", f"n{k + 1}") for k in range(25)], "model_id BIGINT, entity_id STRING, object_type_id STRING")
    reached = Q.closure(pairs, pairs.filter("entity_id = 'n0'"))
    assert reached.filter("entity_id = 'n0'").count() == 25


def test_written_out_paths(spark):
    pairs = [("a/b/../../c.sql", "c.sql", True), ("../../c.sql", "c.sql", False), ("/a/../../c.sql", "/c.sql", True), ("/c.sql", "c.sql", False), (".//x/./y/..//c.sql", "x/c.sql", True),
             ("../a/../c.sql", "../c.sql", True), ("a/../../c.sql", "../c.sql", True), ("..", "", False), ("", "./", True)]
    paths = spark.createDataFrame([(k, p) for k, (p, _, _) in enumerate(pairs)], "model_id INT, path STRING")
    exports = spark.createDataFrame([(k, a) for k, (_, a, _) in enumerate(pairs)], "model_id INT, artifact STRING").withColumn("format", F.lit("ddl"))
    sources = exports.select("model_id", "artifact", F.lit("e").alias("element_id"), F.lit("t").alias("element_type"))
    found = {r.model_id for r in G.resolve_artifacts(exports, sources, paths).collect()}
    assert found == {k for k, (_, _, same) in enumerate(pairs) if same}


def test_statements_keep_odd_characters_and_need_no_shuffle(spark):
    df = spark.createDataFrame([("f", "select '\u0001';\n\nselect ';' -- ;\nfrom t;;")], "file_path STRING, sql STRING")
    rows = R.split_statements(df)
    assert [(r.statement, r.start_line, r.end_line, r.sql) for r in rows.collect()] == [(0, 1, 1, "select '\u0001'"), (1, 2, 3, "select ';' -- ;\nfrom t")]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
