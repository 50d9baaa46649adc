"""Key checks in one pass, cycles, substring and overlap joins against plain re-implementations."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import catalog_lint as L, diff as D, engine, keys, rings
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint, FactType, Role
from factloom.workloads import checks


def test_key_checks_share_a_pass(spark):
    rng = random.Random(4)
    rows = [(i, f"p{rng.randrange(2)}", rng.choice([None, "", "x", "y"]), rng.choice([None, 1, 2, 3]), rng.randrange(3)) for i in range(300)]
    ft = FactType("f", "f", (Role("a", "A"), Role("b", "B"), Role("c", "C")))
    facts = FactSet([ft]).bind("f", spark.createDataFrame(rows, "i LONG, p STRING, a STRING, b INT, c INT"), {"a": "a", "b": "b", "c": "c"}, ord="i", inst_id="i", pop_id="p")
    declared = [
        Constraint("u1", "internal_uniqueness", "f", ("a", "b")), Constraint("u2", "internal_uniqueness", "f", ("c",)), Constraint("u3", "internal_uniqueness", "f", ("b", "a"), modality="deontic"),
        Constraint("n1", "frequency", "f", ("a", "b"), min=12, max=20), Constraint("n2", "frequency", "f", ("c",), min=60, max=10), Constraint("n3", "frequency", "f", ("a", "b"), min=3)]
    together = [sorted(map(str, df.collect())) for df in keys.check_keys(facts, declared)]
    alone = [sorted(map(str, engine.check(facts, c).collect())) for c in declared]
    assert together == alone and all(alone[:5])
    # and plainly: the first row of a key is none, every later one is a violation that names it
    first, want = {}, []
    for i, p, a, b, _ in rows:
        key = (p, a or "", b)
        want += [(str(i), first[key])] if key in first else []
        first.setdefault(key, str(i))
    assert sorted((r.inst_id, r.detail["first"]) for r in keys.check_keys(facts, declared)[0].collect()) == sorted(want)


def test_no_aggregate_of_keys_sorts(spark):
    rows = spark.range(10).select(F.lit("p").alias("pop_id"), F.col("id").cast("string").alias("inst_id"), F.col("id").alias("ord"), F.col("id").alias("k"))
    plan = keys.repeated_keys(rows, [F.col("k")])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def _cycles(edges) -> bool:
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    gone = True
    while gone:
        gone = [a for a in after if not any(b in after for b in after[a])]
        for a in gone:
            del after[a]
    return bool(after)


@pytest.mark.parametrize("edges", [
    [(1, 0), (1, 2), (2, 1), (0, 5)],  # the walk by smallest successors ends at 5 and never sees 1 -> 2 -> 1
    [(1, 0), (0, 5), (1, 2), (2, 3)], [(4, 4)], [(k, k + 1) for k in range(200)], [(k, k + 1) for k in range(200)] + [(200, 150)]])
def test_cycle_sql_sees_every_cycle(spark, edges):
    con = duckdb.connect()
    # the SQL derives b as 7 * o_orderkey % 1600, and 7 * 1143 % 1600 = 1
    rows = [(b * 1143 % 1600 + 1600 * i, a, "O", "p") for i, (a, b) in enumerate(edges)]
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_orderpriority VARCHAR)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?, ?)", rows)
    found = [r[2] for r in con.sql(checks._CIRCLE).fetchall()]
    spark_found = rings.cyclic_groups(spark.createDataFrame([("p", a, b) for a, b in edges], "pop_id STRING, a LONG, b LONG"))
    assert found == ([("p")] if _cycles(edges) else []) == [r.pop_id for r in spark_found.collect()]


def test_both_ways_to_find_cycles_agree(spark):
    """Small groups searched in a task and large ones by rounds: the same graphs at the border."""
    rng = random.Random(8)
    rows, want = [], set()
    for g in range(40):
        n = rng.randrange(2, 14)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))}
        edges = {(a, b) for a, b in edges if rng.random() < 0.1 or a < b} or {(0, 1)}
        rows += [(f"g{g}", a, b) for a, b in edges]
        want |= {f"g{g}"} if _cycles(edges) else set()
    df = spark.createDataFrame(rows, "pop_id STRING, a LONG, b LONG")
    for small in (0, 8, 100_000):
        assert {r.pop_id for r in rings.cyclic_groups(df, small=small).collect()} == want


def test_containing_equals_plain_search(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab/é") for _ in range(n))
    paths = [(p, text(rng.randrange(0, 12))) for p in (1, 2) for _ in range(40)] + [(3, "")]
    deps = [(p, text(rng.randrange(0, 8))) for p in (1, 2, 3, 4) for _ in range(80)] + [(p, "") for p in (1, 2, 3, 4)]
    got = L.containing(spark.createDataFrame(paths, "project_id LONG, mapping STRING").distinct(), spark.createDataFrame(deps, "project_id LONG, dep STRING").distinct())
    assert sorted(map(tuple, got.collect())) == sorted({(p, d) for p, d in deps if any(p == q and d in m for q, m in paths)})


def test_containing_on_a_large_project(spark):
    """100,000 paths and 100,000 dependencies of one project, all with common beginnings and ends."""
    paths = spark.range(100_000).select(F.lit(1).alias("project_id"), F.concat(F.lit("map/"), F.col("id"), F.lit(".yaml")).alias("mapping"))
    deps = spark.range(100_000).select(F.lit(1).alias("project_id"), F.concat(F.lit("p/"), F.col("id") * 2, F.lit(".yaml")).alias("dep"))
    found = L.containing(paths, deps)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert found.count() == 50_000


def test_value_lists_sharing_half(spark):
    rng = random.Random(6)
    rows = []
    for k in range(160):
        values = [rng.choice("abcdefghijklm") for _ in range(rng.randrange(1, 8))]
        rows.append((k % 2, "value", rng.choice(["removed", "added"]), f"n{k}", values if rng.random() < 0.4 else sorted({*values, "all"})))
    o = spark.createDataFrame(rows, "model_id INT, kind STRING, side STRING, name STRING, allowed ARRAY<STRING>")
    got = set()
    members = D._value_members(o).collect()
    for r in members:
        got |= {(r.model_id, r.name, d.name) for d in members if r.side == "removed" and d.side == "added" and (r.model_id, r.key) == (d.model_id, d.key)}
    want = {(m, r, d) for m, _, s, r, x in rows for n, _, u, d, y in rows
            if s == "removed" and u == "added" and m == n and sum(v in y for v in x) / min(len(x), len(y)) >= 0.5}
    assert got == want and want


def test_a_value_of_all_lists_makes_no_pairs(spark):
    rows = [(1, "value", "removed" if k % 2 else "added", f"n{k}", ["all", f"x{k}", f"y{k}", f"z{k}"]) for k in range(4000)]
    o = spark.createDataFrame(rows, "model_id INT, kind STRING, side STRING, name STRING, allowed ARRAY<STRING>")
    assert D._value_members(o).collect() == []


def test_corresponding_positions(spark):
    rng = random.Random(9)
    f = [(1, f"n{k}", rng.choice(["removed", "added"]), [f"p{rng.randrange(5)}" for _ in range(rng.randrange(1, 4))]) for k in range(120)]
    tokens = [(1, s, f"p{k}", f"t{t}") for s in ("removed", "added") for k in range(5) for t in rng.sample(range(6), 2)]
    got = set()
    members = D.corresponding(spark.createDataFrame(f, "model_id INT, name STRING, side STRING, players ARRAY<STRING>"),
                              spark.createDataFrame(tokens, "model_id INT, side STRING, player STRING, token STRING")).collect()
    for r in members:
        got |= {(r.name, d.name) for d in members if r.side == "removed" and d.side == "added" and r.key == d.key}
    stands = lambda side, p: {f"name:{p}"} | {t for _, s, q, t in tokens if (s, q) == (side, p)}
    want = {(r, d) for _, r, s, x in f for _, d, u, y in f if (s, u) == ("removed", "added") and len(x) == len(y)
            and all(stands("removed", p) & stands("added", q) for p, q in zip(x, y))}
    assert got == want and want


def test_many_candidate_keys_stay_linear(spark):
    """A player with 1,000 candidate keys at four positions has 4,000 tokens, not 10^12 combinations."""
    f = [(1, "old", "removed", ["hub"] * 4), (1, "new", "added", ["hub2"] * 4), (1, "other", "added", ["hub2", "hub2", "lone", "hub2"])]
    tokens = [(1, s, p, f"t{k}") for k in range(1000) for s, p in (("removed", "hub"), ("added", "hub2"))]
    found = D.corresponding(spark.createDataFrame(f, "model_id INT, name STRING, side STRING, players ARRAY<STRING>"),
                            spark.createDataFrame(tokens, "model_id INT, side STRING, player STRING, token STRING")).collect()
    assert sorted((r.side, r.name) for r in found) == [("added", "new"), ("removed", "old")]
