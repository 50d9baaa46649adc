"""Hand-sized cases of the rules, and brute-force comparisons on random data."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom import Constraint, FactSet, FactType, JoinOperand, ObjectType, Role, ValueRange
from factloom.operators import engine, generate, rings
from factloom.streaming.checks import stream_violations, write_violations

PLACES = FactType("places", "Customer places Order", (Role("r1", "Customer"), Role("r2", "Order")))
PARENT = FactType("parent", "Person is parent of Person", (Role("a", "Person"), Role("b", "Person")))
RATES = FactType("rates", "Customer rates Product", (Role("k1", "Customer"), Role("k2", "Product")))


def fact_set(spark, rows, ft=PLACES, sample=(), others=(), object_types=()):
    """rows: (pop, inst, value, value) tuples in order."""
    fs = FactSet([PLACES, PARENT, RATES], list(object_types))
    for kind, data in ((False, rows), (True, sample)):
        if data:
            df = spark.createDataFrame([(p, i, n, *v) for n, (p, i, *v) in enumerate(data)], "p STRING, i STRING, n BIGINT, x STRING, y STRING")
            fs = fs.bind(ft.id, df, dict(zip([r.id for r in ft.roles], "xy")), ord="n", inst_id="i", pop_id="p", sample=kind)
    for other, data in others:
        df = spark.createDataFrame([(p, i, n, *v) for n, (p, i, *v) in enumerate(data)], "p STRING, i STRING, n BIGINT, x STRING, y STRING")
        fs = fs.bind(other.id, df, dict(zip([r.id for r in other.roles], "xy")), ord="n", inst_id="i", pop_id="p")
    return fs


def found(fs, c, *details):
    df = engine.check(fs, c)
    return [] if df is None else sorted((r.pop_id, r.inst_id, tuple(r.subject), *[r.detail.get(d) for d in details]) for r in df.collect())


def test_uniqueness_is_per_population_and_names_the_first(spark):
    fs = fact_set(spark, [("p", "1", "C1", "O1"), ("p", "2", "C1", "O2"), ("q", "3", "C1", "O3"), ("p", "4", None, "O4"), ("p", "5", "", "O5")])
    c = Constraint("u", "internal_uniqueness", "places", ("r1",))
    assert found(fs, c, "first") == [("p", "2", ("C1",), "1"), ("p", "5", ("",), "4")]


def test_sample_rows_are_evidence_but_not_universe(spark):
    c = Constraint("m", "mandatory", "places", ("r1",))
    rated = [("k", "1", "C1", "P1"), ("k", "2", "C2", "P1")]
    fs = fact_set(spark, [], sample=[("s", "9", "C1", "O1")], others=[(RATES, rated)])
    assert found(fs, c) == [(None, None, ("C2",))]
    fs = fact_set(spark, rated, ft=RATES, sample=[("s", "9", "C7", "P2")])
    assert [s for _, _, s in found(fs, Constraint("m", "mandatory", "rates", ("k1",)))] == []


@pytest.mark.parametrize("value,ok", [("5", True), ("5.0", True), ("10", False), ("1e1", False), ("1d", False), ("NaN", False), (" 7 ", True), ("b", False)])
def test_numeric_or_text_range(spark, value, ok):
    fs = fact_set(spark, [("p", "1", value, "O")])
    c = Constraint("v", "value_constraint", "places", ("r1",), ranges=(ValueRange("5", "10", max_inclusive=False),))
    text_ok = "5" <= value < "10"
    assert (found(fs, c) == []) is (ok if value not in ("1d", "NaN", "b") else text_ok)


def test_comparison_local_exclusion_and_xor(spark):
    fs = fact_set(spark, [("p", "1", "10", "9"), ("p", "2", "a", "b"), ("p", "3", "x", None), ("p", "4", "z", "z")])
    assert [i for _, i, _ in found(fs, Constraint("c", "value_comparison", "places", ("r1", "r2"), operator="<"))] == ["1", "4"]
    assert [i for _, i, _ in found(fs, Constraint("e", "exclusion", "places", ("r1", "r2")))] == ["4"]
    assert [i for _, i, _ in found(fs, Constraint("x", "exclusive_or", "places", ("r1", "r2")))] == ["1", "2", "4"]


def test_frequency_bounds(spark):
    fs = fact_set(spark, [("p", str(i), v, "O") for i, v in enumerate("aaab")])
    c = Constraint("f", "frequency", "places", ("r1",), min=2, max=2)
    assert found(fs, c, "count", "bound") == [("p", None, ("a",), "3", "max"), ("p", None, ("b",), "1", "min")]


def test_no_data_no_violation(spark):
    fs = FactSet([PLACES, PARENT, RATES], [ObjectType("Person", "Person", min=3)])
    step = JoinOperand("Customer", (("r1", "r2"),), (0, 1))
    for c in (Constraint("m", "mandatory", "places", ("r1",)), Constraint("j", "join_equality", "places", operands=(step, step)), Constraint("k", "cardinality", "places", ("r1",), min=5)):
        assert found(fs, c) == []


def test_join_equality_has_rows_and_one_rollup(spark):
    fs = fact_set(spark, [("p", "1", "P1", "C1"), ("p", "2", "P2", "C2")], others=[(RATES, [("k", "1", "P1", "C1"), ("k", "2", "P2", "C3")])])
    a, b = JoinOperand("Customer", (("r1", "r2"),), (0, 1)), JoinOperand("Customer", (("k1", "k2"),), (0, 1))
    assert [s for _, _, s in found(fs, Constraint("j", "join_equality", "places", operands=(a, b)))] == [(), ("P2", "C2"), ("P2", "C3")]
    assert [s for _, _, s in found(fs, Constraint("j", "join_subset", "places", operands=(a, b)))] == [("P2", "C2")]
    assert [s for _, _, s in found(fs, Constraint("j", "join_exclusion", "places", operands=(a, b)))] == [(), ("P1", "C1")]


def random_edges(seed, nodes=9, rows=60):
    """Random pairs with a hub that takes a third of them, loops and repeats included."""
    rng = random.Random(seed)
    pick = lambda: "n0" if rng.random() < 1 / 3 else f"n{rng.randrange(nodes)}"
    return [(f"p{rng.randrange(2)}", str(i), pick(), pick()) for i in range(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_transitive_and_intransitive_against_all_pairs(spark, seed):
    rows = random_edges(seed)
    fs = fact_set(spark, rows, PARENT)
    missing, closed = Counter(), Counter()
    for pop in ("p0", "p1"):
        pairs = [(a, b) for p, _, a, b in rows if p == pop]
        have = set(pairs)
        for (a, b), (b2, c) in itertools.product(pairs, pairs):
            if b == b2:
                (closed if (a, c) in have else missing)[(pop, (a, b, c) if (a, c) in have else (a, b))] += 1
    ring = lambda kind: found(fs, Constraint("r", "ring", "parent", ("a", "b"), ring=kind), "row_pairs")
    assert {(p, s): int(n) for p, _, s, n in ring("transitive")} == dict(missing)
    assert {(p, s): int(n) for p, _, s, n in ring("intransitive")} == dict(closed)


@pytest.mark.parametrize("seed", range(2))
def test_acyclic_against_depth_first_search(spark, seed):
    rng = random.Random(seed)
    rows = [(f"g{g}", str(rng.randrange(12)), str(rng.randrange(12))) for g in range(30) for _ in range(rng.randrange(1, 14))]
    rows += [("chain", str(i), str(i + 1)) for i in range(200)] + [("loop", str(i), str((i + 1) % 50)) for i in range(50)]

    def cyclic(edges):
        nodes, left = {n for e in edges for n in e}, set(edges)
        while True:
            keep = {(a, b) for a, b in left if any(x == b for x, _ in left)}
            if keep == left:
                return bool(left)
            left = keep

    want = {g for g in {r[0] for r in rows} if cyclic([(a, b) for h, a, b in rows if h == g])}
    df = spark.createDataFrame(rows, "pop_id STRING, a STRING, b STRING")
    assert {r.pop_id for r in rings.cyclic_groups(df).collect()} == want


def test_results_do_not_depend_on_partitioning(spark):
    rows = random_edges(7, rows=200)
    wide = fact_set(spark, rows, PARENT)
    narrow = FactSet([PARENT]).bind("parent", wide.rows("parent").coalesce(1), {"a": "a", "b": "b"}, ord="ord", inst_id="inst_id", pop_id="pop_id")
    for c in (Constraint("u", "internal_uniqueness", "parent", ("a",)), Constraint("r", "ring", "parent", ("a", "b"), ring="symmetric")):
        assert found(wide, c) == found(narrow, c)


@pytest.mark.parametrize("c", [
    Constraint("u", "internal_uniqueness", "places", ("r1",)), Constraint("v", "value_constraint", "places", ("r1",), values=("a", "b")),
    Constraint("f", "frequency", "places", ("r1",), max=2), *[Constraint("r", "ring", "parent", ("a", "b"), ring=k) for k in generate.RING_PAIRS],
    Constraint("m", "mandatory", "places", ("r1",)), Constraint("d", "disjunctive_mandatory", "places", ("r1",)), Constraint("e", "exclusion", "places", ("r1", "k1")),
    Constraint("s", "subset", "places", ("r1",), ("k1",)), Constraint("q", "equality", "places", ("r1",), ("k1",)),
], ids=lambda c: f"{c.kind}-{c.ring}")
def test_generated_rows_break_their_rule(spark, c):
    seeds = spark.range(4).withColumnRenamed("id", "seed")
    fs = generate.bind_forbidden(FactSet([PLACES, PARENT, RATES]), c, seeds)
    hit = engine.check(fs, c).select(F.concat_ws(" ", "pop_id", F.array_join("subject", " ")).alias("t")).collect()
    assert {int(m) for r in hit for m in __import__("re").findall(r"(?:forbidden-|@)(\d+)", r.t)} == {0, 1, 2, 3}


def test_stream_matches_batch(spark, tmp_path):
    rows = fact_set(spark, random_edges(3), PARENT).rows("parent").drop("ord")
    rows.write.parquet(str(tmp_path / "in"))
    c = Constraint("r", "ring", "parent", ("a", "b"), ring="irreflexive")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    write_violations(stream_violations(stream, PARENT, [c]), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    got = sorted(r.inst_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(i for _, i, a, b in random_edges(3) if a == b)
    with pytest.raises(ValueError):
        stream_violations(stream, PARENT, [Constraint("u", "internal_uniqueness", "parent", ("a",))])
