"""Checks that compare sets of role values or tuples, within a row population or across fact types.

The spanning checks tag each side with a flag and aggregate once on the tuple:
one shuffle, combined on the map side, so hot values cost one row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.predicates import group_key
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint
from factloom.plans.violations import record, union


def _flagged(sides: list[DataFrame | None], keys: list[str]) -> DataFrame:
    """One row per distinct tuple with ``s0, s1, ...``: is it present on that side?"""
    tagged = [
        side.select(*keys, *[F.lit(j == i).alias(f"s{j}") for j in range(len(sides))])
        for i, side in enumerate(sides)
        if side is not None
    ]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    return both.groupBy(*keys).agg(*[F.max(f"s{j}").alias(f"s{j}") for j in range(len(sides))])


def _spanning(df: DataFrame, c: Constraint, rule: str, subject: list[str], message: Column | str, detail=None) -> DataFrame:
    return df.select(*record(
        rule, c.severity, c.id or c.fact_type, constraint=c.id, fact_type=c.fact_type,
        subject=[F.col(s) for s in subject], detail=detail, message=message,
    ))


def check_mandatory(facts: FactSet, c: Constraint) -> DataFrame | None:
    """Objects known from other roles that never play the mandatory role (or any of several)."""
    player = _player(facts, c.roles)
    if player is None:
        return None
    # Values from the mandatory roles themselves satisfy the check, so only the other roles are read as universe.
    required = facts.universe(player, skip_roles=c.roles)
    if required is None:
        return None
    played = [facts.role_values(r) for r in c.roles if _known(facts, r)]
    played = [p for p in played if p is not None]
    side = reduce(lambda a, b: a.union(b), played) if played else None
    lacking = _flagged([required, side], ["value"]).filter(F.col("s0") & ~F.col("s1"))
    kind = "mandatory" if c.kind == "mandatory" else "disjunctive-mandatory"
    return _spanning(lacking, c, f"population/{kind}-violation", ["value"], "known object does not play the required role")


check_disjunctive_mandatory = check_mandatory


def _known(facts: FactSet, role_id: str) -> bool:
    return any(ft.has(role_id) for ft in facts.fact_types.values())


def _player(facts: FactSet, roles: tuple[str, ...]) -> str | None:
    return next((facts.role(r)[1].player for r in roles if _known(facts, r)), None)


def _role_counts(facts: FactSet, roles: tuple[str, ...], universe: DataFrame | None = None) -> DataFrame | None:
    sides = [facts.role_values(r) if _known(facts, r) else None for r in roles]
    if universe is not None:
        sides.append(universe)
    if all(s is None for s in sides):
        return None
    count = sum((F.col(f"s{i}").cast("int") for i in range(len(roles))), F.lit(0))
    return _flagged(sides, ["value"]).withColumn("n", count)


def check_exclusion(facts: FactSet, c: Constraint) -> DataFrame | None:
    counts = _role_counts(facts, c.roles)
    if counts is None:
        return None
    return _spanning(
        counts.filter(F.col("n") > 1), c, "population/exclusion-violation", ["value"],
        F.concat(F.lit("plays excluded roles: "), F.col("n").cast("string")), {"roles": F.col("n")})


def check_exclusive_or(facts: FactSet, c: Constraint) -> DataFrame | None:
    player = _player(facts, c.roles)
    universe = None if player is None else facts.universe(player)
    if universe is None:
        return None
    counts = _role_counts(facts, c.roles, universe)
    known = F.col(f"s{len(c.roles)}")
    return _spanning(
        counts.filter(known & (F.col("n") != 1)), c, "population/exclusive-or-violation", ["value"],
        F.concat(F.lit("must play exactly one role; plays "), F.col("n").cast("string")), {"roles": F.col("n")})


def _sides(facts: FactSet, c: Constraint) -> tuple[list[str], DataFrame]:
    keys = [f"t{i}" for i in range(len(c.roles))]
    sides = [
        facts.tuples(r, keys) if facts.has_rows(facts.role(r[0])[0].id) else None
        for r in (c.roles, c.roles2)
    ]
    return keys, _flagged(sides, keys)


def check_subset(facts: FactSet, c: Constraint) -> DataFrame:
    keys, flags = _sides(facts, c)
    return _spanning(flags.filter(F.col("s0") & ~F.col("s1")), c, "population/subset-violation", keys, "tuple missing from the superset roles")


def check_equality(facts: FactSet, c: Constraint) -> DataFrame:
    keys, flags = _sides(facts, c)
    missing = F.when(F.col("s0"), F.lit("second")).otherwise(F.lit("first"))
    return _spanning(
        flags.filter(F.col("s0") != F.col("s1")), c, "population/equality-violation", keys,
        F.concat(F.lit("tuple missing from the side: "), missing), {"missing": missing})


def _local_missing(facts: FactSet, c: Constraint, rule: str, need: tuple[str, ...], have: tuple[str, ...]) -> DataFrame:
    """Rows whose ``need`` tuple matches no ``have`` tuple of the same population; missing parts count as empty text."""
    rows = facts.rows(c.fact_type)
    types = {f.name: f.dataType for f in rows.schema}
    same = all(types[a] == types[b] for a, b in zip(need, have))

    def key(role: str) -> Column:
        return group_key(role, types[role]) if same else F.coalesce(F.col(role).cast("string"), F.lit(""))

    left = rows.select("*", *[key(r).alias(f"_k{i}") for i, r in enumerate(need)])
    right = rows.select(F.col("pop_id").alias("_pop"), *[key(r).alias(f"_m{i}") for i, r in enumerate(have)]).distinct()
    condition = [F.col("pop_id").eqNullSafe(F.col("_pop")), *[F.col(f"_k{i}").eqNullSafe(F.col(f"_m{i}")) for i in range(len(need))]]
    return left.join(right, condition, "left_anti").select(*record(
        rule, c.severity, F.col("pop_id"), constraint=c.id, fact_type=c.fact_type, pop=F.col("pop_id"), inst=F.col("inst_id"),
        subject=[F.coalesce(F.col(r).cast("string"), F.lit("")) for r in need],
        detail={"roles": F.lit(",".join(need))},
        message=f"no matching tuple in roles {','.join(have)}",
    ))


def check_local_subset(facts: FactSet, c: Constraint) -> DataFrame:
    return _local_missing(facts, c, "population/subset-violation", c.roles, c.roles2)


def check_local_equality(facts: FactSet, c: Constraint) -> DataFrame:
    rule = "population/equality-violation"
    return union([
        _local_missing(facts, c, rule, c.roles, c.roles2),
        _local_missing(facts, c, rule, c.roles2, c.roles),
    ])


def _bound_violation(counts: DataFrame, severity: Column | str, rule: str, element: Column, low: Column, high: Column, constraint=None, fact_type=None) -> DataFrame:
    n = F.col("n")
    bounds = F.array_compact(F.array(F.when(n < low, F.lit("min")), F.when(n > high, F.lit("max"))))
    return (
        counts.filter((n > 0) & ((n < low) | (n > high)))
        .withColumn("bound", F.explode(bounds))
        .select(*record(rule, severity, element, constraint=constraint, fact_type=fact_type, subject=[n],
                        detail={"count": n, "bound": F.col("bound")},
                        message=F.concat(n.cast("string"), F.lit(" instance(s), outside the "), F.col("bound"))))
    )


def value_sketches(values: DataFrame, keys: list[str], value: str = "value", lg_k: int = 14) -> DataFrame:
    """A mergeable sketch of the distinct values of each key (keys, sketch): a few kilobytes however many values there are."""
    return values.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def distinct_counts(values: DataFrame, keys: list[str], value: str = "value", approximate: bool = False, lg_k: int = 14) -> DataFrame:
    """Distinct values of each key (keys, n); exact by default.

    ``approximate`` counts by sketches, without shuffling values: the relative standard error is about 0.83 / sqrt(2^lg_k), 0.65 %
    for the default. Sketches of several tables (``value_sketches``) are united with ``united_counts``."""
    if approximate:
        return united_counts([value_sketches(values, keys, value, lg_k)], keys)
    return values.select(*keys, value).filter(F.col(value).isNotNull()).distinct().groupBy(*keys).agg(F.count("*").alias("n"))


def united_counts(sketches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct values of each key over all tables that the sketches were made of (keys, n)."""
    together = reduce(lambda a, b: a.unionByName(b), sketches)
    return together.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def check_object_cardinality(facts: FactSet) -> DataFrame | None:
    """Distinct objects of each bounded object type against its bounds (always an error)."""
    parts = []
    for ot in facts.object_types.values():
        if ot.min is None and ot.max is None:
            continue
        universe = facts.universe(ot.id)
        if universe is not None:
            # distinct first (hash partitioned), then a plain count: no single-task set of values
            parts.append(_bound_violation(
                universe.distinct().agg(F.count("*").alias("n")), "error", "population/object-cardinality-violation",
                F.lit(ot.id), F.lit(ot.min or 0), F.lit(ot.max).cast("bigint")))
    return union(parts) if parts else None


def check_role_cardinality(facts: FactSet, c: Constraint) -> DataFrame | None:
    values = facts.role_values(c.roles[0])
    if values is None:
        return None
    return _bound_violation(
        values.distinct().agg(F.count("*").alias("n")), c.severity, "population/unary-role-cardinality-violation",
        F.lit(c.id or c.fact_type), F.lit(c.min), F.lit(c.max).cast("bigint"), c.id, c.fact_type)
