"""Rows that a constraint must reject, generated in any number: one small population per seed id.

Values are minted per seed, so the populations do not interfere even under rules
that look at all data. ``forbidden`` returns the rows per fact type as bindings
ready for ``FactSet.bind``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.keys import infer_join
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint

# Pairs of value numbers that break each ring property.
RING_PAIRS = {
    "irreflexive": ((0, 0),), "asymmetric": ((0, 1), (1, 0)), "antisymmetric": ((0, 1), (1, 0)), "acyclic": ((0, 1), (1, 0)),
    "symmetric": ((0, 1),), "purely_reflexive": ((0, 1),), "transitive": ((0, 1), (1, 2)), "intransitive": ((0, 1), (1, 2), (0, 2)),
}


def mint(player: str, index: int, seed: Column, allowed: tuple[str, ...] = ()) -> Column:
    """A stable placeholder like ``Customer#1@7``, or one of the allowed values where the role has a list."""
    if allowed:
        return F.lit(allowed[index % len(allowed)])
    return F.concat(F.lit(f"{player}#{index + 1}@"), seed.cast("string"))


def mint_invalid(player: str, values: tuple[str, ...], seed: Column) -> Column:
    """A placeholder that is in no way one of the values."""
    base, i = f"{player}#invalid", 0
    while any(v.startswith(base if i == 0 else f"{base}-{i}") for v in values):
        i += 1
    return F.concat(F.lit(f"{base if i == 0 else f'{base}-{i}'}@"), seed.cast("string"))


def _rows(facts: FactSet, fact_type: str, seeds: DataFrame, instances: list[dict[str, Column]], fill: int = 0) -> tuple:
    """Binding of the given instances per seed; roles not named get the value numbered ``fill``."""
    seed = F.col("seed")
    roles = facts.fact_types[fact_type].roles
    structs = [
        F.struct(F.lit(i).alias("i"), *[given.get(r.id, mint(r.player, fill, seed)).cast("string").alias(r.id) for r in roles])
        for i, given in enumerate(instances)
    ]
    rows = seeds.select(seed, F.inline(F.array(*structs)))
    pop = F.concat(F.lit("forbidden-"), seed.cast("string"))
    return fact_type, rows, {r.id: r.id for r in roles}, "i", F.concat_ws("-", F.lit(fact_type), seed, "i"), pop


def forbidden(facts: FactSet, c: Constraint, seeds: DataFrame) -> list[tuple] | None:
    """Bindings (fact type, rows, roles, ord, inst_id, pop_id) that break the constraint, or None when nothing can.

    ``seeds`` has a column ``seed``; one breaking population comes from each.
    """
    seed = F.col("seed")

    def player(role_id: str) -> str:
        return facts.role(role_id)[1].player

    def value(role_id: str, index: int) -> Column:
        return mint(player(role_id), index, seed)

    if c.kind == "internal_uniqueness":
        others = [r.id for r in facts.fact_types[c.fact_type].roles if r.id not in c.roles]
        same = {r: value(r, 0) for r in c.roles}
        return [_rows(facts, c.fact_type, seeds, [{**same, **{r: value(r, i) for r in others}} for i in (0, 1)])]
    if c.kind == "value_constraint":
        return [_rows(facts, c.fact_type, seeds, [{c.roles[0]: mint_invalid(player(c.roles[0]), c.values, seed)}])]
    if c.kind == "frequency":
        return _frequency(facts, c, seeds, value)
    if c.kind == "ring":
        a, b = c.roles
        return [_rows(facts, c.fact_type, seeds, [{a: value(a, x), b: value(a, y)} for x, y in RING_PAIRS[c.ring]])]
    if c.kind in ("mandatory", "disjunctive_mandatory"):
        return _unplayed(facts, c, seeds, value)
    if c.kind in ("exclusion", "exclusive_or"):
        by_type: dict[str, dict[str, Column]] = {}
        for r in c.roles:
            by_type.setdefault(facts.role(r)[0].id, {})[r] = value(c.roles[0], 0)
        return [_rows(facts, ft, seeds, [given], fill=1) for ft, given in by_type.items()] if len(c.roles) > 1 else None
    if c.kind in ("subset", "equality"):
        own, other = facts.role(c.roles[0])[0].id, facts.role(c.roles2[0])[0].id
        return None if own == other else [_rows(facts, own, seeds, [{r: value(r, 0) for r in c.roles}], fill=1)]
    if c.kind == "external_uniqueness":
        return _shared_combination(facts, c, seeds, value)
    return None


def _frequency(facts, c, seeds, value):
    if len(c.roles) != 1 or (c.max is None and c.min <= 1):
        return None
    count = c.max + 1 if c.max is not None else c.min - 1
    others = [r.id for r in facts.fact_types[c.fact_type].roles if r.id != c.roles[0]]
    same = {c.roles[0]: value(c.roles[0], 0)}
    return [_rows(facts, c.fact_type, seeds, [{**same, **{r: value(r, i) for r in others}} for i in range(count)])]


def _unplayed(facts, c, seeds, value):
    """An object that shows up in some other role of its type only."""
    wanted = facts.role(c.roles[0])[1].player
    anchor = next(((ft, r) for ft in facts.fact_types.values() for r in ft.roles if r.player == wanted and r.id not in c.roles), None)
    if anchor is None:
        return None
    return [_rows(facts, anchor[0].id, seeds, [{anchor[1].id: value(c.roles[0], 0)}], fill=1)]


def _shared_combination(facts, c, seeds, value):
    join = infer_join(facts, c.roles)
    if join is None:
        return None
    first_key = join[1][c.roles[0]]
    return [
        _rows(facts, facts.role(role)[0].id, seeds, [{join[1][role]: value(first_key, i), role: value(role, 0)} for i in (0, 1)])
        for role in c.roles
    ]


def bind_forbidden(facts: FactSet, c: Constraint, seeds: DataFrame) -> FactSet | None:
    bindings = forbidden(facts, c, seeds)
    if bindings is None:
        return None
    for fact_type, rows, roles, ord_, inst, pop in bindings:
        facts = facts.bind(fact_type, rows, roles, ord=ord_, inst_id=inst, pop_id=pop)
    return facts
