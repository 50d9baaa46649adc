"""Row-local checks. All checks of one fact type share a single pass over its rows:
each one contributes an array of violation structs, and the arrays are exploded together."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.predicates import allowed_value, compare, missing_roles
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint, FactType
from factloom.plans.violations import record, union


class Finding:
    """What one check adds to a scan: when a row is concerned, and its violations as an array of structs."""

    def __init__(self, test: Column, found: Column | None = None, fields: list[Column] | None = None):
        self.test, self.found, self.fields = test, found, fields

    def as_array(self) -> Column:
        if self.found is not None:
            return self.found
        return F.filter(F.array(F.when(self.test, F.struct(*self.fields))), lambda v: v.isNotNull())


def _one(test: Column, fields: list[Column]) -> Finding:
    """At most one violation per row."""
    return Finding(test, fields=fields)


def _base(c: Constraint, rule: str, **more) -> list[Column]:
    return record(
        rule, c.severity, F.col("pop_id"), constraint=c.id, fact_type=c.fact_type,
        pop=F.col("pop_id"), inst=F.col("inst_id"), **more,
    )


def _value_constraint(df: DataFrame, c: Constraint) -> Finding:
    role = c.roles[0]
    value = F.col(role)
    bad = value.isNotNull() & ~allowed_value(value, c.values, c.ranges, df.schema[role].dataType)
    message = F.concat(F.lit(f"value of {role} outside the permitted values: "), value.cast("string"))
    return _one(bad, _base(c, "population/value-constraint-violation", subject=[value], message=message))


def _value_comparison(df: DataFrame, c: Constraint) -> Finding:
    a, b = c.roles
    holds = compare(F.col(a), c.operator, F.col(b), df.schema[a].dataType, df.schema[b].dataType)
    bad = F.col(a).isNotNull() & F.col(b).isNotNull() & ~holds
    message = f"{a} {c.operator} {b} does not hold"
    return _one(bad, _base(c, "population/value-comparison-violation", subject=[F.col(a), F.col(b)], message=message))


def _exclusion(df: DataFrame, c: Constraint) -> Finding:
    """One violation per value that fills more than one of the roles in the same row."""
    cells = F.array(*[F.col(r).cast("string") for r in c.roles])
    repeated = F.filter(
        F.array_distinct(F.array_compact(cells)),
        lambda v: F.size(F.filter(cells, lambda x: x == v)) > 1,
    )
    found = F.transform(
        repeated,
        lambda v: F.struct(*_base(
            c, "population/exclusion-violation", subject=F.array(v),
            message=F.concat(F.lit("value fills several excluded roles: "), v),
        )),
    )
    some = reduce(lambda a, b: a | b, [cells[i] == cells[j] for i, j in combinations(range(len(c.roles)), 2)], F.lit(False))
    return Finding(some, found)


def _exclusive_or(df: DataFrame, c: Constraint) -> Finding:
    filled = sum((F.col(r).isNotNull().cast("int") for r in c.roles), F.lit(0))
    played = F.array_compact(F.array(*[F.when(F.col(r).isNotNull(), F.lit(r)) for r in c.roles]))
    message = F.concat(F.lit("exactly one role must be filled; filled: "), filled.cast("string"))
    return _one(filled != 1, _base(c, "population/exclusive-or-violation", subject=played, message=message))


def _irreflexive(df: DataFrame, c: Constraint) -> Finding:
    a, b = c.roles
    return _one(F.col(a) == F.col(b), _base(
        c, "population/ring-violation", subject=[F.col(a), F.col(b)], message="irreflexive: same object in both roles"))


def _purely_reflexive(df: DataFrame, c: Constraint) -> Finding:
    a, b = c.roles
    return _one(F.col(a) != F.col(b), _base(
        c, "population/ring-violation", subject=[F.col(a), F.col(b)], message="purely reflexive: two different objects"))


LOCAL_KINDS = {
    "value_constraint": _value_constraint,
    "value_comparison": _value_comparison,
    "exclusion": _exclusion,
    "exclusive_or": _exclusive_or,
    "ring:irreflexive": _irreflexive,
    "ring:purely_reflexive": _purely_reflexive,
}


def kind_key(c: Constraint) -> str:
    return f"ring:{c.ring}" if c.kind == "ring" else c.kind


def is_row_local(c: Constraint, fact_type: FactType) -> bool:
    """The check looks at one row at a time: right kind, and every role in the same fact type."""
    return kind_key(c) in LOCAL_KINDS and bool(c.roles) and all(fact_type.has(r) for r in c.roles)


def incomplete(fact_type: FactType, player_names: dict[str, str]) -> Finding:
    names = [(r.id, player_names.get(r.player, r.id)) for r in fact_type.roles]
    lacking = missing_roles(names)
    fields = record(
        "population/incomplete-instance", "error", F.col("inst_id"), fact_type=fact_type.id,
        pop=F.col("pop_id"), inst=F.col("inst_id"), subject=lacking,
        message=F.concat(F.lit("no value for: "), F.array_join(lacking, ", ")),
    )
    return _one(F.size(lacking) > 0, fields)


def check_rows(rows: DataFrame, fact_type: FactType, constraints: list[Constraint], player_names: dict[str, str] | None = None) -> DataFrame:
    """All row-local checks of a fact type in one pass; works on batch and streaming rows.

    ``player_names`` (possibly empty) switches the incomplete-instance check on.
    """
    findings = [LOCAL_KINDS[kind_key(c)](rows, c) for c in constraints]
    if player_names is not None:
        findings.append(incomplete(fact_type, player_names))
    # only rows that concern some check get violation structs; simple tests reach the scan
    concerned = rows.filter(reduce(lambda a, b: a | b, [f.test for f in findings]))
    if len(findings) == 1 and findings[0].fields is not None:
        return concerned.select(*findings[0].fields)
    arrays = [f.as_array() for f in findings]
    return concerned.select(F.inline(arrays[0] if len(arrays) == 1 else F.concat(*arrays)))


def check_local(facts: FactSet, constraints: list[Constraint], incomplete_instances: bool = False) -> DataFrame | None:
    by_type: dict[str, list[Constraint]] = defaultdict(list)
    for c in constraints:
        by_type[c.fact_type].append(c)
    if incomplete_instances:
        for ft in facts.fact_types:
            by_type.setdefault(ft, [])
    names = {ot.id: ot.name for ot in facts.object_types.values()}
    parts = [
        check_rows(facts.rows(ft), facts.fact_types[ft], cs, names if incomplete_instances else None)
        for ft, cs in by_type.items()
        if facts.has_rows(ft) and (cs or incomplete_instances)
    ]
    return union(parts) if parts else None
