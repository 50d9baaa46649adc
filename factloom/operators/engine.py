"""Run declared constraints over a FactSet and return one DataFrame of violations."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from factloom.operators import keys, paths, rings, rows, sets
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint
from factloom.plans.session import materialize_all
from factloom.plans.violations import COLUMNS, errors_only, record, report_order, tally, union

Rule = Callable[[FactSet], DataFrame]


def _local(facts: FactSet, c: Constraint) -> bool:
    ft = facts.fact_types.get(c.fact_type)
    return ft is not None and all(ft.has(r) for r in (*c.roles, *c.roles2))


def check(facts: FactSet, c: Constraint) -> DataFrame | None:
    """The violations of one constraint, or None when no data bears on it."""
    local = _local(facts, c)
    needs_rows = c.kind in {"internal_uniqueness", "value_constraint", "value_comparison", "frequency", "ring"}
    if needs_rows and not (local and facts.has_rows(c.fact_type) and c.roles):
        return None
    if rows.is_row_local(c, facts.fact_types[c.fact_type]) if c.fact_type in facts.fact_types else False:
        return rows.check_local(facts, [c])
    if c.kind in {"subset", "equality"} and local:
        if not facts.has_rows(c.fact_type):
            return None
        return (sets.check_local_subset if c.kind == "subset" else sets.check_local_equality)(facts, c)
    checks = {
        "internal_uniqueness": keys.check_uniqueness,
        "external_uniqueness": keys.check_external_uniqueness,
        "frequency": keys.check_frequency,
        "ring": rings.check_ring,
        "mandatory": sets.check_mandatory,
        "disjunctive_mandatory": sets.check_mandatory,
        "exclusion": sets.check_exclusion,
        "exclusive_or": sets.check_exclusive_or,
        "subset": sets.check_subset,
        "equality": sets.check_equality,
        "cardinality": sets.check_role_cardinality,
        "join_subset": paths.check_join,
        "join_equality": paths.check_join,
        "join_exclusion": paths.check_join,
    }
    return checks[c.kind](facts, c)


def _with_stored_rows(facts: FactSet, constraints: list[Constraint]) -> FactSet:
    """facts with the computed rows of each fact type that several constraints read stored in the shared folder."""
    readers: dict[str, int] = {}
    for c in constraints:
        readers[c.fact_type] = readers.get(c.fact_type, 0) + 1
    for fact_type, count in readers.items():
        if count > 1 and facts.is_computed(fact_type):
            facts = facts.store(fact_type)
    return facts


def check_dangling(populations: DataFrame, fact_types: DataFrame) -> DataFrame:
    """Populations (pop_id, fact_type_id) whose fact type is not declared (fact_type_id)."""
    known = fact_types.select("fact_type_id").distinct()
    return populations.select("pop_id", "fact_type_id").distinct().join(known, "fact_type_id", "left_anti").select(*record(
        "population/dangling-fact-type", "error", F.col("pop_id"), fact_type=F.col("fact_type_id"), pop=F.col("pop_id"),
        subject=[F.col("fact_type_id")], message="population of an undeclared fact type"))


def _shared_pass(facts: FactSet, c: Constraint) -> tuple:
    """Constraints with the same value are checked in one pass; alone ones have their own."""
    bound = _local(facts, c) and facts.has_rows(c.fact_type) and bool(c.roles)
    if c.kind in keys.KEY_KINDS and bound:
        return "keys", c.fact_type
    if c.kind in paths.PATH_KINDS:
        return "paths", frozenset(c.operands)
    if c.kind == "ring" and c.ring in rings.TRIANGLE_KINDS and bound:
        return "triangles", c.fact_type, c.roles
    return "alone", c


def _united(parts: list[DataFrame]) -> DataFrame | None:
    return union(parts) if parts else None


def _builds(facts: FactSet, constraints: Iterable[Constraint], custom: Iterable[Rule], incomplete_instances: bool, object_types: bool,
            populations: DataFrame | None) -> list[Callable[[], DataFrame | None]]:
    """What builds the violations, part by part. Row-local checks of a fact type share one scan; so do its key checks, the
    constraints over the same role paths, and the ring checks that need triangles."""
    constraints = list(constraints)
    fused = [c for c in constraints if c.fact_type in facts.fact_types and rows.is_row_local(c, facts.fact_types[c.fact_type])]
    builds: list[Callable[[], DataFrame | None]] = [lambda: rows.check_local(facts, fused, incomplete_instances)]
    together: dict[tuple, list[Constraint]] = {}
    for c in constraints:
        if c not in fused:
            together.setdefault(_shared_pass(facts, c), []).append(c)
    for (kind, *_), group in together.items():
        several = {"keys": keys.check_keys, "paths": paths.check_paths, "triangles": rings.check_triangles}.get(kind)
        builds.append((lambda several=several, group=group: _united(several(facts, group))) if several else (lambda c=group[0]: check(facts, c)))
    if object_types:
        builds.append(lambda: sets.check_object_cardinality(facts))
    if populations is not None:
        declared = populations.sparkSession.createDataFrame([(f,) for f in facts.fact_types], "fact_type_id string")
        builds.append(lambda: check_dangling(populations, declared))
    return builds + [lambda rule=rule: rule(facts).select(*COLUMNS) for rule in custom]


def check_all(facts: FactSet, constraints: Iterable[Constraint], custom: Iterable[Rule] = (), incomplete_instances: bool = True,
              object_types: bool = True, populations: DataFrame | None = None) -> DataFrame | None:
    """Every check as one plan.

    ``object_types`` checks the declared numbers of objects; ``populations`` (pop_id, fact_type_id), where given, is
    checked for undeclared fact types. For many checks of large tables, ``store_all`` is the better way.
    """
    parts = [build() for build in _builds(facts, constraints, custom, incomplete_instances, object_types, populations)]
    parts = [p for p in parts if p is not None]
    return union(parts) if parts else None


def store_all(facts: FactSet, constraints: Iterable[Constraint], custom: Iterable[Rule] = (), incomplete_instances: bool = True,
              object_types: bool = True, populations: DataFrame | None = None) -> DataFrame | None:
    """Every check as a job of its own, several at a time, stored and read back; the rows of ``check_all``.

    Rows that are computed (``computed`` bindings) and read by several checks are stored once before."""
    constraints = list(constraints)
    facts = _with_stored_rows(facts, constraints)
    spark = facts.session()
    if spark is None:
        return None
    return materialize_all(_builds(facts, constraints, custom, incomplete_instances, object_types, populations), "violations", spark)


def run(facts: FactSet, constraints: Iterable[Constraint], custom: Iterable[Rule] = ()) -> DataFrame | None:
    """All violations in report order. They are stored first: sorting by range reads its input twice."""
    found = store_all(facts, constraints, custom)
    return None if found is None else report_order(found)


def rejects_population(facts: FactSet, constraints: Iterable[Constraint], forbidden: list[tuple]) -> DataFrame | None:
    """Do the constraints reject the forbidden rows? Error-level population violations that name an added population.

    ``forbidden`` holds (fact type, DataFrame, roles, ord, inst_id, pop_id) bindings;
    their pop_id values mark what was added.
    """
    names = None
    for fact_type, df, roles, ord_, inst, pop in forbidden:
        facts = facts.bind(fact_type, df, roles, ord=ord_, inst_id=inst, pop_id=pop)
        added = df.select((F.col(pop) if isinstance(pop, str) else pop).cast("string").alias("_pop")).distinct()
        names = added if names is None else names.union(added)
    found = check_all(facts, constraints, object_types=False)
    if found is None or names is None:
        return None
    found = errors_only(found).filter(F.col("rule_id").startswith("population/"))
    return found.join(names.distinct(), found.element_id == names["_pop"], "left_semi")


__all__ = ["check", "check_all", "check_dangling", "errors_only", "rejects_population", "report_order", "run", "store_all", "tally"]
