"""Role paths (chains of equi-joins over fact types) and the checks that compare their tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.sets import _flagged
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint, JoinOperand
from factloom.plans.session import materialize
from factloom.plans.violations import record, union


def path_tuples(facts: FactSet, operand: JoinOperand) -> DataFrame | None:
    """Distinct projected tuples of a role path, columns ``t0, t1, ...``.

    After each hop only the nodes that are still projected, plus the path's
    current end, are kept and de-duplicated, so a many-to-many middle node does
    not multiply into the next hop.
    """
    wanted = set(operand.projection)
    if not operand.steps:
        start = facts.universe(operand.root)
        paths = None if start is None else start.select(F.col("value").alias("n0")).distinct()
        if paths is None:
            return None
    else:
        paths = None
        for k, (entry, exit_) in enumerate(operand.steps):
            if not facts.has_rows(facts.role(entry)[0].id):
                return None
            hop = facts.tuples((entry, exit_), [f"n{k}", f"n{k + 1}"])
            paths = hop if paths is None else paths.join(hop, f"n{k}")
            keep = sorted({i for i in wanted if i <= k + 1} | {k + 1}) if k + 1 < len(operand.steps) else sorted(wanted)
            paths = paths.select(*[f"n{i}" for i in keep]).distinct()
    return paths.select(*[F.col(f"n{node}").alias(f"t{i}") for i, node in enumerate(operand.projection)])


def _compare(facts: FactSet, operands: tuple[JoinOperand, ...]):
    keys = [f"t{i}" for i in range(len(operands[0].projection))]
    sides = [path_tuples(facts, o) for o in operands]
    if all(s is None for s in sides):
        return keys, None
    return keys, _flagged(sides, keys)


def _rows(df: DataFrame, c: Constraint, rule: str, keys: list[str], message: Column | str, detail=None) -> DataFrame:
    return df.select(*record(rule, c.severity, c.id or c.fact_type, constraint=c.id, fact_type=c.fact_type,
                             subject=[F.col(k) for k in keys], detail=detail, message=message))


def with_rollup(details: DataFrame, c: Constraint, rule: str) -> DataFrame:
    """The per-tuple rows plus one summary row for the constraint (only when it is violated)."""
    total = details.agg(F.count("*").alias("n")).filter("n > 0").select(*record(
        rule, c.severity, c.id or c.fact_type, constraint=c.id, fact_type=c.fact_type,
        detail={"tuples": F.col("n")}, message=F.concat(F.lit("violating tuples: "), F.col("n").cast("string"))))
    return union([details, total])


def _judge(c: Constraint, keys: list[str], flags: DataFrame, place: list[int]) -> DataFrame:
    """The violations of one constraint; place says which flag each of its operands has."""
    if c.kind == "join_subset":
        return _rows(flags.filter(F.col(f"s{place[0]}") & ~F.col(f"s{place[1]}")), c, "population/join-subset-violation", keys, "tuple missing from the superset path")
    n = sum((F.col(f"s{i}").cast("int") for i in place), F.lit(0))
    counted = flags.withColumn("n", n)
    if c.kind == "join_equality":
        rule, bad, message = "population/join-equality-violation", counted.filter((F.col("n") > 0) & (F.col("n") < len(place))), "tuple missing from some path"
    else:
        rule, bad, message = "population/join-exclusion-violation", counted.filter("n > 1"), "tuple reached by several paths"
    return with_rollup(_rows(bad, c, rule, keys, message, {"paths": F.col("n")}), c, rule)


PATH_KINDS = ("join_subset", "join_equality", "join_exclusion")


def check_paths(facts: FactSet, constraints: list[Constraint]) -> list[DataFrame]:
    """Constraints over the same role paths, in whatever order: every path is walked once, and which tuples it has is
    stored, for the rows as well as for the summaries of all of them."""
    operands = tuple(dict.fromkeys(constraints[0].operands))
    keys, flags = _compare(facts, operands)
    if flags is None:
        return []
    if len(constraints) > 1 or constraints[0].kind != "join_subset":
        flags = materialize(flags, "path-tuples")
    return [_judge(c, keys, flags, [operands.index(o) for o in c.operands]) for c in constraints]


def check_join(facts: FactSet, c: Constraint) -> DataFrame | None:
    return next(iter(check_paths(facts, [c])), None)
