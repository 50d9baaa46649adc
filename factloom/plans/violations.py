"""The one output shape of every check and lint rule."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS = (
    "rule_id", "severity", "element_id", "constraint_id", "fact_type_id",
    "pop_id", "inst_id", "subject", "detail", "message",
)
# Severity order of reports.
SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}


def _text(value: str | Column | None) -> Column:
    if value is None:
        return F.lit(None).cast("string")
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def record(
    rule: str | Column,
    severity: str | Column,
    element: str | Column,
    *,
    constraint: str | Column | None = None,
    fact_type: str | Column | None = None,
    pop: Column | None = None,
    inst: Column | None = None,
    subject: Iterable[Column] | Column = (),
    detail: dict[str, Column] | None = None,
    message: Column | str = "",
) -> list[Column]:
    """The violation columns as named expressions, for ``select`` or ``struct``."""
    if not isinstance(subject, Column):
        parts = [_text(s) for s in subject]
        subject = F.array(*parts) if parts else F.array().cast("array<string>")
    entries = [c for k, v in (detail or {}).items() for c in (F.lit(k), _text(v))]
    return [
        _text(rule).alias("rule_id"),
        _text(severity).alias("severity"),
        _text(element).alias("element_id"),
        _text(constraint).alias("constraint_id"),
        _text(fact_type).alias("fact_type_id"),
        _text(pop).alias("pop_id"),
        _text(inst).alias("inst_id"),
        subject.alias("subject"),
        (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("detail"),
        _text(message).alias("message"),
    ]


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def severity_rank(severity: Column | None = None) -> Column:
    severity = F.col("severity") if severity is None else severity
    rank = F.lit(len(SEVERITY_RANK))
    for name, position in SEVERITY_RANK.items():
        rank = F.when(severity == name, position).otherwise(rank)
    return rank


def report_order(violations: DataFrame) -> DataFrame:
    """Errors first, then warnings and infos; ties by rule, element and subject."""
    return violations.orderBy(severity_rank(), "rule_id", "element_id", "inst_id", F.array_join("subject", "\u0001", "\u0002"))


def errors_only(violations: DataFrame) -> DataFrame:
    return violations.filter(F.col("severity") == "error")


def is_valid(violations: DataFrame) -> bool:
    return errors_only(violations).isEmpty()


def tally(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule_id").agg(F.count("*").alias("violations"))
