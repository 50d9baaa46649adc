"""Predicates on role values: numeric-or-lexical comparison, ranges, value sets, name matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from factloom.plans.model import ValueRange

# Fixed value: decimal number text, optional exponent.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Operator spellings and the sign test each stands for.
OPERATORS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
}


def as_number(value: Column) -> Column:
    """The number a text stands for, NULL when it is not finite number text."""
    number = F.when(value.rlike(NUMBER_TEXT), value.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def is_number(value: Column) -> Column:
    return as_number(value).isNotNull()


def _comparable_natively(left: T.DataType, right: T.DataType) -> bool:
    numeric = isinstance(left, T.NumericType) and isinstance(right, T.NumericType)
    return numeric or (left == right and isinstance(left, (T.DateType, T.TimestampType, T.TimestampNTZType)))


def compare(a: Column, op: str, b: Column, a_type: T.DataType | None = None, b_type: T.DataType | None = None) -> Column:
    """``a op b``: as numbers when both are number text, else by text order.

    With known numeric or date types the plain typed comparison is used, which
    keeps the predicate eligible for Parquet pushdown.
    """
    test = OPERATORS[op]
    if a_type is not None and b_type is not None and _comparable_natively(a_type, b_type):
        return test(a, b)
    a, b = a.cast("string"), b.cast("string")
    x, y = as_number(a), as_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(a, b))


def in_range(value: Column, bounds: ValueRange, dtype: T.DataType | None = None) -> Column:
    """Value within the bounds; numeric only if the value and every present bound are numbers."""
    lower = None if bounds.min is None else (">=" if bounds.min_inclusive else ">", bounds.min)
    upper = None if bounds.max is None else ("<=" if bounds.max_inclusive else "<", bounds.max)
    present = [b for b in (lower, upper) if b is not None]
    numeric_bounds = all(_finite(text) for _, text in present)

    def holds(subject: Column, convert) -> Column:
        test = F.lit(True)
        for op, text in present:
            test = test & OPERATORS[op](subject, F.lit(convert(text)))
        return test

    if numeric_bounds and isinstance(dtype, T.NumericType):
        return holds(value, float)
    text_value = value.cast("string")
    if not numeric_bounds:
        return holds(text_value, str)
    number = as_number(text_value)
    return F.when(number.isNotNull(), holds(number, float)).otherwise(holds(text_value, str))


def _finite(text: str) -> bool:
    try:
        return abs(float(text)) < float("inf")
    except ValueError:
        return False


def in_values(value: Column, allowed: Sequence[str]) -> Column:
    return value.cast("string").isin(*allowed) if allowed else F.lit(False)


def allowed_value(value: Column, values: Sequence[str], ranges: Sequence[ValueRange], dtype: T.DataType | None = None) -> Column:
    test = in_values(value, values)
    for bounds in ranges:
        test = test | in_range(value, bounds, dtype)
    return test


def missing_roles(roles: Sequence[tuple[str, str]]) -> Column:
    """Names (second of each pair) of the role columns (first) that are NULL."""
    labelled = F.array(*[F.when(F.col(c).isNull(), F.lit(label)) for c, label in roles])
    return F.filter(labelled, lambda name: name.isNotNull())


def same_name(name: Column, wanted: Column | str) -> Column:
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    return F.lower(name) == F.lower(wanted)


def keyword(text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(text), r"[\s-]+", "_")


def matches_keyword(constraint_type: Column, text: Column | str) -> Column:
    """Constraint kind equal to, or containing, the normalised keyword."""
    return F.contains(constraint_type, keyword(text))


def group_key(name: str, dtype: T.DataType) -> Column:
    """Part of a composite key in which a missing value counts as empty text.

    Only text can be empty, so other types keep their native form and let NULL
    stand for "missing": rows group the same way and hash faster.
    """
    return F.coalesce(F.col(name), F.lit("")) if isinstance(dtype, T.StringType) else F.col(name)


def has_all_terms(text: Column, terms: Column) -> Column:
    """Every term occurs in the text, ignoring case."""
    return F.forall(terms, lambda term: F.contains(F.lower(text), F.lower(term)))
