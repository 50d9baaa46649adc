"""Checks on keys: internal and external uniqueness, frequency, and plain column tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.predicates import group_key
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint
from factloom.plans.session import materialize
from factloom.plans.violations import record


def repeated_keys(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Keys (_k0, _k1, ...) that several rows share. A plain count, so the aggregate hashes and combines in every task."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return rows.select(*named).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def later_duplicates(rows: DataFrame, keys: list[Column], order: str = "ord", identity: str = "inst_id", repeated: DataFrame | None = None) -> DataFrame:
    """Rows that repeat an earlier row's key, with ``first_id`` of the earliest one.

    Keys are counted first, by themselves. Only rows of keys that do repeat (``repeated``, where they are known already)
    go on: the first of each key comes from a map-side combined aggregate over them and is joined back. No key is ever
    sorted inside one task, and a hot key's rows are on the side that adaptive skew splitting can divide.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    repeated = repeated_keys(rows, keys) if repeated is None else repeated

    def same(left: str, right: str) -> list[Column]:
        return [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]

    again = keyed.alias("l").join(repeated.alias("r"), same("l", "r"), "left_semi")
    firsts = again.groupBy(*names).agg(F.min(F.struct(F.col(order).alias("o"), F.col(identity).alias("i"))).alias("_first"))
    later = F.struct(F.col(f"l.{order}").alias("o"), F.col(f"l.{identity}").alias("i")) > F.col("r._first")
    return (
        again.alias("l").join(firsts.alias("r"), [*same("l", "r"), later], "inner")
        .select("l.*", F.col("r._first.i").alias("first_id"))
        .drop(*names)
    )


def _unique_keys(rows: DataFrame, c: Constraint) -> list[Column]:
    return [F.col("pop_id"), *[group_key(r, rows.schema[r].dataType) for r in c.roles]]


def check_uniqueness(facts: FactSet, c: Constraint, repeated: DataFrame | None = None) -> DataFrame:
    rows = facts.rows(c.fact_type)
    return later_duplicates(rows, _unique_keys(rows, c), repeated=repeated).select(*record(
        "population/uniqueness-violation", c.severity, F.col("pop_id"), constraint=c.id, fact_type=c.fact_type,
        pop=F.col("pop_id"), inst=F.col("inst_id"),
        subject=[F.coalesce(F.col(r).cast("string"), F.lit("")) for r in c.roles],
        detail={"first": F.col("first_id")},
        message=F.concat(F.lit("repeats the key of instance "), F.col("first_id")),
    ))


KEY_KINDS = ("internal_uniqueness", "frequency")


def check_keys(facts: FactSet, constraints: list[Constraint]) -> list[DataFrame]:
    """Uniqueness and frequency constraints of one fact type from one pass over its rows.

    Every row stands once for each distinct key set (grouping sets), and one combinable count tells all keys; only those
    that some constraint objects to are stored. Frequencies are done with that; uniqueness then looks up the rows of
    its repeated keys. A single constraint needs no such pass.
    """
    rows = facts.rows(constraints[0].fact_type)
    if len(constraints) == 1:
        c = constraints[0]
        return [check_uniqueness(facts, c) if c.kind == "internal_uniqueness" else check_frequency(facts, c)]
    roles = list(dict.fromkeys(r for c in constraints for r in c.roles))
    # a missing value is part of a unique key, but not of a frequency
    unique = {c.id: tuple(f"u_{r}" for r in c.roles) for c in constraints if c.kind == "internal_uniqueness"}
    often = {c.id: tuple(f"f_{r}" for r in c.roles) for c in constraints if c.kind == "frequency"}
    columns = ["pop_id", *dict.fromkeys(name for names in [*unique.values(), *often.values()] for name in names)]
    named = {f"u_{r}": group_key(r, rows.schema[r].dataType) for r in roles} | {f"f_{r}": F.col(r) for r in roles}
    sets = list(dict.fromkeys([*unique.values(), *often.values()]))
    keyed = rows.select("pop_id", *[named[n].alias(n) for n in columns[1:]])
    counts = keyed.groupingSets([[F.col("pop_id"), *map(F.col, names)] for names in sets], *map(F.col, columns)).agg(
        F.count("*").alias("n"), F.grouping_id().alias("key_set"))
    bit = {name: 1 << (len(columns) - 1 - i) for i, name in enumerate(columns)}
    number = {names: sum(bit[n] for n in columns[1:] if n not in names) for names in sets}

    def bad(c: Constraint) -> Column:
        if c.kind == "internal_uniqueness":
            return (F.col("key_set") == number[unique[c.id]]) & (F.col("n") > 1)
        there = [F.col(n).isNotNull() for n in often[c.id]]
        return reduce(lambda x, y: x & y, [F.col("key_set") == number[often[c.id]], *there, _off_bounds(c)])

    found = materialize(counts.filter(reduce(lambda x, y: x | y, map(bad, constraints))), "key-counts")
    parts = []
    for c in constraints:
        mine = found.filter(bad(c))
        if c.kind == "internal_uniqueness":
            keys = mine.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(("pop_id", *unique[c.id]))])
            parts.append(check_uniqueness(facts, c, keys))
        else:
            parts.append(_frequency_rows(mine.select("pop_id", "n", *[F.col(n).alias(r) for n, r in zip(often[c.id], c.roles)]), c))
    return parts


def infer_join(facts: FactSet, role_ids: tuple[str, ...]) -> tuple[str, dict[str, str]] | None:
    """Common object type of an external uniqueness constraint and its key role per constrained role.

    The common type plays exactly one unconstrained role in every constrained
    fact type, is not itself constrained, and must be the only such type.
    (Declarations only; ``catalog_lint.external_join_keys`` does it for a catalog table.)
    """
    if len(role_ids) < 2:
        return None
    try:
        located = [facts.role(r) for r in role_ids]
    except KeyError:
        return None
    if len({ft.id for ft, _ in located}) < len(located):
        return None
    constrained = {role.player for _, role in located}
    options: list[dict[str, str]] = []
    for ft, own in located:
        free = [r for r in ft.roles if r.id != own.id and r.player not in constrained]
        players = [r.player for r in free]
        options.append({r.player: r.id for r in free if players.count(r.player) == 1})
    common = set.intersection(*[set(o) for o in options])
    if len(common) != 1:
        return None
    player = common.pop()
    return player, {role: option[player] for role, option in zip(role_ids, options)}


def check_external_uniqueness(facts: FactSet, c: Constraint) -> DataFrame | None:
    """Objects that share their combination of constrained values with an earlier object.

    Per object and constrained role the last value counts; objects are ordered by
    where they first occur, roles being visited in declared order.
    """
    join = infer_join(facts, c.roles)
    if join is None or not all(facts.has_rows(facts.role(r)[0].id) for r in c.roles):
        return None
    combined = None
    for i, role in enumerate(c.roles):
        key_role = join[1][role]
        rows = facts.rows(facts.role(role)[0].id).select(
            F.col(key_role).cast("string").alias("common"), F.col(role).cast("string").alias("v"), "ord", "inst_id",
        ).dropna(subset=["common", "v"])
        at = F.struct("ord", "inst_id")
        last = rows.groupBy("common").agg(
            F.max_by("v", at).alias(f"v{i}"), F.min(at).alias(f"at{i}"))
        combined = last if combined is None else combined.join(last, "common")
    values = [f"v{i}" for i in range(len(c.roles))]
    combined = combined.select("common", F.col("at0").alias("ord"), *values)
    return later_duplicates(combined, [F.col(v) for v in values], identity="common").select(*record(
        "population/external-uniqueness-violation", c.severity, c.id or c.fact_type, constraint=c.id, fact_type=c.fact_type,
        subject=[F.col("common")], detail={"first": F.col("first_id")},
        message=F.concat(F.lit("same combination as "), F.col("first_id")),
    ))


def _off_bounds(c: Constraint) -> Column:
    bad = F.col("n") < c.min
    return bad if c.max is None else bad | (F.col("n") > c.max)


def _frequency_rows(counts: DataFrame, c: Constraint) -> DataFrame:
    # A value can miss both bounds only when min > max; then it is reported once per bound.
    bounds = [F.when(F.col("n") < c.min, F.lit("min"))]
    if c.max is not None:
        bounds.append(F.when(F.col("n") > c.max, F.lit("max")))
    return (
        counts.filter(_off_bounds(c)).withColumn("bound", F.explode(F.array_compact(F.array(*bounds))))
        .select(*record(
            "population/frequency-violation", c.severity, F.col("pop_id"), constraint=c.id, fact_type=c.fact_type,
            pop=F.col("pop_id"), subject=[F.col(r) for r in c.roles],
            detail={"count": F.col("n"), "bound": F.col("bound")},
            message=F.concat(F.lit("occurs "), F.col("n").cast("string"), F.lit(" time(s), outside the "), F.col("bound")),
        ))
    )


def check_frequency(facts: FactSet, c: Constraint) -> DataFrame | None:
    if not c.roles:
        return None
    return _frequency_rows(
        facts.rows(c.fact_type).select("pop_id", *c.roles).dropna(subset=list(c.roles))
        .groupBy("pop_id", *c.roles).agg(F.count("*").alias("n")), c)


def column_not_null(df: DataFrame, column: str, shown: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNull()).select(*shown, column)


def column_unique(df: DataFrame, column: str) -> DataFrame:
    """Values held by more than one row, with their counts."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    )


def column_accepted_values(df: DataFrame, column: str, accepted: list) -> DataFrame:
    """Values outside the list, with their row counts."""
    return df.filter(~F.col(column).isin(*accepted)).groupBy(column).agg(F.count("*").alias("n"))


def column_relationships(df: DataFrame, column: str, to: DataFrame, field: str) -> DataFrame:
    """Rows whose value is absent from the parent column."""
    parents = to.select(F.col(field).alias(column)).filter(F.col(column).isNotNull()).distinct()
    return df.filter(F.col(column).isNotNull()).join(parents, column, "left_anti")
