"""FactSet: tables bound to fact types, one row per fact instance and one column per role."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.plans.model import FactType, ObjectType, Role
from factloom.plans.session import materialize

META = ("pop_id", "inst_id", "ord", "sample")


@dataclass(frozen=True)
class _Binding:
    rows: DataFrame
    sample: bool
    computed: bool = False


class FactSet:
    """Registry from fact type to its populations. Building one runs nothing."""

    def __init__(self, fact_types: list[FactType], object_types: list[ObjectType] = ()):
        self.fact_types = {ft.id: ft for ft in fact_types}
        self.object_types = {ot.id: ot for ot in object_types}
        self._bindings: dict[str, list[_Binding]] = {}

    def bind(
        self,
        fact_type: str,
        df: DataFrame,
        roles: dict[str, str | Column],
        *,
        ord: str | Column,
        inst_id: str | Column,
        pop_id: str | Column,
        sample: bool = False,
        computed: bool = False,
    ) -> "FactSet":
        """Bind a table to a fact type. ``ord`` is any sortable column; it defines first and last.

        ``computed`` marks rows that are dear to compute (joins, windows): where several checks read them, they are stored once.

        Returns a new FactSet; the receiver is unchanged.
        """
        def column(c: str | Column) -> Column:
            return F.col(c) if isinstance(c, str) else c

        declared = self.fact_types[fact_type].roles
        rows = df.select(
            column(pop_id).alias("pop_id"),
            column(inst_id).cast("string").alias("inst_id"),
            column(ord).alias("ord"),
            F.lit(sample).alias("sample"),
            *[
                (column(roles[r.id]) if r.id in roles else F.lit(None).cast("string")).alias(r.id)
                for r in declared
            ],
        )
        other = self._copy()
        other._bindings.setdefault(fact_type, []).append(_Binding(rows, sample, computed))
        return other

    def _copy(self) -> "FactSet":
        other = FactSet(list(self.fact_types.values()), list(self.object_types.values()))
        other._bindings = {k: list(v) for k, v in self._bindings.items()}
        return other

    def session(self) -> SparkSession | None:
        """The session of the bound tables, None where nothing is bound."""
        return next((b.rows.sparkSession for bound in self._bindings.values() for b in bound), None)

    def is_computed(self, fact_type: str) -> bool:
        return any(b.computed for b in self._bindings.get(fact_type, []))

    def store(self, fact_type: str) -> "FactSet":
        """The same facts, with the computed rows of a fact type written to the shared folder and read from there."""
        other = self._copy()
        other._bindings[fact_type] = [_Binding(materialize(b.rows, f"rows-{fact_type}"), b.sample) if b.computed else b for b in self._bindings[fact_type]]
        return other

    def role(self, role_id: str) -> tuple[FactType, Role]:
        for ft in self.fact_types.values():
            for role in ft.roles:
                if role.id == role_id:
                    return ft, role
        raise KeyError(role_id)

    def has_rows(self, fact_type: str) -> bool:
        return bool(self._bindings.get(fact_type))

    def rows(self, fact_type: str, include_samples: bool = True) -> DataFrame | None:
        """All populations of a fact type, or None when nothing is bound."""
        parts = [b.rows for b in self._bindings.get(fact_type, []) if include_samples or not b.sample]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def tuples(self, role_ids: tuple[str, ...], names: list[str], include_samples: bool = True) -> DataFrame:
        """Tuples with every role filled, as text columns; not de-duplicated, so that
        a following aggregate can combine on the map side."""
        fact_type, _ = self.role(role_ids[0])
        rows = self.rows(fact_type.id, include_samples)
        for r in role_ids:
            rows = rows.filter(F.col(r).isNotNull())  # on the column itself, so that it reaches the scan
        return rows.select(*[F.col(r).cast("string").alias(n) for r, n in zip(role_ids, names)])

    def role_values(self, role_id: str, include_samples: bool = True) -> DataFrame | None:
        """Values played in a role across all populations, column ``value`` (with repeats)."""
        fact_type, _ = self.role(role_id)
        if self.rows(fact_type.id, include_samples) is None:
            return None
        return self.tuples((role_id,), ["value"], include_samples)

    def universe(self, player: str, skip_roles: tuple[str, ...] = ()) -> DataFrame | None:
        """Values of an object type over every role it plays outside sample populations.

        ``skip_roles`` leaves out roles whose values the caller already has.
        """
        parts = [
            self.role_values(role.id, include_samples=False)
            for ft in self.fact_types.values()
            for role in ft.roles
            if role.player == player and role.id not in skip_roles
        ]
        parts = [p for p in parts if p is not None]
        return reduce(lambda a, b: a.union(b), parts) if parts else None

    def long_form(self) -> DataFrame:
        """Every filled role of every instance as one row (fact_type_id, pop_id, inst_id, role_id, player_id, value, sample)."""
        parts = []
        for ft in self.fact_types.values():
            rows = self.rows(ft.id)
            if rows is None:
                continue
            cells = F.array(*[
                F.struct(F.lit(r.id).alias("role_id"), F.lit(r.player).alias("player_id"), F.col(r.id).cast("string").alias("value"))
                for r in ft.roles
            ])
            parts.append(
                rows.select(F.lit(ft.id).alias("fact_type_id"), "pop_id", "inst_id", "sample", F.inline(cells))
                .filter(F.col("value").isNotNull())
            )
        return reduce(lambda a, b: a.unionByName(b), parts)

    def populations(self) -> DataFrame:
        """(fact_type_id, pop_id, sample, instances) of everything bound."""
        parts = [
            self.rows(ft).groupBy(F.lit(ft).alias("fact_type_id"), "pop_id", "sample").agg(F.count("*").alias("instances"))
            for ft in self.fact_types
            if self.has_rows(ft)
        ]
        return reduce(lambda a, b: a.unionByName(b), parts)
