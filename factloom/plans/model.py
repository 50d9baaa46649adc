"""Declarations: object types, fact types, roles and constraints (plain metadata, never data)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ObjectType:
    id: str
    name: str
    kind: str = "entity"
    min: int | None = None
    max: int | None = None


@dataclass(frozen=True)
class Role:
    id: str
    player: str


@dataclass(frozen=True)
class FactType:
    id: str
    name: str
    roles: tuple[Role, ...]

    def has(self, role_id: str) -> bool:
        return any(r.id == role_id for r in self.roles)


@dataclass(frozen=True)
class ValueRange:
    min: str | None = None
    max: str | None = None
    min_inclusive: bool = True
    max_inclusive: bool = True


@dataclass(frozen=True)
class JoinOperand:
    """A role path: root object type, (entry role, exit role) hops, and the projected node numbers."""

    root: str
    steps: tuple[tuple[str, str], ...]
    projection: tuple[int, ...]


@dataclass(frozen=True)
class Constraint:
    """One declared constraint; which fields matter depends on ``kind``."""

    id: str
    kind: str
    fact_type: str = ""
    roles: tuple[str, ...] = ()
    roles2: tuple[str, ...] = ()
    modality: str = "alethic"
    values: tuple[str, ...] = ()
    ranges: tuple[ValueRange, ...] = ()
    operator: str = "="
    min: int = 1
    max: int | None = None
    ring: str = ""
    operands: tuple[JoinOperand, ...] = field(default=())

    @property
    def severity(self) -> str:
        return "warning" if self.modality == "deontic" else "error"
