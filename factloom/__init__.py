"""factloom: constraint checking, catalog queries and corpus mining for tables read as business facts."""

from factloom.plans.model import Constraint, FactType, JoinOperand, ObjectType, Role, ValueRange
from factloom.plans.factset import FactSet

__all__ = ["Constraint", "FactSet", "FactType", "JoinOperand", "ObjectType", "Role", "ValueRange"]
