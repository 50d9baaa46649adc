"""Catalog tables: model metadata as DataFrames keyed by ``model_id``, many models in one catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from factloom.plans.session import materialize, materialize_by

# The columns of every catalog table.
SCHEMAS = {
    "object_types": "model_id BIGINT, object_type_id STRING, name STRING, kind STRING, reference_mode STRING, definition STRING, data_type STRING, length INT, scale INT, aliases ARRAY<STRING>, allowed ARRAY<STRING>, independent BOOLEAN, seq BIGINT",
    "fact_types": "model_id BIGINT, fact_type_id STRING, name STRING, derivation_kind STRING, derivation_rule STRING, derivation_storage STRING, seq BIGINT",
    "roles": "model_id BIGINT, fact_type_id STRING, role_id STRING, pos INT, name STRING, player_id STRING",
    "readings": "model_id BIGINT, fact_type_id STRING, pos INT, template STRING",
    "constraints": "model_id BIGINT, fact_type_id STRING, ord INT, constraint_id STRING, type STRING, modality STRING, role_ids ARRAY<STRING>, role_ids_2 ARRAY<STRING>, min INT, max INT, ring_type STRING, operator STRING, allowed ARRAY<STRING>, is_preferred BOOLEAN",
    "operands": "model_id BIGINT, fact_type_id STRING, constraint_id STRING, type STRING, operand INT, root STRING, steps ARRAY<STRUCT<entry: STRING, exit: STRING>>, projection ARRAY<INT>",
    "subtype_facts": "model_id BIGINT, subtype_fact_id STRING, subtype_id STRING, supertype_id STRING, provides_identification BOOLEAN, derivation_kind STRING, derivation_rule STRING",
    "objectified": "model_id BIGINT, objectified_id STRING, fact_type_id STRING, object_type_id STRING, seq BIGINT",
    "populations": "model_id BIGINT, pop_id STRING, fact_type_id STRING, sample BOOLEAN",
}


@dataclass
class Catalog:
    object_types: DataFrame
    fact_types: DataFrame
    roles: DataFrame
    readings: DataFrame
    constraints: DataFrame
    operands: DataFrame
    subtype_facts: DataFrame
    objectified: DataFrame
    populations: DataFrame

    @property
    def buckets(self) -> int | None:
        """How many buckets by model the tables are stored in; None if they are not."""
        return None

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows with a model_id as the tables are dealt, for unions and others that no longer are."""
        return df.repartition(self.buckets, "model_id") if self.buckets else df

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Intermediate rows, dealt by model, stored as the tables are."""
        return materialize_by(df, name, "model_id", self.buckets) if self.buckets else materialize(df, name)

    def write(self, path: str, format: str = "parquet") -> None:
        for field in fields(self):
            getattr(self, field.name).write.format(format).mode("overwrite").save(f"{path}/{field.name}")


class LazyCatalog(Catalog):
    """A catalog whose tables are made when they are first asked for, so a query stores only those it reads."""

    def __init__(self, make: Callable[[str], DataFrame], buckets: int | None = None):
        self._make, self._buckets = make, buckets

    @property
    def buckets(self) -> int | None:
        return self._buckets

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = self._make(name)
        setattr(self, name, table)
        return table


def with_tables(cat: Catalog, make: Callable[[str], DataFrame], *names: str) -> Catalog:
    """cat with other tables of these names, made when they are first asked for."""
    return LazyCatalog(lambda name: make(name) if name in names else getattr(cat, name), cat.buckets)


def read_catalog(spark: SparkSession, path: str, format: str = "parquet") -> Catalog:
    """Element tables from ``path/<table>``, with explicit schemas (no inference pass over the files)."""
    return Catalog(**{
        name: spark.read.format(format).schema(schema).load(f"{path}/{name}") for name, schema in SCHEMAS.items()
    })
