"""Tables to facts and facts to tables: the data side of the relational mapping, and its sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.naming import to_pascal
from factloom.plans.factset import FactSet


def value_facts(df: DataFrame, entity: str, key: str, columns: list[str]) -> DataFrame:
    """"Entity has Column" facts of every value column: (fact_type, entity_id, value), one pass over the table."""
    cells = F.array(*[F.struct(F.concat(to_pascal(F.lit(entity)), F.lit(" has "), to_pascal(F.lit(c))).alias("fact_type"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.col(key).cast("string").alias("entity_id"), F.inline(cells))
    return rows.filter(F.col("value").isNotNull()).select("fact_type", "entity_id", "value")


def reference_facts(df: DataFrame, entity: str, key: str, references: dict[str, str]) -> DataFrame:
    """"Entity has Target" facts of foreign key columns (column -> target entity): (fact_type, target_id, entity_id)."""
    parts = [
        df.filter(F.col(c).isNotNull()).select(
            F.concat(to_pascal(F.lit(entity)), F.lit(" has "), to_pascal(F.lit(target))).alias("fact_type"),
            F.col(c).cast("string").alias("target_id"), F.col(key).cast("string").alias("entity_id"))
        for c, target in references.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def associative_rows(facts: FactSet, fact_type: str, columns: dict[str, str]) -> DataFrame:
    """Instances of a fact type as table rows; ``columns`` maps role to column. Rows without any value are left out."""
    rows = facts.rows(fact_type).select(*[F.col(role).alias(name) for role, name in columns.items()])
    return rows.dropna(how="all")


def entity_rows(facts: FactSet, entity: str, key: str, values: dict[str, tuple[str, str]], flags: dict[str, str]) -> DataFrame:
    """One row per known object: key, value and reference columns, and booleans for unary facts.

    ``values`` maps column -> (key role, value role), ``flags`` column -> role. All
    facts meet in one aggregate keyed by the object: one shuffle whatever the
    number of columns, where a chain of left joins would take one each. Of
    several values the first in order is kept.
    """
    parts = []
    for name, (key_role, value_role) in values.items():
        ft = facts.role(key_role)[0]
        rows = facts.rows(ft.id).filter(F.col(key_role).isNotNull() & F.col(value_role).isNotNull())
        # the first value per object before the shapes are put side by side
        rows = rows.groupBy(F.col(key_role).cast("string").alias(key)).agg(F.min_by(F.col(value_role).cast("string"), F.struct("ord", "inst_id")).alias(name))
        parts.append(rows)
    for name, role in flags.items():
        parts.append(facts.role_values(role).distinct().select(F.col("value").alias(key), F.lit(True).alias(name)))
    parts.append(facts.universe(entity).distinct().select(F.col("value").alias(key)))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy(key).agg(
        *[F.max(n).alias(n) for n in values], *[F.coalesce(F.max(n), F.lit(False)).alias(n) for n in flags])


def first_example(facts: FactSet, fact_type: str, names: dict[str, str]) -> DataFrame:
    """JSON of the first instance of a fact type, missing values left out; ``names`` maps role to field."""
    record = F.to_json(F.struct(*[F.col(role).cast("string").alias(name) for role, name in names.items()]))
    return facts.rows(fact_type).agg(F.min_by(record, F.struct("pop_id", "ord", "inst_id")).alias("example"))


def write_seed(df: DataFrame, path: str) -> None:
    """CSV seed files: header, quotes where needed, nothing for missing values."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_history(runs: DataFrame, path: str) -> None:
    """Append runs as JSON lines."""
    runs.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
