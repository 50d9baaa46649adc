"""Registry of the queries exposed by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.plans.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The provided tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(tune(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


FLAT = ("rule_id", "severity", "element_id", "constraint_id", "fact_type_id", "pop_id", "inst_id")


def flat(violations: DataFrame, *details: str) -> DataFrame:
    """Violations with plain columns; the subject parts joined by '|', chosen detail entries as columns."""
    return violations.select(
        *FLAT, F.array_join("subject", "|", "").alias("subject"),
        *[F.col("detail")[d].alias(d) for d in details])


def flat_sql(rule: str, body: str, subject: str, *, severity: str = "'error'", element: str = "NULL", constraint: str = "NULL",
             fact_type: str = "NULL", pop: str = "NULL", inst: str = "NULL", extra: str = "") -> str:
    """SELECT list of :func:`flat` for the SQL side; arguments are SQL expressions, rule a plain name."""
    rule = rule if rule.startswith("(") else f"'{rule}'"
    return f"""SELECT {rule} AS rule_id, CAST({severity} AS VARCHAR) AS severity, CAST({element} AS VARCHAR) AS element_id,
  CAST({constraint} AS VARCHAR) AS constraint_id, CAST({fact_type} AS VARCHAR) AS fact_type_id,
  CAST({pop} AS VARCHAR) AS pop_id, CAST({inst} AS VARCHAR) AS inst_id, CAST({subject} AS VARCHAR) AS subject{extra}
{body}"""
