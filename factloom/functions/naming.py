"""Scalar functions on names, types and texts, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def to_snake(name: Column) -> Column:
    split = F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(split, r"[\s-]+", "_"))


def to_pascal(name: Column) -> Column:
    words = F.transform(
        F.split(name, "_"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))),
    )
    return F.array_join(words, "")


def reference_mode_suffix(mode: Column, type_name: Column) -> Column:
    """What a reference mode adds to its type's name; the whole mode when it does not start with the name."""
    prefix = F.regexp_replace(F.lower(type_name), r"\s+", "_")
    suffix = F.substr(mode, F.length(prefix) + 1)
    return F.when(mode == "", F.lit(None)).when(F.startswith(F.lower(mode), prefix), suffix).otherwise(mode)


def _first_match(text: Column, table: dict[str, str], default: str | None) -> Column:
    result = F.lit(default)
    for pattern, name in reversed(table.items()):
        result = F.when(text.rlike(pattern), name).otherwise(result)
    return result


# SQL type patterns in order of precedence, and the conceptual type of each.
CONCEPTUAL_TYPES = {
    "^(VARCHAR|CHAR|TEXT|STRING|NVARCHAR)": "text",
    "^(INT|INTEGER|BIGINT|SMALLINT|TINYINT)": "integer",
    "^(DECIMAL|NUMERIC|NUMBER)": "decimal",
    "^(REAL|FLOAT|DOUBLE)": "float",
    "^(BOOL|BOOLEAN)": "boolean",
    "^DATE$": "date",
    "^TIME$": "time",
    "^(DATETIME|TIMESTAMP)": "datetime",
    "^(BLOB|BINARY|BYTEA)": "binary",
    "^UUID": "uuid",
}
# SQL names of conceptual types that take no length.
PLAIN_SQL_TYPES = {
    "integer": "INTEGER", "auto_counter": "INTEGER", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE",
    "time": "TIME", "datetime": "DATETIME", "timestamp": "TIMESTAMP", "uuid": "UUID",
}
# First keyword of a statement and its kind.
STATEMENT_KINDS = {
    "^(SELECT|WITH)": "select", "^CREATE": "create", "^ALTER": "alter",
    "^INSERT": "insert", "^UPDATE": "update", "^DELETE": "delete",
}
# Names accepted in a dialect comment.
DIALECTS = {
    "snowflake": "snowflake", "bigquery": "bigquery", "postgres": "postgres", "postgresql": "postgres",
    "mysql": "mysql", "redshift": "redshift", "databricks": "databricks",
}
# Syntax hints in order of precedence, and the dialect each points to.
DIALECT_HINTS = {
    r"(?i)set\s+search_path": "postgres",
    r"(?i)create\s+or\s+replace\s+stage": "snowflake",
    r"(?i)qualify\s+": "snowflake",
    r"(?i)create\s+temp\s+function": "bigquery",
    r"(?i)struct\s*<": "bigquery",
}
# Message patterns in order of precedence, and the class of error each means.
ERROR_CLASSES = {
    r"(?i)\brate limit|\btoo many requests|\boverloaded\b|\bquota\b": "rate_limit",
    r"(?i)\bapi key\b|\bauthentication\b|\bunauthorized\b|\bpermission\b": "auth",
    r"(?i)\btimeout\b|\btimed out\b|ECONNRESET|ECONNREFUSED|ETIMEDOUT|ENOTFOUND": "network",
}


def conceptual_type(sql_type: Column, more: dict[str, str] | None = None) -> Column:
    """Conceptual type of a SQL type; ``more`` adds patterns of a dialect."""
    return _first_match(F.upper(sql_type), CONCEPTUAL_TYPES | (more or {}), "other")


def sql_type(name: Column, length: Column, scale: Column) -> Column:
    """SQL type text of a conceptual type. A length of zero counts as none."""
    size = F.when(length != 0, length).cast("string")
    scale_text = scale.cast("string")
    decimal = (
        F.when(size.isNotNull() & scale.isNotNull(), F.concat(F.lit("DECIMAL("), size, F.lit(","), scale_text, F.lit(")")))
        .when(size.isNotNull(), F.concat(F.lit("DECIMAL("), size, F.lit(")")))
        .otherwise("DECIMAL")
    )
    money = F.when(
        size.isNotNull(), F.concat(F.lit("DECIMAL("), size, F.lit(","), F.coalesce(scale_text, F.lit("2")), F.lit(")"))
    ).otherwise("DECIMAL(19,2)")
    plain = reduce(lambda acc, kv: F.when(name == kv[0], kv[1]).otherwise(acc), PLAIN_SQL_TYPES.items(), F.lit("TEXT"))
    return (
        F.when(name == "text", F.coalesce(F.concat(F.lit("VARCHAR("), size, F.lit(")")), F.lit("TEXT")))
        .when(name == "decimal", decimal)
        .when(name == "money", money)
        .when(name == "binary", F.coalesce(F.concat(F.lit("BINARY("), size, F.lit(")")), F.lit("BLOB")))
        .otherwise(plain)
    )


def expand_reading(template: Column, players: Column) -> Column:
    """``{0} places {1}`` with the role players' names put in; numbers beyond the list stay as they are."""
    # the players' own text must not be expanded again, so braces in names are masked while replacing
    indexed = F.transform(players, lambda name, i: F.struct(i.alias("i"), F.replace(name, F.lit("{"), F.lit("\u0001")).alias("name")))
    expanded = F.aggregate(
        indexed, template,
        lambda text, p: F.replace(text, F.concat(F.lit("{"), p["i"].cast("string"), F.lit("}")), p["name"]),
    )
    return F.replace(expanded, F.lit("\u0001"), F.lit("{"))


def statement_kind(sql: Column) -> Column:
    return _first_match(F.upper(F.regexp_replace(sql, r"^\s+", "")), STATEMENT_KINDS, "other")


def sql_dialect(sql: Column) -> Column:
    """Dialect named in a comment of the first five lines, else the first syntax hint, else NULL."""
    head = F.lower(F.substring_index(sql, "\n", 5))
    named = F.regexp_extract(head, r"--\s*dialect:\s*(\w+)", 1)
    known = reduce(lambda acc, kv: F.when(named == kv[0], kv[1]).otherwise(acc), DIALECTS.items(), F.lit(None).cast("string"))
    return F.coalesce(known, _first_match(sql, DIALECT_HINTS, None))


def error_class(message: Column) -> Column:
    return _first_match(message, ERROR_CLASSES, "other")


def content_hash(*columns: Column) -> Column:
    """SHA-256 over the row's fields in the given order, as JSON with missing fields kept apart from empty ones."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"f{i}") for i, c in enumerate(columns)])), 256)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the shorter list that the two lists have in common; 0 when either is missing or empty."""
    shared = F.size(F.filter(a, lambda v: F.array_contains(b, v)))
    smaller = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / smaller).otherwise(0.0)
