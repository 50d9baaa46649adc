"""Candidate models from column tests and from table definitions, for all projects at once.

Both yield the same kinds of rows: fact types of a project with their two players, and the constraints on their roles.
A table or model is found by its name within its project, by joins; nothing is walked one model at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.naming import conceptual_type, to_pascal
from factloom.plans.session import materialize

# Types that table definitions have besides the usual ones.
DEFINED_TYPES = {"^(SERIAL|AUTOINCREMENT|IDENTITY)": "auto_counter", "^MONEY": "money"}
# Beginnings of a column name that are a verb.
VERBS = ("assigned", "created", "updated", "owned", "managed")
# The parts of a table definition.
CREATE_TABLE = r'(?is)\bCREATE\s+TABLE\s+"?(\w+)"?\s*\((.*)\)'
COLUMN = r'(?is)^"?(\w+)"?\s+(\w+)(?:\([\d,\s]+\))?(?:\s+(?:NOT\s+NULL|NULL|PRIMARY\s+KEY|UNIQUE))*$'
TABLE_KEY = r"(?i)^PRIMARY\s+KEY\s*\("
TABLE_UNIQUE = r"(?i)^UNIQUE\s*\("
TABLE_REFERENCE = r"(?i)^FOREIGN\s+KEY\s*\("
REFERENCE = r'(?i)FOREIGN\s+KEY\s*\((.*?)\)\s*REFERENCES\s+"?(\w+)"?\s*\((.*?)\)'
LEVELS = 6  # brackets within brackets that a part of a definition may hold


@dataclass
class CandidateModel:
    fact_types: DataFrame  # project, source, column, kind, fact_type, first_player, second_player
    constraints: DataFrame  # project, source, column, ord, type, role (0 or 1), allowed
    report: DataFrame  # project, source, severity, category, column


def _camel(name: Column) -> Column:
    pascal = to_pascal(name)
    head = F.split(name, "_")[0]
    return F.concat(F.lower(head), F.substr(pascal, F.length(head) + 1))


def _offer(type_: str, role: Column | int, allowed: Column | None = None) -> Column:
    role = F.lit(role) if isinstance(role, int) else role
    return F.struct(F.lit(type_).alias("type"), role.cast("int").alias("role"), (F.lit(None).cast("array<string>") if allowed is None else allowed).alias("allowed"))


def _constraints(facts: DataFrame, offers: list[tuple[Column, Column]]) -> DataFrame:
    """The offers whose condition holds, numbered in their order."""
    kept = F.array_compact(F.array(*[F.when(test, offer) for test, offer in offers]))
    return facts.select("project", "source", "column", F.posexplode(kept).alias("ord", "c")).select("project", "source", "column", "ord", "c.*")


# ---- column tests -----------------------------------------------------------------------------------------

def tested_model(columns: DataFrame, tests: DataFrame) -> CandidateModel:
    """Entity types from models with an identifier, fact types from their other columns, constraints from column tests.

    ``columns`` (project, model, column, column_pos); ``tests`` (project, model, column, test_pos, test, to, field, values): a row
    per test, ``values`` those of accepted_values. The first column both unique and not_null identifies a model; models
    without one give no fact types. A column that references a model of the project is a fact between two entities.
    Every other column has at most one value per entity; not_null makes it mandatory, unique makes a value belong to one
    entity, accepted_values restrict it. An empty list of values is reported and restricts nothing.
    """
    key = ["project", "model", "column"]

    def first(test: str, value: Column) -> Column:
        return F.min_by(F.when(F.col("test") == test, value), F.when(F.col("test") == test, F.col("test_pos")))

    known = tests.filter("column IS NOT NULL").groupBy(*key).agg(
        F.max(F.col("test") == "unique").alias("unique"), F.max(F.col("test") == "not_null").alias("not_null"),
        first("relationships", F.struct("to", "field")).alias("reference"), first("accepted_values", F.coalesce("values", F.array().cast("array<string>"))).alias("allowed"))
    cells = columns.select(*key, "column_pos").join(known, key, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in ("unique", "not_null")})
    cells = materialize(cells, "tested-columns")
    identifiers = cells.filter("unique AND not_null").groupBy("project", "model").agg(F.min_by("column", "column_pos").alias("identifier"))
    rest = cells.join(identifiers, ["project", "model"]).filter("column <> identifier")
    targets = identifiers.select("project", F.col("model").alias("to"), F.lit(True).alias("there"))
    placed = rest.withColumn("to", F.col("reference.to")).join(targets, ["project", "to"], "left").withColumnRenamed("model", "source")
    placed = materialize(placed.withColumn("kind", F.when(F.col("to").isNull(), "value").when(F.col("there"), "reference").otherwise("lost")), "tested-facts")

    facts = placed.filter("kind <> 'lost'")
    entity, other = to_pascal(F.col("source")), F.when(F.col("kind") == "value", to_pascal(F.col("column"))).otherwise(to_pascal(F.col("to")))
    value = F.col("kind") == "value"
    fact_types = facts.select("project", "source", "column", "kind", F.concat(entity, F.lit(" has "), other).alias("fact_type"),
                              F.when(value, entity).otherwise(other).alias("first_player"), F.when(value, other).otherwise(entity).alias("second_player"))
    own = F.when(value, 0).otherwise(1)  # the role that each entity plays once
    constraints = _constraints(facts, [
        (F.lit(True), _offer("internal_uniqueness", own)), (F.col("not_null"), _offer("mandatory", own)),
        (value & F.col("unique"), _offer("internal_uniqueness", 1)), (value & (F.size("allowed") > 0), _offer("value_constraint", 1, F.col("allowed")))])

    def told(rows: DataFrame, severity: str, category: str) -> DataFrame:
        return rows.select("project", "source", F.lit(severity).alias("severity"), F.lit(category).alias("category"), "column")

    report = [told(placed.filter("kind = 'value' AND size(allowed) = 0"), "warning", "constraint"), told(placed.filter("kind = 'lost'"), "gap", "relationship"),
              told(placed.filter("kind = 'reference'"), "info", "relationship")]
    return CandidateModel(fact_types, constraints, reduce(lambda a, b: a.unionByName(b), report))


# ---- table definitions --------------------------------------------------------------------------------------

def _part_pattern() -> str:
    """A part of a definition: all up to a comma outside brackets. Possessive, so it is read once."""
    inside = "[^()]*+"
    for _ in range(LEVELS - 1):
        inside = rf"[^()]*+(?:\({inside}\)[^()]*+)*+"
    return rf"(?:[^,()]|\({inside}\))++"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _listed(text: Column) -> Column:
    names = F.transform(F.split(text, ","), lambda c: F.regexp_replace(_trim(c), '"', ""))
    return F.filter(names, lambda c: c != "")


def defined_tables(statements: DataFrame, project: str = "project") -> DataFrame:
    """CREATE TABLE statements (project, file_path, statement, sql) -> a row per table with its columns, key, unique sets and references.

    (project, file_path, statement, source, columns ARRAY<STRUCT<pos, column, data_type, nullable>>, key, uniques, references). Parts that are
    neither a table constraint nor a plain column are left out. The last statement of a key counts.
    """
    found = statements.filter(F.col("sql").rlike(CREATE_TABLE)).select(
        F.col(project).alias("project"), "file_path", "statement", F.regexp_extract("sql", CREATE_TABLE, 1).alias("source"),
        F.transform(F.regexp_extract_all(F.regexp_extract("sql", CREATE_TABLE, 2), F.lit(_part_pattern()), 0), _trim).alias("parts"))
    within = lambda p: _listed(F.regexp_extract(p, r"\((.*?)\)", 1))
    marked = F.transform("parts", lambda p: F.struct(
        F.when(p.rlike(TABLE_KEY), "key").when(p.rlike(TABLE_UNIQUE), "unique").when(p.rlike(TABLE_REFERENCE), "reference").when(p.rlike(COLUMN), "column").alias("is"), p.alias("p")))
    parts = found.withColumn("parts", F.filter(marked, lambda x: x["is"].isNotNull()))
    plain = F.filter("parts", lambda x: x["is"] == "column")
    columns = F.transform(plain, lambda x, i: F.struct(
        i.alias("pos"), F.regexp_extract(x["p"], COLUMN, 1).alias("column"), F.upper(F.regexp_extract(x["p"], COLUMN, 2)).alias("data_type"), (~x["p"].rlike(r"(?i)NOT\s+NULL")).alias("nullable")))
    keys = F.filter(F.transform("parts", lambda x: F.when(x["is"] == "key", within(x["p"])).when(
        (x["is"] == "column") & x["p"].rlike(r"(?i)PRIMARY\s+KEY"), F.array(F.regexp_extract(x["p"], COLUMN, 1)))), lambda k: k.isNotNull())
    uniques = F.transform(F.filter("parts", lambda x: x["is"] == "unique"), lambda x: within(x["p"]))
    references = F.transform(F.filter("parts", lambda x: (x["is"] == "reference") & x["p"].rlike(REFERENCE)), lambda x: F.struct(
        _listed(F.regexp_extract(x["p"], REFERENCE, 1)).alias("columns"), F.regexp_extract(x["p"], REFERENCE, 2).alias("to"), _listed(F.regexp_extract(x["p"], REFERENCE, 3)).alias("fields")))
    empty = F.array().cast("array<string>")
    return parts.select("project", "file_path", "statement", "source", columns.alias("columns"), F.coalesce(F.element_at(F.when(F.size(keys) > 0, keys), -1), empty).alias("key"),
                        uniques.alias("uniques"), references.alias("references"))


def entity_types(tables: DataFrame) -> DataFrame:
    """(project, source, entity, reference_mode): the key column where there is exactly one, else the table's name with _id."""
    mode = F.when(F.size("key") == 1, F.col("key")[0]).otherwise(F.concat("source", F.lit("_id")))
    return tables.select("project", "source", to_pascal(F.col("source")).alias("entity"), mode.alias("reference_mode"))


def _verb(column: Column, target: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(column, "(?i)_id$", ""), "(?i)_fk$", "")
    head = F.regexp_extract(base, r"^(\w+)_", 1)
    return F.when(F.lower(head).isin(*VERBS), F.concat(head, F.lit(" to"))).when(base == F.lower(target), "references").otherwise(_camel(base))


def defined_model(tables: DataFrame) -> CandidateModel:
    """Fact types and constraints of the columns of defined tables (``defined_tables``); key columns identify their entity.

    A column of a reference whose table is defined in the project is a fact between two entities; where that table is not
    defined the column is reported and left out. Every other column is a value of its entity. A table set of unique columns
    names each of its columns unique.
    """
    cells = tables.select("project", "source", "key", "uniques", "references", F.inline("columns")).filter(~F.array_contains("key", F.col("column")))
    reference = F.get(F.filter("references", lambda r: F.array_contains(r["columns"], F.col("column"))), F.lit(0))
    cells = cells.withColumn("to", reference["to"]).withColumn("unique", F.exists("uniques", lambda u: F.array_contains(u, F.col("column"))))
    known = tables.select("project", F.col("source").alias("to"), F.lit(True).alias("there")).distinct()
    placed = cells.join(known, ["project", "to"], "left").withColumn("kind", F.when(F.col("to").isNull(), "value").when(F.col("there"), "reference").otherwise("lost"))
    placed = materialize(placed.drop("uniques", "references", "key"), "defined-columns")

    facts = placed.filter("kind <> 'lost'")
    value = F.col("kind") == "value"
    entity, target = to_pascal(F.col("source")), to_pascal(F.col("to"))
    name = F.when(value, F.concat(entity, F.lit(" has "), to_pascal(F.col("column")))).otherwise(F.concat_ws(" ", entity, _verb(F.col("column"), target), target))
    fact_types = facts.select(
        "project", "source", "column", "kind", name.alias("fact_type"), F.when(value, to_pascal(F.col("column"))).otherwise(target).alias("first_player"), entity.alias("second_player"),
        F.when(value, conceptual_type(F.col("data_type"), DEFINED_TYPES)).alias("data_type"))
    constraints = _constraints(facts, [
        (F.lit(True), _offer("internal_uniqueness", F.when(value & ~F.col("unique"), 0).otherwise(1))), (~F.col("nullable"), _offer("mandatory", F.when(value, 0).otherwise(1)))])
    report = placed.filter("kind = 'lost'").select("project", "source", F.lit("gap").alias("severity"), F.lit("relationship").alias("category"), "column")
    return CandidateModel(fact_types, constraints, report)


# ---- source code --------------------------------------------------------------------------------------------

# Names and endings of types that are no concepts.
UTILITY_TYPES = (
    "Props", "State", "Config", "Options", "Params", "Args", "Result", "Response", "Request", "Error", "Event", "Handler", "Callback", "Listener", "Logger", "Context",
    "Middleware", "Controller", "Service", "Repository", "Dto", "DTO", "Mapper", "Builder", "Factory", "Exception", "Application",
)
UTILITY_ENDINGS = ("Props", "Config", "Controller", "Service", "Repository", "Dto", "DTO", "Mapper", "Exception")
# Annotations that relate two classes, and those to be looked at by a person.
RELATING = ("ManyToOne", "OneToOne")
REVIEWED = ("NotNull", "NotBlank", "NotEmpty", "Size", "Min", "Max", "Pattern", "Column")


@dataclass
class SourceModel:
    object_types: DataFrame  # repo_id, name, kind, reference_mode, allowed
    fact_types: DataFrame  # repo_id, fact_type, first_player, second_player
    review: DataFrame  # repo_id, path, line, annotation, class_name, target, parameters


def _concept(name: Column) -> Column:
    """A field's name as a type's: words apart by - or _ joined, each with a capital."""
    return F.array_join(F.transform(F.split(name, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def source_model(types: DataFrame, annotations: DataFrame, transitions: DataFrame) -> SourceModel:
    """Candidate types and facts of every repository from what its sources show.

    ``types``, ``annotations`` and ``transitions`` are rows of ``source_mining``. Of a name found several times the first counts, in
    this order: enums with members (values), classes marked as entities, other classes and interfaces that are no mere
    helpers (entities), aliases of quoted alternatives (values), fields that a switch walks through (values); within each by
    path and kind. An entity is identified by its first field marked as id, else by a member named id or like the
    type with Id, else by its name with _id. A marked relation to a field whose name is a type's is a fact.
    """
    text, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def offered(df: DataFrame, name: Column | str, rank: int, kind: str, allowed: Column, at: Column) -> DataFrame:
        name = F.col(name) if isinstance(name, str) else name
        return df.select("repo_id", name.alias("name"), F.struct(F.lit(rank).alias("rank"), at.alias("at")).alias("order"), F.lit(kind).alias("kind"), allowed.alias("allowed"))

    place = F.struct(F.col("path"), F.col("kind").alias("part"))
    having = F.size("members") > 0
    helper = F.col("name").isin(*UTILITY_TYPES) | reduce(lambda a, b: a | b, [F.endswith("name", F.lit(e)) for e in UTILITY_ENDINGS])
    steps = transitions.groupBy("repo_id", "state_field", "path", "start_line").agg(F.array_sort(F.collect_list(F.struct("step", "from", "to"))).alias("s"))
    walked = F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(x["from"], x["to"]))))
    marked = annotations.filter("annotation = 'Entity' AND target_kind = 'class'")
    line = lambda column: F.struct(F.col("path"), F.lpad(F.col(column).cast("string"), 12, "0").alias("part"))
    names = reduce(lambda a, b: a.unionByName(b), [
        offered(types.filter(F.col("kind") == "enum").filter(having), "name", 0, "value", F.col("members"), place),
        offered(marked, "target", 1, "entity", texts, line("line")),
        offered(types.filter(F.col("kind").isin("interface", "class")).filter(~helper), "name", 2, "entity", texts, place),
        offered(types.filter(F.col("kind") == "type_alias").filter(having), "name", 3, "value", F.col("members"), place),
        offered(steps, _concept(F.col("state_field")), 4, "value", walked, line("start_line"))])
    first = names.groupBy("repo_id", "name").agg(F.min_by(F.struct("kind", "allowed"), "order").alias("t")).select("repo_id", "name", "t.*")
    known = materialize(first, "source-types")

    members = types.groupBy("repo_id", "name").agg(F.min_by("members", place).alias("members"))
    ids = annotations.filter("annotation = 'Id'").groupBy("repo_id", F.col("class_name").alias("name")).agg(F.min_by("target", F.struct("path", "line")).alias("id"))
    own = F.concat(F.lower(F.substring("name", 1, 1)), F.substr("name", F.lit(2)), F.lit("Id"))
    snake = F.concat(F.regexp_replace(F.lower(F.regexp_replace("name", "([A-Z])", "_$1")), "^_", ""), F.lit("_id"))
    mode = F.coalesce("id", F.when(F.array_contains("members", F.lit("id")), "id").when(F.array_contains("members", own), own), snake)
    object_types = known.join(members, ["repo_id", "name"], "left").join(ids, ["repo_id", "name"], "left").select(
        "repo_id", "name", "kind", F.when(F.col("kind") == "entity", mode).otherwise(text).alias("reference_mode"), "allowed")

    there = known.select("repo_id", "name")
    related = annotations.filter(F.col("annotation").isin(*RELATING)).select("repo_id", F.col("class_name").alias("first_player"), _concept(F.col("target")).alias("second_player")).distinct()
    facts = (
        related.filter("first_player <> second_player").join(there.withColumnRenamed("name", "first_player"), ["repo_id", "first_player"], "left_semi")
        .join(there.withColumnRenamed("name", "second_player"), ["repo_id", "second_player"], "left_semi"))
    fact_types = facts.select("repo_id", F.concat_ws(" has ", "first_player", "second_player").alias("fact_type"), "first_player", "second_player")
    review = annotations.filter(F.col("annotation").isin(*REVIEWED)).select("repo_id", "path", "line", "annotation", "class_name", "target", "parameters")
    return SourceModel(object_types, fact_types, review)
