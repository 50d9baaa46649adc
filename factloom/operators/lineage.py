"""Lineage between models and the artifacts made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.mapping import Relational
from factloom.operators.sequences import extreme_rows
from factloom.sources.catalog import SCHEMAS, Catalog

KEY = ["model_id", "fact_type_id"]
# How a source element of each type relates to an artifact.
RELATIONSHIPS = {
    "EntityType": "derived from entity type ", "ValueType": "uses value type ", "FactType": "derived from fact type ",
    "Constraint": "enforces constraint ", "SubtypeFact": "involves subtype relationship ", "Role": "includes role ",
}
# Label of a constraint kind, and whether the fact type's name follows.
CONSTRAINT_LABELS = {
    "internal_uniqueness": ("UC: ", True), "mandatory": ("Mandatory: ", True), "external_uniqueness": ("External UC: ", True),
    "value_constraint": ("Value: ", True), "disjunctive_mandatory": ("Disjunctive Mandatory", False), "exclusion": ("Exclusion: ", True),
    "exclusive_or": ("Exclusive-Or", False), "frequency": ("Frequency: ", True), "ring": ("Ring: ", True), "subset": ("Subset", False), "equality": ("Equality", False),
}


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _source(df: DataFrame, artifact: str, id_: str, type_: Column, name: Column) -> DataFrame:
    return df.select("model_id", F.col(artifact).alias("artifact"), F.col(id_).alias("element_id"), type_.alias("element_type"), name.alias("element_name"))


def _kind_name(kind: Column) -> Column:
    return F.when(kind == "entity", "EntityType").otherwise("ValueType")


def _constraint_name(kind: Column, fact_name: Column) -> Column:
    label = F.concat(F.lit("Constraint: "), fact_name)
    for name, (text, named) in CONSTRAINT_LABELS.items():
        label = F.when(kind == name, F.concat(F.lit(text), fact_name) if named else F.lit(text)).otherwise(label)
    return label


def _fact_sources(cat: Catalog, uses: DataFrame, values_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources behind ``uses`` (model_id, artifact, fact_type_id): the fact types, their roles and players."""
    facts = uses.join(cat.fact_types.select(*KEY, "name"), KEY)
    roles = facts.select("model_id", "artifact", "fact_type_id").join(cat.roles.select(*KEY, "role_id", F.col("name").alias("role_name"), "player_id"), KEY)
    players = roles.join(cat.object_types.select("model_id", F.col("object_type_id").alias("player_id"), "kind", F.col("name").alias("player")), ["model_id", "player_id"])
    if values_only:
        players = players.filter("kind = 'value'")
    return (
        _source(facts, "artifact", "fact_type_id", F.lit("FactType"), F.col("name")),
        _source(roles, "artifact", "role_id", F.lit("Role"), F.col("role_name")),
        _source(players, "artifact", "player_id", _kind_name(F.col("kind")), F.col("player")),
    )


def table_lineage(cat: Catalog, schema: Relational) -> DataFrame:
    """Sources of every table (model_id, artifact, element_id, element_type, element_name); the artifact is the table id."""
    tables = schema.tables.select("model_id", F.col("table_id").alias("artifact"))
    objects = cat.object_types.select("model_id", F.col("object_type_id").alias("artifact"), "kind", "name")
    facts = cat.fact_types.select("model_id", F.col("fact_type_id").alias("artifact"), "name")
    by_role = schema.columns.filter("source_role_id IS NOT NULL").select("model_id", F.col("table_id").alias("artifact"), F.col("source_role_id").alias("role_id")).join(
        cat.roles.select(*KEY, "role_id"), ["model_id", "role_id"]).select("model_id", "artifact", "fact_type_id")
    fks = schema.foreign_keys.withColumnRenamed("table_id", "artifact")
    referenced = fks.join(objects.select("model_id", F.col("artifact").alias("to_table_id"), "name"), ["model_id", "to_table_id"])
    enforced = fks.join(cat.constraints.select(*KEY, F.col("constraint_id").alias("source_id"), "type"), ["model_id", "source_id"]).join(cat.fact_types.select(*KEY, "name"), KEY)
    uses = by_role.union(enforced.select("model_id", "artifact", "fact_type_id")).distinct()
    used_facts, used_roles, players = _fact_sources(cat, uses)
    # sources of different types never equal each other
    return _union(
        _union(_source(tables.join(objects, ["model_id", "artifact"]).withColumn("id", F.col("artifact")), "artifact", "id", F.lit("EntityType"), F.col("name")),
               players, _source(referenced, "artifact", "to_table_id", F.lit("EntityType"), F.col("name"))).distinct(),
        _union(_source(tables.join(facts, ["model_id", "artifact"]).withColumn("id", F.col("artifact")), "artifact", "id", F.lit("FactType"), F.col("name")), used_facts).distinct(),
        used_roles.distinct(),
        _source(enforced, "artifact", "source_id", F.lit("Constraint"), _constraint_name(F.col("type"), F.col("name"))).distinct(),
    )


def entity_lineage(cat: Catalog) -> DataFrame:
    """Sources of every entity type: itself, its fact types with roles, value types and constraints, its sub- and supertypes."""
    entities = cat.object_types.filter("kind = 'entity'").select("model_id", F.col("object_type_id").alias("artifact"), "name")
    uses = cat.roles.select(*KEY, F.col("player_id").alias("artifact")).distinct().join(entities.select("model_id", "artifact"), ["model_id", "artifact"], "left_semi").select("model_id", "artifact", "fact_type_id")
    constraints = uses.join(cat.fact_types.select(*KEY, "name"), KEY).join(cat.constraints.select(*KEY, "constraint_id", "type"), KEY).filter("constraint_id IS NOT NULL")
    links = cat.subtype_facts.select("model_id", F.inline(F.array(
        F.struct(F.col("subtype_id").alias("artifact"), F.col("supertype_id").alias("other")), F.struct(F.col("supertype_id").alias("artifact"), F.col("subtype_id").alias("other")))))
    related = links.join(entities.select("model_id", "artifact"), ["model_id", "artifact"], "left_semi").join(
        cat.object_types.select("model_id", F.col("object_type_id").alias("other"), "name"), ["model_id", "other"])
    used_facts, used_roles, values = _fact_sources(cat, uses, values_only=True)
    # sources of different types never equal each other
    return _union(
        _union(_source(entities.withColumn("id", F.col("artifact")), "artifact", "id", F.lit("EntityType"), F.col("name")),
               _source(related, "artifact", "other", F.lit("EntityType"), F.col("name"))).distinct(),
        used_facts.distinct(), used_roles.distinct(), values.distinct(),
        _source(constraints, "artifact", "constraint_id", F.lit("Constraint"), _constraint_name(F.col("type"), F.col("name"))).distinct(),
    )


def impact(exports: DataFrame, sources: DataFrame, changed: DataFrame) -> DataFrame:
    """Artifacts touched by changed elements (model_id, element_id), with the relationship in words.

    exports (model_id, artifact, format, ...), sources as made by the lineage functions.
    """
    text = F.concat(F.lit("references "), F.col("element_name"))
    for kind, words in RELATIONSHIPS.items():
        text = F.when(F.col("element_type") == kind, F.concat(F.lit(words), F.col("element_name"))).otherwise(text)
    hit = sources.join(changed.select("model_id", "element_id").distinct(), ["model_id", "element_id"])
    return hit.join(exports.select("model_id", "artifact", "format"), ["model_id", "artifact"]).select("model_id", "element_id", "artifact", "format", text.alias("relationship"))


def model_hashes(cat: Catalog, tables: tuple[str, ...] = tuple(SCHEMAS)) -> DataFrame:
    """(model_id, model_hash): one hash over all rows of a model, whatever their order.

    Each row's SHA-256 is cut into four numbers that are summed per model, so
    the hash is a combinable aggregate instead of a sorted list of all elements.
    """
    rows = _union(*[
        getattr(cat, name).select("model_id", F.sha2(F.to_json(F.struct(F.lit(name).alias("table"), *[F.col(c) for c in getattr(cat, name).columns])), 256).alias("h"))
        for name in tables
    ])
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"n{i}") for i in range(4)]
    return rows.groupBy("model_id").agg(*lanes).select("model_id", F.sha2(F.concat_ws("|", *[F.col(f"n{i}").cast("string") for i in range(4)]), 256).alias("model_hash"))


def staleness(exports: DataFrame, hashes: DataFrame) -> DataFrame:
    """Exports (model_id, artifact, format, exported_at, model_hash) against the models' current hashes."""
    now = hashes.withColumnRenamed("model_hash", "current_hash")
    joined = exports.join(now, "model_id")
    stale = F.col("model_hash") != F.col("current_hash")
    reason = F.concat(F.lit("model hash changed from "), F.substring("model_hash", 1, 8), F.lit(" to "), F.substring("current_hash", 1, 8))
    return joined.select("model_id", "artifact", "format", "exported_at", stale.alias("stale"), F.when(stale, reason).alias("reason"))


def upsert(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """The manifest after new export entries: the latest (by seq) per model and artifact stays."""
    return extreme_rows(manifest.unionByName(entries), ["model_id", "artifact"], F.col("seq"))


def resolve_artifacts(exports: DataFrame, sources: DataFrame, paths: DataFrame) -> DataFrame:
    """Export entry and sources behind file paths (model_id, path), compared without ``.``, ``..`` and doubled slashes.

    ``..`` takes back the name before it; where there is none it stays, or has no effect at the root of an absolute path.
    """
    def normal(c: str) -> Column:
        root = F.startswith(F.col(c), F.lit("/"))

        def add(names: Column, part: Column) -> Column:
            last = F.get(names, F.size(names) - 1)
            up = part == ".."
            return (
                F.when(part.isin("", "."), names).when(up & last.isNotNull() & (last != ".."), F.slice(names, 1, F.size(names) - 1))
                .when(up & root, names).otherwise(F.concat(names, F.array(part))))

        names = F.aggregate(F.split(F.col(c), "/"), F.array().cast("array<string>"), add)
        return F.concat(F.when(root, "/").otherwise(""), F.array_join(names, "/"))

    wanted = paths.select("model_id", "path", normal("path").alias("p"))
    return wanted.join(exports.select("model_id", "artifact", "format", normal("artifact").alias("p")), ["model_id", "p"]).join(
        sources, ["model_id", "artifact"]).select("model_id", "path", "artifact", "format", "element_id", "element_type")
