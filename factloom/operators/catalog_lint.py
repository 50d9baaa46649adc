"""Lint rules over catalog tables: each returns ``model_id`` plus the violation columns, for all models at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.operators.keys import later_duplicates
from factloom.operators.rings import cyclic_groups
from factloom.plans.session import materialize
from factloom.plans.violations import record
from factloom.sources.catalog import Catalog

KEY = ["model_id", "fact_type_id"]


def _found(df: DataFrame, rule: str | Column, severity: str | Column, element: str, subject: list[Column] = (), message: str = "") -> DataFrame:
    fact_type = F.col("fact_type_id") if "fact_type_id" in df.columns else None
    constraint = F.col("constraint_id") if "constraint_id" in df.columns else None
    return df.select("model_id", *record(rule, severity, F.col(element), constraint=constraint, fact_type=fact_type, subject=subject, message=message))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _ids(cat: Catalog, alias: str, *more: str) -> DataFrame:
    return cat.object_types.select("model_id", F.col("object_type_id").alias(alias), *more)


def _arity(cat: Catalog) -> DataFrame:
    return cat.roles.groupBy(*KEY).agg(F.count("*").alias("arity"))


def dangling_roles(cat: Catalog) -> DataFrame:
    lost = cat.roles.join(_ids(cat, "player_id"), ["model_id", "player_id"], "left_anti")
    return _found(lost, "structural/dangling-role-reference", "error", "fact_type_id", [F.col("role_id"), F.col("player_id")], "role player is not declared")


def duplicate_names(cat: Catalog) -> DataFrame:
    def again(df: DataFrame, id_: str, kind: str) -> DataFrame:
        later = later_duplicates(df.select("model_id", id_, "name", "seq"), [F.col("model_id"), F.col("name")], "seq", id_)
        return _found(later, f"structural/duplicate-{kind}-name", "error", id_, [F.col("name"), F.col("first_id")], "name already used")

    return _union(again(cat.object_types, "object_type_id", "object-type"), again(cat.fact_types, "fact_type_id", "fact-type"))


def missing_inverse_reading(cat: Catalog) -> DataFrame:
    readings = cat.readings.groupBy(*KEY).agg(F.count("*").alias("n"))
    binary = _arity(cat).filter("arity = 2").join(readings, KEY, "left").filter("coalesce(n, 0) < 2")
    return _found(binary, "structural/binary-missing-inverse-reading", "warning", "fact_type_id", message="binary fact type with fewer than two readings")


def subtype_references(cat: Catalog) -> DataFrame:
    parts = []
    for end in ("subtype", "supertype"):
        kinds = _ids(cat, f"{end}_id", "kind")
        joined = cat.subtype_facts.select("model_id", "subtype_fact_id", f"{end}_id").join(kinds, ["model_id", f"{end}_id"], "left")
        rule = F.when(F.col("kind").isNull(), f"structural/subtype-dangling-{end}").otherwise("structural/subtype-not-entity")
        parts.append(_found(joined.filter("kind IS NULL OR kind <> 'entity'"), rule, "error", "subtype_fact_id", [F.col(f"{end}_id")], f"{end} is missing or not an entity type"))
    return _union(*parts)


def subtype_cycles(cat: Catalog) -> DataFrame:
    """One violation per model whose subtype links form a cycle."""
    edges = cat.subtype_facts.select("model_id", F.col("subtype_id").alias("a"), F.col("supertype_id").alias("b"))
    cyclic = cyclic_groups(edges, "model_id")
    return _found(cyclic, "structural/subtype-cycle", "error", "model_id", message="subtype links form a cycle")


def objectification(cat: Catalog) -> DataFrame:
    o = cat.objectified
    no_fact = o.join(cat.fact_types.select(*KEY), KEY, "left_anti")
    typed = o.join(_ids(cat, "object_type_id", "kind"), ["model_id", "object_type_id"], "left").filter("kind IS NULL OR kind <> 'entity'")
    rule = F.when(F.col("kind").isNull(), "structural/objectified-dangling-object-type").otherwise("structural/objectified-not-entity")

    def again(column: str, name: str) -> DataFrame:
        later = later_duplicates(o, [F.col("model_id"), F.col(column)], "seq", "objectified_id")
        return _found(later, f"structural/{name}", "error", "objectified_id", [F.col(column)], "already objectified")

    return _union(
        _found(no_fact, "structural/objectified-dangling-fact-type", "error", "objectified_id", [F.col("fact_type_id")], "fact type is not declared"),
        _found(typed, rule, "error", "objectified_id", [F.col("object_type_id")], "object type is missing or not an entity type"),
        again("fact_type_id", "duplicate-objectification"), again("object_type_id", "duplicate-objectification-target"),
    )


def _constraint_roles(cat: Catalog) -> DataFrame:
    """Every role named by a constraint, with ``known``: does its own fact type have it?"""
    named = cat.constraints.select(*KEY, "constraint_id", "type", F.posexplode("role_ids").alias("at", "role_id"))
    known = cat.roles.select(*KEY, "role_id", "player_id").withColumn("known", F.lit(True))
    return named.join(known, [*KEY, "role_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


# Constraint kinds whose roles must belong to their fact type, and the rule for each.
INVALID_ROLE_RULES = {
    "internal_uniqueness": "constraint/internal-uniqueness-invalid-role", "mandatory": "constraint/mandatory-invalid-role",
    "value_constraint": "constraint/value-constraint-invalid-role", "ring": "constraint/ring-invalid-role",
    "frequency": "constraint/frequency-invalid-role", "cardinality": "constraint/cardinality-invalid-role",
}


def _rule_of(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("type")]


def invalid_roles(cat: Catalog) -> DataFrame:
    bad = _constraint_roles(cat).filter(F.col("type").isin(*INVALID_ROLE_RULES) & ~F.col("known"))
    return _found(bad, _rule_of(INVALID_ROLE_RULES), "error", "fact_type_id", [F.col("role_id")], "role does not belong to the fact type")


def spanning_uniqueness(cat: Catalog) -> DataFrame:
    unique = cat.constraints.filter("type = 'internal_uniqueness'").select(*KEY, "constraint_id", F.size("role_ids").alias("n"))
    unknown = _constraint_roles(cat).filter("NOT known").select(*KEY, "constraint_id").distinct()
    wide = unique.join(_arity(cat).filter("arity > 1"), KEY).filter("n = arity").join(unknown, [*KEY, "constraint_id"], "left_anti")
    return _found(wide, "constraint/spanning-all-roles", F.when(F.col("arity") == 2, "info").otherwise("warning"), "fact_type_id", message="uniqueness over all roles says nothing")


def local_external_uniqueness(cat: Catalog) -> DataFrame:
    external = cat.constraints.filter("type = 'external_uniqueness'").select(*KEY, "constraint_id")
    reaching_out = _constraint_roles(cat).filter("NOT known").select(*KEY, "constraint_id").distinct()
    return _found(external.join(reaching_out, [*KEY, "constraint_id"], "left_anti"), "constraint/external-uniqueness-all-local", "warning", "fact_type_id", message="all roles are local")


# Kinds that compare several roles, and the rule when fewer than two are named.
TOO_FEW_RULES = {
    "disjunctive_mandatory": "constraint/disjunctive-mandatory-too-few-roles",
    "exclusion": "constraint/exclusion-too-few-roles", "exclusive_or": "constraint/exclusive-or-too-few-roles",
}
MISMATCH_RULES = {"subset": "constraint/subset-arity-mismatch", "equality": "constraint/equality-arity-mismatch"}


def too_few_roles(cat: Catalog) -> DataFrame:
    bad = cat.constraints.filter(F.col("type").isin(*TOO_FEW_RULES) & (F.size("role_ids") < 2))
    return _found(bad, _rule_of(TOO_FEW_RULES), "error", "fact_type_id", message="fewer than two roles")


def arity_mismatch(cat: Catalog) -> DataFrame:
    bad = cat.constraints.filter(F.col("type").isin(*MISMATCH_RULES) & (F.size("role_ids") != F.size("role_ids_2")))
    return _found(bad, _rule_of(MISMATCH_RULES), "error", "fact_type_id", message="the two sides name different numbers of roles")


def ring_players(cat: Catalog) -> DataFrame:
    ends = _constraint_roles(cat).filter("type = 'ring' AND known").groupBy(*KEY, "constraint_id").agg(
        F.count("*").alias("n"), F.min("player_id").alias("p"), F.max("player_id").alias("q"))
    return _found(ends.filter("n = 2 AND p <> q"), "constraint/ring-different-players", "error", "fact_type_id", [F.col("p"), F.col("q")], "ring roles have different players")


def frequency_bounds(cat: Catalog) -> DataFrame:
    f = cat.constraints.filter("type = 'frequency'")
    return _union(*[
        _found(f.filter(test), f"constraint/frequency-{name}", "error", "fact_type_id", message=message)
        for name, test, message in (
            ("empty-roles", F.size("role_ids") == 0, "no roles"),
            ("invalid-min", F.col("min") < 1, "minimum below one"),
            ("max-less-than-min", F.col("max") < F.col("min"), "maximum below minimum"),
        )
    ])


def cardinality_shape(cat: Catalog) -> DataFrame:
    c = cat.constraints.filter("type = 'cardinality'").select(*KEY, "constraint_id", "min", "max")
    return _union(
        _found(c.join(_arity(cat).filter("arity <> 1"), KEY), "constraint/cardinality-non-unary", "error", "fact_type_id", message="fact type is not unary"),
        _found(c.filter("max < min"), "constraint/cardinality-max-less-than-min", "error", "fact_type_id", message="maximum below minimum"),
    )


def missing_metadata(cat: Catalog) -> DataFrame:
    o = cat.object_types
    return _union(
        _found(o.filter("definition IS NULL OR definition = ''"), "completeness/missing-object-type-definition", "info", "object_type_id", message="no definition"),
        _found(o.filter("kind = 'value' AND data_type IS NULL"), "completeness/missing-value-type-data-type", "info", "object_type_id", message="no data type"),
    )


def unconstrained_fact_types(cat: Catalog) -> DataFrame:
    state = cat.constraints.groupBy(*KEY).agg(F.max(F.col("type") == "internal_uniqueness").alias("unique"))
    joined = cat.fact_types.select(*KEY).join(state, KEY, "left").join(_arity(cat), KEY, "left")
    return _union(
        _found(joined.filter("unique IS NULL"), "completeness/fact-type-without-constraints", "warning", "fact_type_id", message="no constraints"),
        _found(joined.filter("NOT unique AND arity >= 2"), "completeness/fact-type-without-uniqueness", "warning", "fact_type_id", message="no uniqueness constraint"),
    )


def isolated_object_types(cat: Catalog) -> DataFrame:
    players = cat.roles.select("model_id", F.col("player_id").alias("object_type_id")).distinct()
    alone = cat.object_types.filter("NOT coalesce(independent, false)").select("model_id", "object_type_id").join(players, ["model_id", "object_type_id"], "left_anti")
    return _found(alone, "completeness/isolated-object-type", "info", "object_type_id", message="plays no role")


def preferred_identifiers(cat: Catalog) -> DataFrame:
    """Entity types without a preferred identifier, own or inherited along identifying subtype links, or with several."""
    preferred = cat.constraints.filter("type = 'internal_uniqueness' AND is_preferred").groupBy(*KEY).agg(F.count("*").alias("n"))
    played = cat.roles.select(*KEY, F.col("player_id").alias("object_type_id")).distinct()
    counts = played.join(preferred, KEY).groupBy("model_id", "object_type_id").agg(F.sum("n").alias("n"))
    entities = cat.object_types.filter("kind = 'entity'").select("model_id", "object_type_id")
    counted = cat.store(entities.join(counts, ["model_id", "object_type_id"], "left"), "identifiers")
    # identified object types spread to the subtypes that take their identification from them
    links = cat.subtype_facts.filter("provides_identification").select(
        "model_id", F.col("supertype_id").alias("object_type_id"), F.col("subtype_id").alias("next")).distinct()
    known = frontier = cat.store(counted.filter("n > 0").select("model_id", "object_type_id"), "identified")
    while not frontier.isEmpty():
        spread = frontier.join(links, ["model_id", "object_type_id"]).select("model_id", F.col("next").alias("object_type_id")).distinct()
        frontier = cat.store(spread.join(known, ["model_id", "object_type_id"], "left_anti"), "identified")
        known = known.union(frontier)
    return _union(
        _found(counted.filter("n IS NULL").join(known, ["model_id", "object_type_id"], "left_anti"), "completeness/missing-preferred-identifier", "info", "object_type_id", message="no preferred identifier"),
        _found(counted.filter("n > 1"), "completeness/multiple-preferred-identifiers", "warning", "object_type_id", [F.col("n")], "several preferred identifiers"),
    )


def join_operands(cat: Catalog) -> DataFrame:
    """Shape of join constraints: operand count, then per operand root, steps, contiguity and projection, then agreement.

    An operand reports only its first fault in that order, and agreement is
    judged only where every operand of the constraint is sound.
    """
    op = [*KEY, "constraint_id", "operand"]
    base = cat.operands
    few = base.filter("type <> 'join_subset'").groupBy(*KEY, "constraint_id").agg(F.count("*").alias("n")).filter("n < 2")
    roots = _ids(cat, "root").withColumn("root_ok", F.lit(True))
    rooted = base.join(roots, ["model_id", "root"], "left").withColumn("root_ok", F.coalesce("root_ok", F.lit(False)))
    players = cat.roles.select("model_id", "role_id", F.col("fact_type_id").alias("at"), "player_id")
    steps = base.select(*op, "root", F.posexplode("steps").alias("i", "s")).select(*op, "root", "i", "s.entry", "s.exit")
    steps = (
        steps.join(players.toDF("model_id", "entry", "entry_at", "entry_player"), ["model_id", "entry"], "left")
        .join(players.toDF("model_id", "exit", "exit_at", "exit_player"), ["model_id", "exit"], "left")
        .withColumn("sound", F.coalesce(F.col("entry_at") == F.col("exit_at"), F.lit(False)))
    )
    along = Window.partitionBy(*op).orderBy("i")  # a path is a handful of steps
    steps = steps.withColumn("here", F.coalesce(F.lag("exit_player").over(along), F.when(F.col("i") == 0, F.col("root"))))
    fault = F.when(~F.col("sound"), "bad-step").when(F.col("entry_player") != F.col("here"), "discontiguous")
    walked = steps.groupBy(*op).agg(
        F.min_by(fault, F.when(fault.isNotNull(), F.col("i"))).alias("step_fault"),
        F.array_sort(F.collect_list(F.struct("i", "exit_player"))).alias("nodes"))
    judged = rooted.join(walked, op, "left").withColumn("nodes", F.concat(F.array("root"), F.coalesce(F.col("nodes.exit_player"), F.array().cast("array<string>"))))
    outside = F.exists("projection", lambda p: (p < 0) | (p >= F.size("nodes")))
    first = (
        F.when(~F.col("root_ok"), "unknown-root").when(F.col("step_fault").isNotNull(), F.col("step_fault"))
        .when(outside, "bad-projection").when(F.size("projection") == 0, "empty-projection")
    )
    judged = judged.withColumn("fault", first)
    faults = judged.filter("fault IS NOT NULL")
    columns = judged.withColumn("types", F.transform("projection", lambda p: F.get(F.col("nodes"), p)))
    agree = columns.groupBy(*KEY, "constraint_id").agg(
        F.max(F.col("fault").isNotNull()).alias("faulty"), F.min(F.size("types")).alias("low"), F.max(F.size("types")).alias("high")).filter("NOT faulty")
    mixed = agree.filter("low <> high")
    cells = columns.join(agree.filter("low = high").select(*KEY, "constraint_id"), [*KEY, "constraint_id"]).select(*KEY, "constraint_id", F.posexplode("types").alias("col", "t"))
    clash = cells.groupBy(*KEY, "constraint_id", "col").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).filter("t0 <> t1")
    return _union(
        _found(few, "constraint/join-too-few-operands", "error", "constraint_id", message="fewer than two operands"),
        _found(faults, F.concat(F.lit("constraint/join-"), F.col("fault")), "error", "constraint_id", [F.col("operand")], "unsound operand"),
        _found(mixed, "constraint/join-arity-mismatch", "error", "constraint_id", message="operands project different numbers of columns"),
        _found(clash, "constraint/join-column-type-mismatch", "error", "constraint_id", [F.col("col")], "operands project different object types"),
    )


def derivations(cat: Catalog) -> DataFrame:
    blank = (F.col("derivation_kind").isNotNull()) & (F.trim(F.coalesce("derivation_rule", F.lit(""))) == "")
    on_request = cat.fact_types.filter("derivation_kind = 'derived' AND coalesce(derivation_storage, 'derive_on_request') = 'derive_on_request'")
    return _union(
        _found(cat.fact_types.filter(blank), "derivation/missing-rule", "warning", "fact_type_id", message="derived without a rule"),
        _found(cat.subtype_facts.filter(blank), "derivation/missing-rule", "warning", "subtype_fact_id", message="derived without a rule"),
        _found(on_request.join(cat.populations.select(*KEY), KEY, "left_semi"), "derivation/derived-with-population", "warning", "fact_type_id", message="derived on request, yet populated"),
    )


def project_mappings(domains: DataFrame, mappings: DataFrame, entity_mappings: DataFrame, object_names: DataFrame) -> DataFrame:
    """Context mappings against the project's domains.

    domains (project_id, context, model_id), mappings (project_id, path, source_context, target_context),
    entity_mappings (project_id, path, source_name, target_name), object_names (model_id, name).
    Returns (project_id, rule_id, severity, element_id, subject).
    """
    contexts = domains.select("project_id", "context").distinct()
    names = object_names.select("model_id", "name").distinct()
    modelled = domains.filter("model_id IS NOT NULL")
    parts = []
    for end in ("source", "target"):
        lost = mappings.join(contexts.withColumnRenamed("context", f"{end}_context"), ["project_id", f"{end}_context"], "left_anti")
        parts.append(_project(lost, f"mapping-{end}-context-missing", "error", "path", F.col(f"{end}_context")))
        named = entity_mappings.join(mappings.select("project_id", "path", F.col(f"{end}_context").alias("context")), ["project_id", "path"]).join(modelled, ["project_id", "context"])
        unknown = named.join(names.withColumnRenamed("name", f"{end}_name"), ["model_id", f"{end}_name"], "left_anti")
        parts.append(_project(unknown, f"entity-mapping-{end}-missing", "error", "path", F.col(f"{end}_name")))
    return _union(*parts)


def project_products(domains: DataFrame, mappings: DataFrame, products: DataFrame) -> DataFrame:
    """Data products (project_id, path, domains ARRAY, mappings ARRAY) whose dependencies do not resolve.

    A mapping dependency resolves when it is part of some mapping path of its project.
    """
    contexts = domains.select("project_id", F.col("context").alias("dep")).distinct()
    needs = products.select("project_id", "path", F.explode("domains").alias("dep"))
    lost = needs.join(contexts, ["project_id", "dep"], "left_anti")
    wanted = products.select("project_id", "path", F.explode("mappings").alias("dep"))
    paths = mappings.select("project_id", F.col("path").alias("mapping")).distinct()
    hits = containing(paths, wanted.select("project_id", "dep").distinct())
    unresolved = wanted.join(hits, ["project_id", "dep"], "left_anti")
    return _union(
        _project(lost, "product-domain-dependency-missing", "error", "path", F.col("dep")),
        _project(unresolved, "product-mapping-dependency-unresolved", "warning", "path", F.col("dep")),
    )


PIECE = 3  # letters of an indexed piece


def _pieces(text: str) -> Column:
    """The distinct runs of PIECE letters of a text; a shorter text is its own and only piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - PIECE + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda k: F.substr(F.col(text), k, F.lit(PIECE))))


def _short_pieces(text: str) -> Column:
    """The distinct runs of fewer letters, the empty one included."""
    def runs(size: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda k: F.substr(F.col(text), k, F.lit(size)))
        return F.filter(made, lambda p: F.length(p) == size)

    return F.array_distinct(F.concat(F.array(F.lit("")), *[runs(size) for size in range(1, PIECE)]))


def containing(paths: DataFrame, deps: DataFrame) -> DataFrame:
    """The distinct (project_id, dep) that are part of some path (project_id, mapping) of their project.

    Paths are indexed by their pieces. A dependency no longer than a piece is there if it is a piece; any other fetches
    the paths of its rarest piece, none if that is nowhere, and only those are compared with the whole of it.
    """
    short = deps.filter(F.length("dep") <= PIECE)
    pieces = _asked_pieces(paths, short.select("project_id", F.col("dep").alias("piece")))
    there = short.join(pieces.select("project_id", F.col("piece").alias("dep")).distinct(), ["project_id", "dep"], "left_semi")

    long = deps.filter(F.length("dep") > PIECE).withColumn("piece", F.explode(_pieces("dep")))
    counts = materialize(_asked_pieces(paths, long.select("project_id", "piece")).groupBy("project_id", "piece").agg(F.count("*").alias("n")), "piece-counts")
    rated = long.join(counts, ["project_id", "piece"], "left").groupBy("project_id", "dep").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rarest")).filter("rarest.n > 0")
    rated = materialize(rated.select("project_id", "dep", F.col("rarest.piece").alias("piece")), "rarest-pieces")
    index = _asked_pieces(paths, rated.select("project_id", "piece"))
    found = rated.alias("d").join(index.alias("m"), [
        F.col("d.project_id") == F.col("m.project_id"), F.col("d.piece") == F.col("m.piece"), F.contains(F.col("m.mapping"), F.col("d.dep"))], "left_semi")
    return there.unionByName(found.select("project_id", "dep"))


def _asked_pieces(paths: DataFrame, asked: DataFrame) -> DataFrame:
    """(project_id, mapping, piece) of the pieces that are asked for."""
    every = F.concat(F.filter(_pieces("mapping"), lambda p: F.length(p) == PIECE), _short_pieces("mapping"))
    return paths.withColumn("piece", F.explode(every)).join(asked.distinct(), ["project_id", "piece"], "left_semi")


def _project(df: DataFrame, rule: str, severity: str, element: str, subject: Column) -> DataFrame:
    return df.select("project_id", F.lit(f"project/{rule}").alias("rule_id"), F.lit(severity).alias("severity"),
                     F.col(element).alias("element_id"), subject.alias("subject"))


def external_join_keys(cat: Catalog) -> DataFrame:
    """Common object type of each external uniqueness constraint (model_id, constraint_id, player_id), where it is clear."""
    named = cat.constraints.filter("type = 'external_uniqueness'").select(
        "model_id", "constraint_id", F.size("role_ids").alias("n"), F.explode("role_ids").alias("role_id"))
    located = named.join(cat.roles.select("model_id", "role_id", "fact_type_id", "player_id"), ["model_id", "role_id"])
    ck = ["model_id", "constraint_id"]
    sound = located.groupBy(*ck, "n").agg(F.count("*").alias("roles"), F.count_distinct("fact_type_id").alias("facts")).filter("n >= 2 AND roles = n AND facts = n")
    constrained = located.join(sound.select(*ck), ck, "left_semi")
    free = (
        constrained.select(*ck, "n", "fact_type_id", F.col("role_id").alias("own"))
        .join(cat.roles.select(*KEY, "role_id", "player_id"), KEY).filter("role_id <> own")
        .groupBy(*ck, "n", "fact_type_id", "player_id").agg(F.count("*").alias("times")).filter("times = 1")
        .join(constrained.select(*ck, "player_id").distinct(), [*ck, "player_id"], "left_anti")
    )
    common = free.groupBy(*ck, "n", "player_id").agg(F.count("*").alias("facts")).filter("facts = n")
    return common.groupBy(*ck).agg(F.count("*").alias("k"), F.min("player_id").alias("player_id")).filter("k = 1").drop("k")


# Rules in report order; every one takes the catalog.
RULES = (
    dangling_roles, duplicate_names, missing_inverse_reading, subtype_references, subtype_cycles, objectification,
    invalid_roles, spanning_uniqueness, local_external_uniqueness, too_few_roles, arity_mismatch, ring_players,
    frequency_bounds, cardinality_shape, join_operands, missing_metadata, unconstrained_fact_types,
    isolated_object_types, preferred_identifiers, derivations,
)


def lint(cat: Catalog, rules=RULES) -> DataFrame:
    return _union(*[rule(cat) for rule in rules])
