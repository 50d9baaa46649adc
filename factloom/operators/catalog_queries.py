"""Queries over catalog tables. Each one answers for every model of the catalog at once.

Functions that take a ``name`` look it up per model, ignoring case, the earliest
element winning; without a name they answer for every element. Results are rows,
not nested lists, so an element with very many fact types stays distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.naming import expand_reading
from factloom.functions.predicates import matches_keyword, same_name
from factloom.operators.sequences import extreme_rows, first_rows
from factloom.plans.session import HopTable, cut_lineage
from factloom.sources.catalog import Catalog

KEY = ["model_id", "fact_type_id"]


def by_name(df: DataFrame, column: str = "name") -> DataFrame:
    return df.orderBy("model_id", F.lower(column), column)


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n newest rows (a top-n, planned as per-partition heaps)."""
    return df.orderBy(F.desc(order)).limit(n)


def find_object(cat: Catalog, name: str | None) -> DataFrame:
    """(model_id, entity_id, entity_name, entity_kind): the named object type per model, or all of them."""
    found = cat.object_types
    if name is not None:
        found = extreme_rows(found.filter(same_name(F.col("name"), name)).select("model_id", "object_type_id", "name", "kind", "seq"),
                             ["model_id"], F.col("seq"), latest=False)
    return found.select("model_id", F.col("object_type_id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("kind").alias("entity_kind"))


def find_fact_type(cat: Catalog, name: str) -> DataFrame:
    found = cat.fact_types.filter(same_name(F.col("name"), name)).select(*KEY, "name", "seq")
    return extreme_rows(found, ["model_id"], F.col("seq"), latest=False).select(*KEY, F.col("name").alias("fact_type_name"))


def models(cat: Catalog) -> DataFrame:
    return cat.object_types.select("model_id").union(cat.fact_types.select("model_id")).distinct()


def not_found(cat: Catalog, name: str, kind: str = "entity") -> DataFrame:
    """(model_id, message) for every model without the name: absence is a result, not an error."""
    hits = {
        "entity": lambda: find_object(cat, name).select("model_id"),
        "fact type": lambda: find_fact_type(cat, name).select("model_id"),
    }
    kinds = kind.split(" or ")
    known = reduce(lambda a, b: a.union(b), [hits[k]() for k in kinds])
    return models(cat).join(known, "model_id", "left_anti").select("model_id", F.lit(f'No {kind} named "{name}".').alias("message"))


def _players(cat: Catalog) -> DataFrame:
    """Roles with their players' names (the id where the player is not declared)."""
    names = cat.object_types.select("model_id", F.col("object_type_id").alias("player_id"), F.col("name").alias("player"))
    return cat.roles.join(names, ["model_id", "player_id"], "left").withColumn("player", F.coalesce("player", "player_id"))


def list_entities(cat: Catalog, kind: str | None = None) -> DataFrame:
    found = cat.object_types if kind is None else cat.object_types.filter(F.col("kind") == kind)
    return by_name(found.select("model_id", "object_type_id", "name", "kind", "reference_mode", "definition"))


def fact_type_refs(cat: Catalog) -> DataFrame:
    """Fact types with arity and primary reading (model_id, fact_type_id, name, arity, reading)."""
    shape = _players(cat).groupBy(*KEY).agg(
        F.count("*").alias("arity"), F.array_sort(F.collect_list(F.struct("pos", "player"))).alias("ps"))
    first = cat.readings.groupBy(*KEY).agg(F.min_by("template", "pos").alias("template"))
    joined = cat.fact_types.select(*KEY, "name").join(shape, KEY, "left").join(first, KEY, "left")
    return joined.select(*KEY, "name", F.coalesce("arity", F.lit(0)).alias("arity"), expand_reading(F.col("template"), F.col("ps.player")).alias("reading"))


def list_fact_types(cat: Catalog, arity: int | None = None) -> DataFrame:
    counts = cat.roles.groupBy(*KEY).agg(F.count("*").alias("arity"))
    found = cat.fact_types.select(*KEY, "name").join(counts, KEY, "left").withColumn("arity", F.coalesce("arity", F.lit(0)))
    return found if arity is None else found.filter(F.col("arity") == arity)


def list_constraints(cat: Catalog, keyword: str | None = None) -> DataFrame:
    found = cat.constraints if keyword is None else cat.constraints.filter(matches_keyword(F.col("type"), keyword))
    named = found.select(*KEY, "ord", "constraint_id", "type").join(cat.fact_types.select(*KEY, F.col("name").alias("fact_type")), KEY)
    return named.select(*KEY, "fact_type", F.coalesce("constraint_id", F.concat_ws("-constraint-", "fact_type_id", "ord")).alias("constraint_id"), "type")


def fact_types_of(cat: Catalog, name: str | None = None) -> DataFrame:
    """Each entity's fact types (model_id, entity_id, fact_type_id, name)."""
    played = cat.roles.select(*KEY, F.col("player_id").alias("entity_id")).distinct()
    return (played.join(find_object(cat, name).select("model_id", "entity_id"), ["model_id", "entity_id"])
            .join(cat.fact_types.select(*KEY, "name"), KEY).select("model_id", "entity_id", "fact_type_id", "name"))


def related_entities(cat: Catalog, name: str | None = None) -> DataFrame:
    """Declared co-players of each entity, itself excluded."""
    roles = cat.roles.select(*KEY, "player_id").distinct()
    mine = roles.withColumnRenamed("player_id", "entity_id").join(find_object(cat, name).select("model_id", "entity_id"), ["model_id", "entity_id"])
    pairs = mine.join(roles, KEY).filter("player_id <> entity_id").select("model_id", "entity_id", F.col("player_id").alias("object_type_id")).distinct()
    return pairs.join(cat.object_types.select("model_id", "object_type_id", "name"), ["model_id", "object_type_id"])


def _subtype_pairs(cat: Catalog, down: bool) -> DataFrame:
    near, far = ("supertype_id", "subtype_id") if down else ("subtype_id", "supertype_id")
    return cat.subtype_facts.select("model_id", F.col(near).alias("entity_id"), F.col(far).alias("object_type_id")).distinct()


def _hierarchy(cat: Catalog, name: str | None, transitive: bool, down: bool) -> DataFrame:
    pairs = _subtype_pairs(cat, down)
    reached = pairs.join(find_object(cat, name).select("model_id", "entity_id"), ["model_id", "entity_id"], "left_semi")
    if transitive:
        reached = closure(pairs, reached, lambda df: cat.store(df, "reached")).filter("entity_id <> object_type_id")
    return reached.join(cat.object_types.select("model_id", "object_type_id", "name"), ["model_id", "object_type_id"]).select(
        "model_id", "entity_id", "object_type_id", "name")


def closure(pairs: DataFrame, start: DataFrame, store: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """All (model_id, entity_id, object_type_id) reached from ``start`` along ``pairs``.

    Frontier by frontier: each round joins only the newest pairs and drops those
    already known, so the rounds end by themselves; each is stored, so a round is
    not computed again.
    """
    columns = ["model_id", "entity_id", "object_type_id"]
    step = pairs.select("model_id", F.col("entity_id").alias("object_type_id"), F.col("object_type_id").alias("next"))
    known = frontier = store(start.select(*columns).distinct())
    while not frontier.isEmpty():
        grown = frontier.join(step, ["model_id", "object_type_id"]).select("model_id", "entity_id", F.col("next").alias("object_type_id")).distinct()
        frontier = store(grown.join(known, columns, "left_anti"))
        known = known.union(frontier)
    return known


def subtypes_of(cat: Catalog, name: str | None = None, transitive: bool = False) -> DataFrame:
    return _hierarchy(cat, name, transitive, True)


def supertypes_of(cat: Catalog, name: str | None = None, transitive: bool = False) -> DataFrame:
    return _hierarchy(cat, name, transitive, False)


def _sections(*parts: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    rows = [df.select("model_id", "entity_id", F.lit(section).alias("section"), item.alias("item_id"), text.alias("item")) for section, df, item, text in parts]
    return reduce(lambda a, b: a.unionByName(b), rows)


def entity_detail(cat: Catalog, name: str | None = None) -> DataFrame:
    """Fact types, roles, constraints, direct subtypes and supertypes of an entity, one row per item."""
    played = fact_types_of(cat, name)
    roles = cat.roles.withColumnRenamed("player_id", "entity_id").join(
        find_object(cat, name).select("model_id", "entity_id"), ["model_id", "entity_id"], "left_semi")
    constraints = played.select("model_id", "entity_id", "fact_type_id").join(cat.constraints.select(*KEY, "constraint_id", "type"), KEY)
    return _sections(
        ("fact_type", played, F.col("fact_type_id"), F.col("name")),
        ("role", roles, F.col("role_id"), F.col("name")),
        ("constraint", constraints, F.col("constraint_id"), F.col("type")),
        ("subtype", subtypes_of(cat, name), F.col("object_type_id"), F.col("name")),
        ("supertype", supertypes_of(cat, name), F.col("object_type_id"), F.col("name")),
    )


def fact_type_detail(cat: Catalog, name: str | None = None) -> DataFrame:
    """Roles, expanded readings, constraints and the objectified flag of fact types, one row per item."""
    wanted = cat.fact_types.select(*KEY) if name is None else find_fact_type(cat, name).select(*KEY)
    players = _players(cat).join(wanted, KEY, "left_semi")
    lists = players.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "player"))).alias("ps"))
    readings = cat.readings.join(lists, KEY).select(*KEY, "pos", expand_reading(F.col("template"), F.col("ps.player")).alias("text"))
    objectified = cat.objectified.select(*KEY).distinct().join(wanted, KEY, "left_semi")
    constraints = cat.constraints.join(wanted, KEY, "left_semi")

    def rows(section: str, df: DataFrame, item: Column, text: Column) -> DataFrame:
        return df.select(*KEY, F.lit(section).alias("section"), item.alias("item_id"), text.alias("item"))

    return reduce(lambda a, b: a.unionByName(b), [
        rows("role", players, F.col("role_id"), F.col("player")),
        rows("reading", readings, F.col("pos").cast("string"), F.col("text")),
        rows("constraint", constraints, F.col("constraint_id"), F.col("type")),
        rows("objectified", objectified, F.col("fact_type_id"), F.lit("true")),
    ])


def constraints_of(cat: Catalog, name: str) -> DataFrame:
    """Constraints of the named fact type where a model has one, else of the named entity's fact types."""
    direct = find_fact_type(cat, name).select(*KEY)
    via = fact_types_of(cat, name).join(direct.select("model_id"), "model_id", "left_anti").select(*KEY)
    return direct.unionByName(via).join(cat.constraints.select(*KEY, "constraint_id", "type"), KEY)


def mandatory_roles(cat: Catalog, name: str | None = None) -> DataFrame:
    required = cat.constraints.filter("type = 'mandatory'").select(*KEY, "constraint_id", F.col("role_ids")[0].alias("role_id"))
    found = required.join(_players(cat), [*KEY, "role_id"])
    if name is not None:
        found = found.join(find_object(cat, name).select("model_id", F.col("entity_id").alias("player_id")), ["model_id", "player_id"], "left_semi")
    return found.select(*KEY, "constraint_id", "role_id", "player_id", "player")


def hops(cat: Catalog) -> DataFrame:
    """Directed one-fact-type steps between co-players, with the position that orders them."""
    ordered = cat.roles.join(cat.fact_types.select(*KEY, "seq"), KEY).select(*KEY, "seq", "role_id", "pos", "player_id")
    a = ordered.select(*KEY, "seq", F.col("pos").alias("entry"), F.col("player_id").alias("node"))
    b = ordered.select(*KEY, F.col("pos").alias("exit"), F.col("player_id").alias("next"))
    return a.join(b, KEY).filter("entry <> exit AND node <> next")


def shortest_paths(cat: Catalog, start: str, end: str) -> DataFrame:
    """Per model, the first shortest path between two entities (model_id, found, hops, steps).

    Breadth first for all models together. Among equally short paths the one
    found first by fact type order wins, decided by comparing the positions along
    the path. Models leave the search as soon as their end is reached; visited
    objects are not entered again, so the search ends by itself.
    """
    ends = find_object(cat, start).select("model_id", F.col("entity_id").alias("first")).join(
        find_object(cat, end).select("model_id", F.col("entity_id").alias("last")), "model_id")
    ends = cat.store(ends, "ends")
    step = cat.store(hops(cat).join(ends.select("model_id"), "model_id", "left_semi"), "steps")
    no_steps = F.array().cast("array<struct<fact_type_id:string,from:string,to:string>>")
    frontier = ends.select("model_id", F.col("first").alias("node"), F.array().cast("array<bigint>").alias("place"), no_steps.alias("steps"))
    wanted = ends.filter("first <> last").select("model_id", F.col("last").alias("node"))
    # what is visited and what is answered are stored hop by hop and read as one table each, so no plan grows with the hops
    visited, answers = HopTable(frontier.select("model_id", "node"), "visited", cat.buckets), HopTable(ends.filter("first = last").select("model_id", no_steps.alias("steps")), "answers", cat.buckets)
    while True:
        open_models = ends.select("model_id").join(answers.read().select("model_id"), "model_id", "left_anti")
        reach = frontier.join(open_models, "model_id", "left_semi").join(step, ["model_id", "node"]).select(
            "model_id", F.col("next").alias("node"),
            F.concat("place", F.array("seq", F.col("entry").cast("bigint"), F.col("exit").cast("bigint"))).alias("place"),
            F.concat("steps", F.array(F.struct("fact_type_id", F.col("node").alias("from"), F.col("next").alias("to")))).alias("steps"))
        fresh = reach.join(visited.read(), ["model_id", "node"], "left_anti").groupBy("model_id", "node").agg(
            F.min("place").alias("place"), F.min_by("steps", "place").alias("steps"))
        frontier = cat.store(fresh, "frontier")
        if frontier.isEmpty():
            break
        visited.add(frontier.select("model_id", "node"))
        # a model that has its answer has no frontier left, so every meeting with an end is a first one
        answers.add(frontier.join(wanted, ["model_id", "node"]).select("model_id", "steps"))
    return ends.select("model_id").join(answers.read(), "model_id", "left").select(
        "model_id", F.col("steps").isNotNull().alias("found"), F.size(F.coalesce("steps", no_steps)).alias("hops"), F.coalesce("steps", no_steps).alias("steps"))


def identification_anchors(cat: Catalog, name: str | None = None) -> DataFrame:
    """Per entity type: its preferred identifier's fact type and identifying types, and whether it lacks one."""
    targets = find_object(cat, name).filter("entity_kind = 'entity'")
    preferred = cat.constraints.filter("type = 'internal_uniqueness' AND is_preferred").select(*KEY, "ord", F.explode("role_ids").alias("role_id"))
    order = cat.fact_types.select(*KEY, "seq", F.col("name").alias("fact_type"))
    chosen = (
        preferred.join(cat.roles.select(*KEY, "role_id", F.col("player_id").alias("entity_id")), [*KEY, "role_id"]).join(order, KEY)
        .groupBy("model_id", "entity_id").agg(F.min_by(F.struct("fact_type_id", "fact_type"), F.struct("seq", "ord")).alias("c"))
        .select("model_id", "entity_id", "c.*")
    )
    others = (
        chosen.join(_players(cat), KEY).filter("player_id <> entity_id")
        .groupBy("model_id", "entity_id").agg(F.array_sort(F.collect_list(F.struct("pos", "player"))).alias("ps"))
    )
    modes = cat.object_types.select("model_id", F.col("object_type_id").alias("entity_id"), "reference_mode")
    return (
        targets.join(modes, ["model_id", "entity_id"]).join(chosen, ["model_id", "entity_id"], "left").join(others, ["model_id", "entity_id"], "left")
        .select("model_id", "entity_id", "entity_name", "reference_mode", "fact_type",
                F.when(F.col("fact_type").isNotNull(), F.coalesce(F.array_join("ps.player", ", "), F.lit(""))).alias("identified_by"),
                F.col("fact_type").isNull().alias("missing_identifier"))
    )


def anchor_mandatory_facts(cat: Catalog, name: str | None = None) -> DataFrame:
    """Names of the fact types in which an entity type plays a mandatory role."""
    targets = find_object(cat, name).filter("entity_kind = 'entity'").select("model_id", F.col("entity_id").alias("player_id"))
    roles = mandatory_roles(cat).join(targets, ["model_id", "player_id"], "left_semi")
    return roles.join(cat.fact_types.select(*KEY, F.col("name").alias("fact_type")), KEY).select("model_id", F.col("player_id").alias("entity_id"), "fact_type").distinct()


def statistics(cat: Catalog) -> DataFrame:
    """Eight counts per model: one combined aggregate per table, no joins."""
    def counted(df: DataFrame, **conditions: str) -> DataFrame:
        return df.groupBy("model_id").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()])

    parts = [
        counted(cat.object_types, entity_types="kind = 'entity'", value_types="kind = 'value'"),
        counted(cat.fact_types, fact_types="true"), counted(cat.constraints, constraints="true"),
        counted(cat.subtype_facts, subtype_relationships="true"), counted(cat.objectified, objectified_fact_types="true"),
        counted(cat.populations, populations="true"),
    ]
    names = [c for p in parts for c in p.columns if c != "model_id"]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy("model_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


# Constraint keywords a description can focus on.
FOCUS_KEYWORDS = ("uniqueness", "mandatory", "value", "frequency", "exclusion", "subset", "equality", "ring", "disjunctive", "exclusive-or")


def describe(cat: Catalog, focus: str | None = None, populations: bool = True) -> DataFrame:
    """Describe every model (model_id, focus_kind, section, item_id, item).

    A focus is tried per model as an entity, then a fact type, then a constraint
    keyword; a model where nothing matches gets a single message row.
    """
    refs = cat.fact_types.select(*KEY, "name")
    if focus is None:
        kind = models(cat).withColumn("focus_kind", F.lit("full"))
        facts = refs.select(*KEY)
        constraints = cat.constraints
        entities = cat.object_types.select("model_id", "object_type_id")
    else:
        entity, fact = find_object(cat, focus), find_fact_type(cat, focus)
        keyword = cat.constraints.filter(matches_keyword(F.col("type"), focus)) if focus.lower() in FOCUS_KEYWORDS else cat.constraints.limit(0)
        rank = reduce(lambda a, b: a.union(b), [
            entity.select("model_id", F.lit(0).alias("r")), fact.select("model_id", F.lit(1)),
            (models(cat) if focus.lower() in FOCUS_KEYWORDS else models(cat).limit(0)).select("model_id", F.lit(2)), models(cat).select("model_id", F.lit(3)),
        ])
        names = F.array(*[F.lit(n) for n in ("entity", "fact type", "constraint type", "none")])
        kind = rank.groupBy("model_id").agg(F.min("r").alias("r")).select("model_id", names[F.col("r")].alias("focus_kind"))

        def only(df: DataFrame, wanted: str) -> DataFrame:
            return df.join(kind.filter(F.col("focus_kind") == wanted).select("model_id"), "model_id", "left_semi")

        by_keyword = only(keyword, "constraint type")
        facts = reduce(lambda a, b: a.union(b), [
            only(fact_types_of(cat, focus), "entity").select(*KEY), only(fact, "fact type").select(*KEY), by_keyword.select(*KEY)]).distinct()
        all_of = cat.constraints.join(facts, KEY, "left_semi")
        constraints = all_of.join(kind.filter("focus_kind <> 'constraint type'").select("model_id"), "model_id", "left_semi").unionByName(by_keyword)
        involved = cat.roles.join(facts, KEY, "left_semi").join(kind.filter("focus_kind <> 'entity'").select("model_id"), "model_id", "left_semi")
        entities = only(entity, "entity").select("model_id", F.col("entity_id").alias("object_type_id")).union(
            involved.select("model_id", F.col("player_id").alias("object_type_id"))).distinct()
    shown = entities.join(cat.object_types.select("model_id", "object_type_id", "name"), ["model_id", "object_type_id"])
    parts = [
        shown.select("model_id", F.lit("entity").alias("section"), F.col("object_type_id").alias("item_id"), F.col("name").alias("item")),
        facts.join(refs, KEY).select("model_id", F.lit("fact type").alias("section"), F.col("fact_type_id").alias("item_id"), F.col("name").alias("item")),
        constraints.select("model_id", F.lit("constraint").alias("section"), F.col("constraint_id").alias("item_id"), F.col("type").alias("item")),
    ]
    if populations:
        parts.append(cat.populations.join(facts, KEY, "left_semi").select(
            "model_id", F.lit("population").alias("section"), F.col("pop_id").alias("item_id"), F.col("fact_type_id").alias("item")))
    none = kind.filter("focus_kind = 'none'").select("model_id", F.lit("message").alias("section"), F.lit(None).cast("string").alias("item_id"),
                                                     F.lit(f'nothing matches the focus "{focus}"').alias("item"))
    return reduce(lambda a, b: a.unionByName(b), [*parts, none]).join(kind, "model_id")


def key_entities(cat: Catalog, n: int = 10) -> DataFrame:
    """The first n object types of each model plus how many more there are (model_id, name, definition, more)."""
    first = first_rows(cat.object_types.select("model_id", "name", "definition", "seq"), ["model_id"], ["seq"], n)
    counts = cat.object_types.groupBy("model_id").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return first.join(counts, "model_id").drop("seq")


def summarize_populations(rows: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """Instance count and first n instances of each population, the instances as one text each, in order."""
    text = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), ",")
    first = first_rows(rows.select("pop_id", "ord", text.alias("t")), ["pop_id"], ["ord"], n)
    shown = first.groupBy("pop_id").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("xs"))
    counts = rows.groupBy("pop_id").agg(F.count("*").alias("instances"))
    return counts.join(shown, "pop_id").select("pop_id", "instances", F.array_join("xs.t", ";").alias("first_rows"))


def neighbourhood(cat: Catalog, name: str, hops_: int) -> DataFrame:
    """Elements within a number of hops of an entity, over fact types and subtype links (model_id, section, element_id)."""
    links = reduce(lambda a, b: a.union(b), [
        cat.roles.select("model_id", F.col("fact_type_id").alias("link"), F.lit("fact type").alias("section"), "player_id"),
        cat.subtype_facts.select("model_id", F.col("subtype_fact_id").alias("link"), F.lit("subtype").alias("section"), F.explode(F.array("subtype_id", "supertype_id")).alias("player_id")),
    ])
    links = cat.store(cat.dealt(links).distinct(), "links")
    nodes = frontier = cat.store(find_object(cat, name).select("model_id", F.col("entity_id").alias("player_id")), "nodes")
    crossed = []
    for _ in range(hops_):
        if frontier.isEmpty():
            break
        used = frontier.join(links, ["model_id", "player_id"]).select("model_id", "section", "link").distinct()
        crossed.append(used)
        reached = used.join(links, ["model_id", "section", "link"]).select("model_id", "player_id").distinct()
        frontier = cat.store(reached.join(nodes, ["model_id", "player_id"], "left_anti"), "nodes")
        nodes = nodes.union(frontier)
    found = nodes.select("model_id", F.lit("object type").alias("section"), F.col("player_id").alias("element_id"))
    for used in crossed:
        found = found.union(used.select("model_id", "section", F.col("link").alias("element_id")))
    return found.distinct()


def guided(types: DataFrame, names: DataFrame | None) -> DataFrame:
    """Keep enums and aliases always, other types only when named (ignoring case); without names keep all."""
    if names is None:
        return types
    wanted = names.select(F.lower("name").alias("_w")).distinct()
    marked = types.join(wanted.withColumn("_hit", F.lit(True)), F.lower(types.name) == F.col("_w"), "left")
    return marked.filter(F.col("kind").isin("enum", "type_alias") | F.coalesce("_hit", F.lit(False))).select(*types.columns)
