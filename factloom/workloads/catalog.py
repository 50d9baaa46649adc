"""Catalog queries and lint rules over the derived corpus of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import catalog_lint as L, catalog_queries as Q
from factloom.workloads.catalog_data import catalog, with_catalog
from factloom.workloads.registry import Tables, query
from factloom.workloads.retail import facts


def _query(name: str, select: str, *ctes: str):
    return query(name, with_catalog(select, *ctes))


# shared pieces of the SQL side
ARITY = "ar AS (SELECT model_id, fact_type_id, count(*) AS arity FROM roles GROUP BY ALL)"
PLAYERS = "pl AS (SELECT r.*, coalesce(o.name, r.player_id) AS player FROM roles r LEFT JOIN object_types o ON o.model_id = r.model_id AND o.object_type_id = r.player_id)"


def entity(name: str, alias: str = "ent") -> str:
    return f"{alias} AS (SELECT model_id, min_by(object_type_id, seq) AS entity_id FROM object_types WHERE lower(name) = lower('{name}') GROUP BY 1)"


def fact(name: str) -> str:
    return f"fct AS (SELECT model_id, min_by(fact_type_id, seq) AS fact_type_id FROM fact_types WHERE lower(name) = lower('{name}') GROUP BY 1)"


FOCUS_FACT = "orderhas part-3-2"

# ---- sources and statistics ----------------------------------------------------------------------


@_query("s02_catalog_source", "SELECT model_id, fact_type_id, role_id, pos, name, player_id FROM roles")
def s02(t: Tables):
    return catalog(t).roles


@_query("c01_dangling_fact_type", "SELECT model_id, pop_id, fact_type_id FROM populations p WHERE NOT EXISTS (SELECT 1 FROM fact_types f WHERE f.model_id = p.model_id AND f.fact_type_id = p.fact_type_id)")
def c01(t: Tables):
    from factloom.operators.engine import check_dangling
    cat = catalog(t)
    # ids are unique within a model only, so both are qualified by it
    def full(c):
        return F.concat_ws("/", "model_id", c)
    found = check_dangling(cat.populations.select(full("pop_id").alias("pop_id"), full("fact_type_id").alias("fact_type_id")),
                           cat.fact_types.select(full("fact_type_id").alias("fact_type_id")))
    return found.select(F.split("pop_id", "/")[0].cast("bigint").alias("model_id"), F.split("pop_id", "/")[1].alias("pop_id"), F.split("fact_type_id", "/")[1].alias("fact_type_id"))


_STATS = """SELECT model_id, CAST(sum(et) AS BIGINT) AS entity_types, CAST(sum(vt) AS BIGINT) AS value_types, CAST(sum(ft) AS BIGINT) AS fact_types, CAST(sum(co) AS BIGINT) AS constraints,
  CAST(sum(st) AS BIGINT) AS subtype_relationships, CAST(sum(ob) AS BIGINT) AS objectified_fact_types, CAST(sum(po) AS BIGINT) AS populations FROM (
  SELECT model_id, (kind = 'entity')::INT AS et, (kind = 'value')::INT AS vt, 0 AS ft, 0 AS co, 0 AS st, 0 AS ob, 0 AS po FROM object_types
  UNION ALL SELECT model_id, 0, 0, 1, 0, 0, 0, 0 FROM fact_types UNION ALL SELECT model_id, 0, 0, 0, 1, 0, 0, 0 FROM constraints
  UNION ALL SELECT model_id, 0, 0, 0, 0, 1, 0, 0 FROM subtype_facts UNION ALL SELECT model_id, 0, 0, 0, 0, 0, 1, 0 FROM objectified UNION ALL SELECT model_id, 0, 0, 0, 0, 0, 0, 1 FROM populations) GROUP BY 1"""


@_query("q14_statistics", _STATS)
def q14(t: Tables):
    return Q.statistics(catalog(t))


# ---- lookups -----------------------------------------------------------------------------------------

@_query("q01_entities", "SELECT model_id, object_type_id, name, kind, reference_mode, definition FROM object_types WHERE kind = 'value'")
def q01(t: Tables):
    return Q.list_entities(catalog(t), "value")


@_query("q02_fact_types", "SELECT f.model_id, f.fact_type_id, f.name, arity FROM fact_types f JOIN ar USING (model_id, fact_type_id) WHERE arity = 3", ARITY)
def q02(t: Tables):
    return Q.list_fact_types(catalog(t), 3)


@_query("q03_constraints", "SELECT c.model_id, c.fact_type_id, f.name AS fact_type, constraint_id, type FROM constraints c JOIN fact_types f USING (model_id, fact_type_id) WHERE contains(type, 'exclusive_or') OR type = 'exclusive_or'")
def q03(t: Tables):
    return Q.list_constraints(catalog(t), "Exclusive-Or")


@_query("f07_fact_readings", """SELECT f.model_id, f.fact_type_id, f.name, coalesce(arity, 0) AS arity,
  replace(replace(replace(template, '{0}', p0), '{1}', coalesce(p1, '{1}')), '{2}', coalesce(p2, '{2}')) AS reading
  FROM fact_types f LEFT JOIN ar USING (model_id, fact_type_id) LEFT JOIN (SELECT model_id, fact_type_id, template FROM readings WHERE pos = 0) USING (model_id, fact_type_id)
  LEFT JOIN (SELECT model_id, fact_type_id, max(player) FILTER (pos = 0) AS p0, max(player) FILTER (pos = 1) AS p1, max(player) FILTER (pos = 2) AS p2 FROM pl GROUP BY ALL) USING (model_id, fact_type_id)""", ARITY, PLAYERS)
def f07(t: Tables):
    return Q.fact_type_refs(catalog(t))


_PLAYED = "pd AS (SELECT DISTINCT model_id, fact_type_id, player_id AS entity_id FROM roles)"
_DETAIL = """SELECT p.model_id, p.entity_id, 'fact_type' AS section, f.fact_type_id AS item_id, f.name AS item FROM pd p JOIN obj USING (model_id, entity_id) JOIN fact_types f USING (model_id, fact_type_id)
  UNION ALL SELECT model_id, entity_id, 'role', role_id, r.name FROM roles r JOIN obj o USING (model_id) WHERE r.player_id = o.entity_id
  UNION ALL SELECT model_id, entity_id, 'constraint', constraint_id, type FROM pd JOIN obj USING (model_id, entity_id) JOIN constraints USING (model_id, fact_type_id)
  UNION ALL SELECT s.model_id, supertype_id, 'subtype', subtype_id, o.name FROM subtype_facts s JOIN object_types o ON o.model_id = s.model_id AND o.object_type_id = s.subtype_id JOIN obj b ON b.model_id = s.model_id AND b.entity_id = s.supertype_id
  UNION ALL SELECT s.model_id, subtype_id, 'supertype', supertype_id, o.name FROM subtype_facts s JOIN object_types o ON o.model_id = s.model_id AND o.object_type_id = s.supertype_id JOIN obj b ON b.model_id = s.model_id AND b.entity_id = s.subtype_id"""
ALL_OBJECTS = "obj AS (SELECT model_id, object_type_id AS entity_id FROM object_types)"


@_query("q04_entity_detail", _DETAIL, _PLAYED, ALL_OBJECTS)
def q04(t: Tables):
    return Q.entity_detail(catalog(t))


@_query("q04_entity_detail_by_name", _DETAIL, _PLAYED, entity("ORDER 5", "obj"))
def q04_named(t: Tables):
    return Q.entity_detail(catalog(t), "ORDER 5")


@_query("q05_fact_type_detail", """SELECT model_id, fact_type_id, 'role' AS section, role_id AS item_id, player AS item FROM pl
  UNION ALL SELECT r.model_id, r.fact_type_id, 'reading', CAST(r.pos AS VARCHAR), replace(replace(replace(template, '{0}', p0), '{1}', coalesce(p1, '{1}')), '{2}', coalesce(p2, '{2}'))
    FROM readings r JOIN (SELECT model_id, fact_type_id, max(player) FILTER (pos = 0) AS p0, max(player) FILTER (pos = 1) AS p1, max(player) FILTER (pos = 2) AS p2 FROM pl GROUP BY ALL) USING (model_id, fact_type_id)
  UNION ALL SELECT model_id, fact_type_id, 'constraint', constraint_id, type FROM constraints
  UNION ALL SELECT DISTINCT model_id, fact_type_id, 'objectified', fact_type_id, 'true' FROM objectified JOIN fact_types USING (model_id, fact_type_id)""", PLAYERS)
def q05(t: Tables):
    return Q.fact_type_detail(catalog(t))


@_query("q06_fact_types_of", "SELECT model_id, entity_id, f.fact_type_id, f.name FROM pd JOIN fact_types f USING (model_id, fact_type_id) JOIN obj USING (model_id, entity_id)", _PLAYED, ALL_OBJECTS)
def q06(t: Tables):
    return Q.fact_types_of(catalog(t))


@_query("q07_related_entities", """SELECT DISTINCT a.model_id, a.entity_id, b.entity_id AS object_type_id, o.name FROM pd a JOIN obj USING (model_id, entity_id) JOIN pd b ON b.model_id = a.model_id AND b.fact_type_id = a.fact_type_id AND b.entity_id <> a.entity_id
  JOIN object_types o ON o.model_id = b.model_id AND o.object_type_id = b.entity_id""", _PLAYED, ALL_OBJECTS)
def q07(t: Tables):
    return Q.related_entities(catalog(t))


@_query("q08_constraints_of_fact_type", "SELECT model_id, fact_type_id, constraint_id, type FROM fct JOIN constraints USING (model_id, fact_type_id)", fact(FOCUS_FACT))
def q08(t: Tables):
    return Q.constraints_of(catalog(t), FOCUS_FACT)


@_query("q08_constraints_of_entity", "SELECT model_id, fact_type_id, constraint_id, type FROM pd JOIN ent USING (model_id, entity_id) JOIN constraints USING (model_id, fact_type_id)", _PLAYED, entity("order 7"))
def q08_entity(t: Tables):
    return Q.constraints_of(catalog(t), "order 7")


_UP = "up AS (SELECT model_id, subtype_id AS a, supertype_id AS b FROM subtype_facts UNION SELECT up.model_id, up.a, s.supertype_id FROM up JOIN subtype_facts s ON s.model_id = up.model_id AND s.subtype_id = up.b)"


def _named(far: str, near: str, source: str) -> str:
    return f"""SELECT DISTINCT s.model_id, s.{near} AS entity_id, s.{far} AS object_type_id, o.name FROM {source} s JOIN object_types o ON o.model_id = s.model_id AND o.object_type_id = s.{far}
  JOIN object_types e ON e.model_id = s.model_id AND e.object_type_id = s.{near} WHERE s.{near} <> s.{far}"""


@_query("q09_subtypes_direct", _named("subtype_id", "supertype_id", "subtype_facts"))
def q09(t: Tables):
    return Q.subtypes_of(catalog(t))


@_query("q09_subtypes_transitive", _named("a", "b", "up"), _UP)
def q09_all(t: Tables):
    return Q.subtypes_of(catalog(t), transitive=True)


@_query("q10_supertypes_direct", _named("supertype_id", "subtype_id", "subtype_facts"))
def q10(t: Tables):
    return Q.supertypes_of(catalog(t))


@_query("q10_supertypes_transitive", _named("b", "a", "up"), _UP)
def q10_all(t: Tables):
    return Q.supertypes_of(catalog(t), transitive=True)


@_query("q11_mandatory_roles", """SELECT c.model_id, c.fact_type_id, constraint_id, role_id, player_id, player FROM constraints c JOIN pl ON pl.model_id = c.model_id AND pl.fact_type_id = c.fact_type_id AND pl.role_id = c.role_ids[1] WHERE type = 'mandatory'""", PLAYERS)
def q11(t: Tables):
    return Q.mandatory_roles(catalog(t))


_STEP = "st AS (SELECT DISTINCT a.model_id, a.player_id AS a, b.player_id AS b FROM roles a JOIN roles b ON a.model_id = b.model_id AND a.fact_type_id = b.fact_type_id AND a.player_id <> b.player_id)"


@_query("q12_shortest_path_length", """SELECT e.model_id, d IS NOT NULL AS found, coalesce(d, 0) AS hops FROM (SELECT ent.model_id, ent.entity_id AS a, fin.entity_id AS b FROM ent JOIN fin USING (model_id)) e
  LEFT JOIN (SELECT model_id, node, min(d) AS d FROM wk GROUP BY ALL) w ON w.model_id = e.model_id AND w.node = e.b""",
        _STEP, entity("Order 3"), entity("Order 40", "fin"), "wk AS (SELECT model_id, entity_id AS node, 0 AS d FROM ent UNION SELECT wk.model_id, st.b, d + 1 FROM wk JOIN st ON st.model_id = wk.model_id AND st.a = wk.node WHERE d < 40)")
def q12(t: Tables):
    return Q.shortest_paths(catalog(t), "Order 3", "Order 40").select("model_id", "found", "hops")


# Breadth first: objects reached for the first time, each with the least path by positions; what is reached is not entered again.
_POSITIONS = """sp AS MATERIALIZED (SELECT x.model_id, x.fact_type_id, x.player_id AS a, z.player_id AS b, [CAST(f.seq AS BIGINT), x.pos, z.pos] AS place FROM roles x JOIN roles z ON z.model_id = x.model_id AND z.fact_type_id = x.fact_type_id
  AND x.pos <> z.pos AND x.player_id <> z.player_id JOIN fact_types f ON f.model_id = x.model_id AND f.fact_type_id = x.fact_type_id WHERE x.model_id IN (SELECT model_id FROM ent) AND x.model_id IN (SELECT model_id FROM fin))"""
_BREADTH = """bf(model_id, node, place, steps) USING KEY (model_id, node) AS (SELECT model_id, entity_id, CAST([] AS BIGINT[]), CAST([] AS STRUCT(f VARCHAR, a VARCHAR, b VARCHAR)[]) FROM ent
  UNION SELECT y.model_id, y.node, min(y.place), arg_min(y.steps, y.place) FROM (SELECT bf.model_id, sp.b AS node, list_concat(bf.place, sp.place) AS place, list_append(bf.steps, struct_pack(f := sp.fact_type_id, a := sp.a, b := sp.b)) AS steps
    FROM bf JOIN sp ON sp.model_id = bf.model_id AND sp.a = bf.node) y ANTI JOIN recurring.bf o ON o.model_id = y.model_id AND o.node = y.node GROUP BY y.model_id, y.node)"""


@_query("q12_shortest_path", """SELECT model_id, steps IS NOT NULL AS found, CAST(step - 1 AS INTEGER) AS step, steps[step].f AS fact_type_id, steps[step].a AS "from", steps[step].b AS "to"
  FROM (SELECT ent.model_id, bf.steps, unnest(CASE WHEN len(bf.steps) > 0 THEN range(1, len(bf.steps) + 1) ELSE [NULL] END) AS step FROM ent JOIN fin USING (model_id) LEFT JOIN bf ON bf.model_id = fin.model_id AND bf.node = fin.entity_id)""",
        entity("Order 3"), entity("Order 40", "fin"), _POSITIONS, _BREADTH)
def q12_steps(t: Tables):
    return Q.shortest_paths(catalog(t), "Order 3", "Order 40").select("model_id", "found", F.posexplode_outer("steps").alias("step", "s")).select("model_id", "found", "step", "s.fact_type_id", "s.from", "s.to")


@_query("q13_anchors", """SELECT o.model_id, o.object_type_id AS entity_id, o.name AS entity_name, reference_mode, c.fact_type, CASE WHEN c.fact_type IS NOT NULL THEN coalesce(p.names, '') END AS identified_by, c.fact_type IS NULL AS missing_identifier
  FROM object_types o LEFT JOIN ch c ON c.model_id = o.model_id AND c.player_id = o.object_type_id
  LEFT JOIN (SELECT ch.model_id, ch.player_id, string_agg(pl.player, ', ' ORDER BY pl.pos) AS names FROM ch JOIN pl ON pl.model_id = ch.model_id AND pl.fact_type_id = ch.fact_type_id AND pl.player_id <> ch.player_id GROUP BY ALL) p ON p.model_id = o.model_id AND p.player_id = o.object_type_id
  WHERE o.kind = 'entity'""", PLAYERS,
        "ch AS (SELECT r.model_id, r.player_id, min_by(f.fact_type_id, f.seq) AS fact_type_id, min_by(f.name, f.seq) AS fact_type FROM constraints c JOIN roles r ON r.model_id = c.model_id AND r.fact_type_id = c.fact_type_id AND list_contains(c.role_ids, r.role_id) JOIN fact_types f ON f.model_id = c.model_id AND f.fact_type_id = c.fact_type_id WHERE c.type = 'internal_uniqueness' AND c.is_preferred GROUP BY ALL)")
def q13(t: Tables):
    return Q.identification_anchors(catalog(t))


@_query("q13_anchor_mandatory_facts", """SELECT DISTINCT pl.model_id, player_id AS entity_id, f.name AS fact_type FROM constraints c JOIN pl ON pl.model_id = c.model_id AND pl.fact_type_id = c.fact_type_id AND pl.role_id = c.role_ids[1]
  JOIN fact_types f ON f.model_id = c.model_id AND f.fact_type_id = c.fact_type_id JOIN object_types o ON o.model_id = pl.model_id AND o.object_type_id = player_id AND kind = 'entity' WHERE type = 'mandatory'""", PLAYERS)
def q13_mandatory(t: Tables):
    return Q.anchor_mandatory_facts(catalog(t))


_FULL = """SELECT model_id, 'full' AS focus_kind, 'entity' AS section, object_type_id AS item_id, name AS item FROM object_types UNION ALL SELECT model_id, 'full', 'fact type', fact_type_id, name FROM fact_types
  UNION ALL SELECT model_id, 'full', 'constraint', constraint_id, type FROM constraints UNION ALL SELECT model_id, 'full', 'population', pop_id, fact_type_id FROM populations JOIN fact_types USING (model_id, fact_type_id)"""


@_query("q15_describe_full", _FULL)
def q15(t: Tables):
    return Q.describe(catalog(t))


_MODELS = "md AS (SELECT model_id FROM object_types UNION SELECT model_id FROM fact_types)"


def _described(kind: str, entities: str, constraints: str, missing: str, focus: str) -> str:
    return f"""SELECT x.model_id, '{kind}' AS focus_kind, 'entity' AS section, o.object_type_id AS item_id, o.name AS item FROM ({entities}) x JOIN object_types o ON o.model_id = x.model_id AND o.object_type_id = x.id
  UNION ALL SELECT model_id, '{kind}', 'fact type', fact_type_id, name FROM ff JOIN fact_types USING (model_id, fact_type_id)
  UNION ALL SELECT c.model_id, '{kind}', 'constraint', constraint_id, type FROM ff JOIN constraints c USING (model_id, fact_type_id) {constraints}
  UNION ALL SELECT p.model_id, '{kind}', 'population', pop_id, fact_type_id FROM ff JOIN populations p USING (model_id, fact_type_id)
  UNION ALL SELECT model_id, 'none', 'message', NULL, 'nothing matches the focus "{focus}"' FROM md WHERE {missing}"""


_INVOLVED = "SELECT DISTINCT model_id, player_id AS id FROM ff JOIN roles USING (model_id, fact_type_id)"


@_query("q15_describe_entity", _described("entity", "SELECT model_id, entity_id AS id FROM ent", "", "model_id NOT IN (SELECT model_id FROM ent)", "Order 9"),
        _PLAYED, _MODELS, entity("Order 9"), "ff AS (SELECT DISTINCT model_id, fact_type_id FROM pd JOIN ent USING (model_id, entity_id))")
def q15_entity(t: Tables):
    return Q.describe(catalog(t), "Order 9")


@_query("q15_describe_fact_type", _described("fact type", _INVOLVED, "", "model_id NOT IN (SELECT model_id FROM fct)", FOCUS_FACT), _MODELS, fact(FOCUS_FACT), "ff AS (SELECT model_id, fact_type_id FROM fct)")
def q15_fact_type(t: Tables):
    return Q.describe(catalog(t), FOCUS_FACT)


@_query("q15_describe_constraint_type", _described("constraint type", _INVOLVED, "WHERE contains(type, 'ring')", "FALSE", "ring"), _MODELS, "ff AS (SELECT DISTINCT model_id, fact_type_id FROM constraints WHERE contains(type, 'ring'))")
def q15_keyword(t: Tables):
    return Q.describe(catalog(t), "ring")


@_query("q16_neighbourhood", """SELECT DISTINCT model_id, section, element_id FROM (SELECT model_id, 'object type' AS section, p AS element_id FROM hp WHERE d <= 2
  UNION ALL SELECT hp.model_id, lk.section, lk.link FROM hp JOIN lk ON lk.model_id = hp.model_id AND lk.p = hp.p WHERE d <= 1)""", entity("Order 11"),
        "lk AS (SELECT DISTINCT model_id, 'fact type' AS section, fact_type_id AS link, player_id AS p FROM roles UNION SELECT model_id, 'subtype', subtype_fact_id, subtype_id FROM subtype_facts UNION SELECT model_id, 'subtype', subtype_fact_id, supertype_id FROM subtype_facts)",
        "hp AS (SELECT model_id, entity_id AS p, 0 AS d FROM ent UNION SELECT hp.model_id, b.p, d + 1 FROM hp JOIN lk a ON a.model_id = hp.model_id AND a.p = hp.p JOIN lk b ON b.model_id = a.model_id AND b.section = a.section AND b.link = a.link WHERE d < 2)")
def q16(t: Tables):
    return Q.neighbourhood(catalog(t), "Order 11", 2)


@_query("q17_not_found", """SELECT model_id, 'No entity or fact type named "small ring 3".' AS message FROM md WHERE model_id NOT IN (SELECT model_id FROM ent)""", _MODELS, entity("small ring 3"))
def q17(t: Tables):
    return Q.not_found(catalog(t), "small ring 3", "entity or fact type")


@_query("t01_by_name", "SELECT model_id, object_type_id, name, kind, reference_mode, definition FROM object_types ORDER BY model_id, lower(name), name")
def t01(t: Tables):
    return Q.list_entities(catalog(t))


@_query("t03_key_entities", """SELECT o.model_id, name, definition, greatest(n - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY model_id) AS n FROM object_types) o WHERE rn <= 10""")
def t03(t: Tables):
    return Q.key_entities(catalog(t))


@query("t04_newest", "SELECT event_id, ts FROM events ORDER BY ts DESC LIMIT 20")
def t04(t: Tables):
    return Q.newest(t.events.select("event_id", "ts"), "ts", 20)


@query("a19_population_summary", """SELECT source AS pop_id, count(*) AS instances, string_agg(doc_id || ',' || lang, ';' ORDER BY doc_id) FILTER (rn <= 5) AS first_rows
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""")
def a19(t: Tables):
    return Q.summarize_populations(facts(t, "document").rows("document"), ["dc_doc", "dc_lang"])


@query("p07_guided_types", "SELECT event_id, event_type AS name, CASE WHEN event_id % 5 = 0 THEN 'enum' ELSE 'class' END AS kind FROM events WHERE event_id % 5 = 0 OR lower(event_type) IN ('click', 'view')")
def p07(t: Tables):
    types = t.events.select("event_id", F.col("event_type").alias("name"), F.expr("CASE WHEN event_id % 5 = 0 THEN 'enum' ELSE 'class' END").alias("kind"))
    return Q.guided(types, t.events.filter("event_type IN ('click', 'view')").select(F.upper("event_type").alias("name")))


# ---- lint ------------------------------------------------------------------------------------------------

def _flat(df):
    return df.select("model_id", "rule_id", "severity", "element_id", F.array_join("subject", "|").alias("subject"))


def _row(rule: str, severity: str, element: str, subject: str, body: str) -> str:
    return f"SELECT model_id, '{rule}' AS rule_id, '{severity}' AS severity, CAST({element} AS VARCHAR) AS element_id, CAST({subject} AS VARCHAR) AS subject {body}"


LINT: dict[str, tuple[str, tuple[str, ...]]] = {}  # what each rule finds in any catalog: SELECT and the CTEs before it


def _lint(name: str, rule, *selects: str, ctes: tuple[str, ...] = ()):
    LINT[name] = (" UNION ALL ".join(selects), ctes)

    @_query(name, " UNION ALL ".join(selects), *ctes)
    def build(t: Tables):
        return _flat(rule(catalog(t)))


def _no(table: str, *pairs: str) -> str:
    """Anti-join condition against a table on model_id and the given equalities."""
    return f"NOT EXISTS (SELECT 1 FROM {table} z WHERE z.model_id = y.model_id AND {' AND '.join(pairs)})"


CR = "cr AS (SELECT y.*, EXISTS (SELECT 1 FROM roles z WHERE z.model_id = y.model_id AND z.fact_type_id = y.fact_type_id AND z.role_id = y.role_id) AS known FROM (SELECT model_id, fact_type_id, constraint_id, type, unnest(role_ids) AS role_id FROM constraints) y)"

_lint("l01_dangling_roles", L.dangling_roles, _row("structural/dangling-role-reference", "error", "fact_type_id", "role_id || '|' || player_id", f"FROM roles y WHERE {_no('object_types', 'z.object_type_id = y.player_id')}"))
_lint("l02_duplicate_names", L.duplicate_names, *[
    _row(f"structural/duplicate-{kind}-name", "error", id_, "name || '|' || f", f"FROM (SELECT *, row_number() OVER w AS rn, first_value({id_}) OVER w AS f FROM {table} WINDOW w AS (PARTITION BY model_id, name ORDER BY seq)) WHERE rn > 1")
    for kind, table, id_ in (("object-type", "object_types", "object_type_id"), ("fact-type", "fact_types", "fact_type_id"))])
_lint("l03_missing_inverse_reading", L.missing_inverse_reading, _row("structural/binary-missing-inverse-reading", "warning", "fact_type_id", "''",
      "FROM ar LEFT JOIN (SELECT model_id, fact_type_id, count(*) AS n FROM readings GROUP BY ALL) USING (model_id, fact_type_id) WHERE arity = 2 AND coalesce(n, 0) < 2"), ctes=(ARITY,))
_lint("l04_subtype_references", L.subtype_references, *[
    _row(f"structural/{rule}", "error", "subtype_fact_id", f"{end}_id", f"FROM (SELECT s.*, o.kind FROM subtype_facts s LEFT JOIN object_types o ON o.model_id = s.model_id AND o.object_type_id = s.{end}_id) WHERE {test}")
    for end in ("subtype", "supertype") for rule, test in ((f"subtype-dangling-{end}", "kind IS NULL"), ("subtype-not-entity", "kind <> 'entity'"))])
_lint("l05_subtype_cycle", L.subtype_cycles, _row("structural/subtype-cycle", "error", "model_id", "''", "FROM (SELECT DISTINCT model_id FROM up WHERE a = b)"), ctes=(_UP,))
_lint("l06_objectification", L.objectification,
      _row("structural/objectified-dangling-fact-type", "error", "objectified_id", "fact_type_id", f"FROM objectified y WHERE {_no('fact_types', 'z.fact_type_id = y.fact_type_id')}"),
      *[_row(f"structural/{rule}", "error", "objectified_id", "object_type_id", f"FROM (SELECT s.*, o.kind FROM objectified s LEFT JOIN object_types o USING (model_id, object_type_id)) WHERE {test}")
        for rule, test in (("objectified-dangling-object-type", "kind IS NULL"), ("objectified-not-entity", "kind <> 'entity'"))],
      *[_row(f"structural/{rule}", "error", "objectified_id", col, f"FROM (SELECT *, row_number() OVER (PARTITION BY model_id, {col} ORDER BY seq) AS rn FROM objectified) WHERE rn > 1")
        for rule, col in (("duplicate-objectification", "fact_type_id"), ("duplicate-objectification-target", "object_type_id"))])
_lint("l07_invalid_roles", L.invalid_roles, *[_row(rule, "error", "fact_type_id", "role_id", f"FROM cr WHERE type = '{kind}' AND NOT known") for kind, rule in L.INVALID_ROLE_RULES.items()], ctes=(CR,))
_lint("l08_spanning_uniqueness", L.spanning_uniqueness, *[
    _row("constraint/spanning-all-roles", sev, "fact_type_id", "''", f"FROM (SELECT c.model_id, c.fact_type_id, arity FROM constraints c JOIN ar USING (model_id, fact_type_id) WHERE type = 'internal_uniqueness' AND len(role_ids) = arity AND (model_id, constraint_id) NOT IN (SELECT (model_id, constraint_id) FROM cr WHERE NOT known)) WHERE {test}")
    for sev, test in (("info", "arity = 2"), ("warning", "arity > 2"))], ctes=(ARITY, CR))
_lint("l09_local_external_uniqueness", L.local_external_uniqueness, _row("constraint/external-uniqueness-all-local", "warning", "fact_type_id", "''",
      "FROM (SELECT model_id, fact_type_id, constraint_id FROM cr WHERE type = 'external_uniqueness' GROUP BY ALL HAVING bool_and(known))"), ctes=(CR,))
_lint("l10_too_few_roles", L.too_few_roles, *[_row(rule, "error", "fact_type_id", "''", f"FROM constraints WHERE type = '{kind}' AND len(role_ids) < 2") for kind, rule in L.TOO_FEW_RULES.items()])
_lint("l11_arity_mismatch", L.arity_mismatch, *[_row(rule, "error", "fact_type_id", "''", f"FROM constraints WHERE type = '{kind}' AND len(role_ids) <> len(role_ids_2)") for kind, rule in L.MISMATCH_RULES.items()])
_lint("l12_ring_players", L.ring_players, _row("constraint/ring-different-players", "error", "fact_type_id", "least(p, q) || '|' || greatest(p, q)",
      "FROM (SELECT c.model_id, c.fact_type_id, a.player_id AS p, b.player_id AS q FROM constraints c JOIN roles a ON a.model_id = c.model_id AND a.fact_type_id = c.fact_type_id AND a.role_id = c.role_ids[1] JOIN roles b ON b.model_id = c.model_id AND b.fact_type_id = c.fact_type_id AND b.role_id = c.role_ids[2] WHERE c.type = 'ring') WHERE p <> q"))
_lint("l13_frequency_bounds", L.frequency_bounds, *[_row(f"constraint/frequency-{rule}", "error", "fact_type_id", "''", f"FROM constraints WHERE type = 'frequency' AND {test}")
      for rule, test in (("empty-roles", "len(role_ids) = 0"), ("invalid-min", "min < 1"), ("max-less-than-min", "max < min"))])
_lint("l14_cardinality_shape", L.cardinality_shape,
      _row("constraint/cardinality-non-unary", "error", "fact_type_id", "''", "FROM constraints JOIN ar USING (model_id, fact_type_id) WHERE type = 'cardinality' AND arity <> 1"),
      _row("constraint/cardinality-max-less-than-min", "error", "fact_type_id", "''", "FROM constraints WHERE type = 'cardinality' AND max < min"), ctes=(ARITY,))
_lint("l15_missing_metadata", L.missing_metadata,
      _row("completeness/missing-object-type-definition", "info", "object_type_id", "''", "FROM object_types WHERE definition IS NULL"),
      _row("completeness/missing-value-type-data-type", "info", "object_type_id", "''", "FROM object_types WHERE kind = 'value' AND data_type IS NULL"))
_lint("l16_unconstrained_fact_types", L.unconstrained_fact_types,
      _row("completeness/fact-type-without-constraints", "warning", "fact_type_id", "''", f"FROM fact_types y WHERE {_no('constraints', 'z.fact_type_id = y.fact_type_id')}"),
      _row("completeness/fact-type-without-uniqueness", "warning", "fact_type_id", "''", f"""FROM fact_types y JOIN ar USING (model_id, fact_type_id) WHERE arity >= 2 AND NOT {_no('constraints', 'z.fact_type_id = y.fact_type_id')} AND {_no('constraints', 'z.fact_type_id = y.fact_type_id', "z.type = 'internal_uniqueness'")}"""), ctes=(ARITY,))
_lint("l17_isolated_object_types", L.isolated_object_types, _row("completeness/isolated-object-type", "info", "object_type_id", "''", f"FROM object_types y WHERE NOT independent AND {_no('roles', 'z.player_id = y.object_type_id')}"))
_lint("l18_preferred_identifiers", L.preferred_identifiers,
      _row("completeness/missing-preferred-identifier", "info", "object_type_id", "''", f"FROM object_types y WHERE kind = 'entity' AND {_no('idn', 'z.o = y.object_type_id')}"),
      _row("completeness/multiple-preferred-identifiers", "warning", "object_type_id", "n", "FROM pc JOIN object_types o USING (model_id, object_type_id) WHERE o.kind = 'entity' AND n > 1"),
      ctes=("pc AS (SELECT p.model_id, p.player_id AS object_type_id, count(*) AS n FROM (SELECT DISTINCT model_id, fact_type_id, player_id FROM roles) p JOIN constraints c USING (model_id, fact_type_id) WHERE c.type = 'internal_uniqueness' AND c.is_preferred GROUP BY ALL)",
            "idn AS (SELECT model_id, object_type_id AS o FROM pc JOIN object_types USING (model_id, object_type_id) WHERE kind = 'entity' UNION SELECT s.model_id, s.subtype_id FROM idn JOIN subtype_facts s ON s.model_id = idn.model_id AND s.supertype_id = idn.o WHERE s.provides_identification)"))
# Operands have one step here, so the SQL can state the walk directly.
_lint("l19_join_operands", L.join_operands,
      _row("constraint/join-too-few-operands", "error", "constraint_id", "''", "FROM (SELECT model_id, constraint_id FROM operands WHERE type <> 'join_subset' GROUP BY ALL HAVING count(*) < 2)"),
      *[_row(f"constraint/join-{f}", "error", "constraint_id", "operand", f"FROM jf WHERE fault = '{f}'") for f in ("unknown-root", "bad-step", "discontiguous", "bad-projection", "empty-projection")],
      _row("constraint/join-arity-mismatch", "error", "constraint_id", "''", "FROM js WHERE lo <> hi"),
      _row("constraint/join-column-type-mismatch", "error", "constraint_id", "col", "FROM (SELECT model_id, constraint_id, col FROM (SELECT jf.model_id, jf.constraint_id, generate_subscripts(projection, 1) - 1 AS col, unnest(list_transform(projection, lambda p: [root, xp][p + 1])) AS t FROM jf JOIN js USING (model_id, constraint_id) WHERE lo = hi) GROUP BY ALL HAVING count(DISTINCT t) > 1)"),
      ctes=("jf AS (SELECT y.*, CASE WHEN NOT EXISTS (SELECT 1 FROM object_types z WHERE z.model_id = y.model_id AND z.object_type_id = y.root) THEN 'unknown-root' WHEN ep IS NULL OR xp IS NULL OR ef <> xf THEN 'bad-step' WHEN ep <> root THEN 'discontiguous' WHEN list_max(projection) > 1 THEN 'bad-projection' WHEN len(projection) = 0 THEN 'empty-projection' END AS fault FROM (SELECT o.*, a.player_id AS ep, a.fact_type_id AS ef, b.player_id AS xp, b.fact_type_id AS xf FROM operands o LEFT JOIN roles a ON a.model_id = o.model_id AND a.role_id = steps[1].entry LEFT JOIN roles b ON b.model_id = o.model_id AND b.role_id = steps[1].exit) y)",
            "js AS (SELECT model_id, constraint_id, min(len(projection)) AS lo, max(len(projection)) AS hi FROM jf GROUP BY ALL HAVING count(fault) = 0)"))
_lint("l20_derivations", L.derivations,
      _row("derivation/missing-rule", "warning", "fact_type_id", "''", "FROM fact_types WHERE derivation_kind IS NOT NULL AND trim(coalesce(derivation_rule, '')) = ''"),
      _row("derivation/missing-rule", "warning", "subtype_fact_id", "''", "FROM subtype_facts WHERE derivation_kind IS NOT NULL AND trim(coalesce(derivation_rule, '')) = ''"),
      _row("derivation/derived-with-population", "warning", "fact_type_id", "''", f"FROM fact_types y WHERE derivation_kind = 'derived' AND derivation_storage IS NULL AND NOT {_no('populations', 'z.fact_type_id = y.fact_type_id')}"))

# Every order is a domain, a mapping and a product of its project. Contexts from d64 on, and those of keys without an order, are nobody's.
_DOMAINS = "SELECT CAST(floor(o_orderkey / 64.0) AS BIGINT) AS project_id, concat('d', o_orderkey % 64) AS context, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_orderkey / 64.0) AS BIGINT) END AS model_id FROM orders"
_MAPPINGS = "SELECT CAST(floor(k / 64.0) AS BIGINT) AS project_id, concat('map/', k, '.yaml') AS path, concat('d', part % 70) AS source_context, concat('d', supp % 70) AS target_context, concat('Order ', part % 70) AS source_name, concat('Order ', supp % 70) AS target_name FROM l WHERE n = 1"
_PRODUCTS = "SELECT CAST(floor(o_orderkey / 64.0) AS BIGINT) AS project_id, concat('product/', o_orderkey) AS path, {array}(concat('d', o_custkey % 70), concat('d', o_orderkey % 5)) AS domains, {array}(concat('map/', o_orderkey, '.yaml'), CAST(o_orderkey AS {text}), concat('zzz', o_orderkey)) AS mappings FROM orders"


def _project(rule: str, severity: str, subject: str, body: str) -> str:
    return f"SELECT project_id, 'project/{rule}' AS rule_id, '{severity}' AS severity, path AS element_id, {subject} AS subject {body}"


_PROJECT_CTES = (f"dm AS ({_DOMAINS})", f"mp AS ({_MAPPINGS})", "pr AS (" + _PRODUCTS.replace("{array}", "list_value").replace("{text}", "VARCHAR") + ")")


@_query("l21_project_mappings_all", " UNION ALL ".join(
    [_project(f"mapping-{end}-context-missing", "error", f"{end}_context", f"FROM mp WHERE (project_id, {end}_context) NOT IN (SELECT (project_id, context) FROM dm)") for end in ("source", "target")]
    + [_project(f"entity-mapping-{end}-missing", "error", f"{end}_name", f"FROM (SELECT mp.*, dm.model_id FROM mp JOIN dm ON dm.project_id = mp.project_id AND dm.context = mp.{end}_context WHERE dm.model_id IS NOT NULL) y WHERE {_no('object_types', f'z.name = y.{end}_name')}") for end in ("source", "target")]), *_PROJECT_CTES)
def l21(t: Tables):
    cat = catalog(t)
    lines = _lines(t)
    mp = t.spark.sql(_MAPPINGS.replace("FROM l ", "FROM {l} "), l=lines)
    dm = t.spark.sql(_DOMAINS.replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return L.project_mappings(dm, mp.select("project_id", "path", "source_context", "target_context"), mp.select("project_id", "path", "source_name", "target_name"), cat.object_types)


@_query("l21_project_products_all", " UNION ALL ".join([
    _project("product-domain-dependency-missing", "error", "dep", "FROM (SELECT project_id, path, unnest(domains) AS dep FROM pr) WHERE (project_id, dep) NOT IN (SELECT (project_id, context) FROM dm)"),
    _project("product-mapping-dependency-unresolved", "warning", "dep", "FROM (SELECT project_id, path, unnest(mappings) AS dep FROM pr) y WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.project_id = y.project_id AND contains(mp.path, y.dep))")]), *_PROJECT_CTES)
def l21_products(t: Tables):
    mp = t.spark.sql(_MAPPINGS.replace("FROM l ", "FROM {l} "), l=_lines(t))
    dm = t.spark.sql(_DOMAINS.replace("FROM orders", "FROM {orders}"), orders=t.orders)
    pr = t.spark.sql(_PRODUCTS.replace("{array}", "array").replace("{text}", "STRING").replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return L.project_products(dm, mp, pr)


def _lines(t: Tables):
    from factloom.workloads.catalog_data import LINES
    return t.spark.sql(LINES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem)


@_query("c05_external_join_keys", """SELECT model_id, constraint_id, min(player_id) AS player_id FROM (SELECT c.model_id, c.constraint_id, r.player_id FROM ex c JOIN roles r ON r.model_id = c.model_id AND r.fact_type_id = c.fact_type_id AND r.role_id <> c.role_id
    WHERE (c.model_id, c.constraint_id) IN (SELECT (model_id, constraint_id) FROM ex GROUP BY model_id, constraint_id, n HAVING n >= 2 AND count(*) = n AND count(DISTINCT fact_type_id) = n)
      AND (c.model_id, c.constraint_id, r.player_id) NOT IN (SELECT (model_id, constraint_id, player_id) FROM ex)
    GROUP BY c.model_id, c.constraint_id, c.n, r.player_id HAVING count(*) = c.n AND count(DISTINCT r.fact_type_id) = c.n) GROUP BY ALL HAVING count(*) = 1""",
        "ex AS (SELECT y.model_id, y.constraint_id, y.n, r.role_id, r.fact_type_id, r.player_id FROM (SELECT model_id, constraint_id, len(role_ids) AS n, unnest(role_ids) AS role_id FROM constraints WHERE type = 'external_uniqueness') y JOIN roles r ON r.model_id = y.model_id AND r.role_id = y.role_id)")
def c05(t: Tables):
    return L.external_join_keys(catalog(t))
