"""Diff, merge, history, lineage and partitioning of the derived corpus."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from factloom.operators import diff as D, lineage as G, mapping as M, partition as P
from factloom.operators.sequences import extreme_rows, next_value
from factloom.sources.catalog import Catalog, with_tables
from factloom.workloads.catalog_data import catalog, with_catalog
from factloom.workloads.mapping import _ALL as MAPPING_CTES
from factloom.workloads.registry import Tables, query

# The next revision of every model: elements dropped, renamed and changed by their position.
_VID = "CASE WHEN regexp_like({0}, '^[ops][0-9]+$') AND CAST(substring({0}, length({0}), 1) AS INT) % 2 = 0 THEN concat({0}, 'v') ELSE {0} END"
REVISED = {
    "object_types": f"""SELECT model_id, {_VID.format('object_type_id')} AS object_type_id, CASE WHEN seq % 13 = 0 THEN concat(name, ' new') ELSE name END AS name, CASE WHEN seq % 17 = 0 THEN 'value' ELSE kind END AS kind,
      CASE WHEN seq % 19 = 0 THEN NULL ELSE reference_mode END AS reference_mode, CASE WHEN seq % 5 = 0 THEN 'rewritten' ELSE definition END AS definition, CASE WHEN seq % 7 = 0 THEN 'uuid' ELSE data_type END AS data_type, length,
      CASE WHEN seq % 23 = 0 THEN NULL ELSE scale END AS scale, CASE WHEN seq % 26 = 0 THEN {{array}}(name) ELSE aliases END AS aliases, CASE WHEN seq % 9 = 0 AND allowed IS NOT NULL THEN {{array}}('a', 'z') ELSE allowed END AS allowed, independent, seq FROM object_types WHERE seq % 11 <> 0""",
    "fact_types": "SELECT model_id, fact_type_id, CASE WHEN seq % 13 = 0 THEN concat(name, ' new') ELSE name END AS name, derivation_kind, CASE WHEN seq % 6 = 0 AND derivation_kind IS NOT NULL THEN 'changed' ELSE derivation_rule END AS derivation_rule, derivation_storage, seq FROM fact_types WHERE seq % 11 <> 0",
    "roles": f"SELECT model_id, fact_type_id, role_id, pos, CASE WHEN pos = 1 AND length(fact_type_id) % 3 = 0 THEN 'in' ELSE name END AS name, {_VID.format('player_id')} AS player_id FROM roles",
    "readings": "SELECT model_id, fact_type_id, pos, CASE WHEN length(fact_type_id) % 4 = 0 THEN replace(template, 'has', 'holds') ELSE template END AS template FROM readings",
    "constraints": "SELECT model_id, fact_type_id, ord, constraint_id, type, CASE WHEN type = 'mandatory' AND model_id % 5 = 0 THEN 'deontic' ELSE modality END AS modality, role_ids, role_ids_2, min, max, ring_type, operator, allowed, is_preferred FROM constraints WHERE NOT (type = 'ring' AND length(fact_type_id) % 3 = 0)",
    "operands": f"SELECT model_id, fact_type_id, constraint_id, type, operand, {_VID.format('root')} AS root, steps, projection FROM operands WHERE operand = 0 OR model_id % 2 = 0",
}
_STORED: dict[tuple[str, str], Catalog] = {}


def revised(t: Tables) -> Catalog:
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORED:
        cat = catalog(t)

        def build(name: str):
            text = re.sub(rf"\bFROM {name}\b", "FROM {" + name + "}", REVISED[name].replace("{array}", "array").replace("^[ops][0-9]+$", "^[ops][0-9]+$"))
            return cat.store(t.spark.sql(text, **{name: getattr(cat, name)}), f"{name}-b")

        _STORED[key] = with_tables(cat, build, *REVISED)
    return _STORED[key]


_B = tuple(f"{n}_b AS (" + sql.replace("{array}", "list_value").replace("regexp_like(", "regexp_matches(") + ")" for n, sql in REVISED.items())


def _query(name: str, select: str | None, *ctes: str):
    return query(name, None if select is None else with_catalog(select, *_B, *ctes))


# ---- deltas ---------------------------------------------------------------------------------------------

_LAST = "(SELECT DISTINCT ON (model_id, name) * FROM {0} ORDER BY model_id, name, seq DESC)"


def _typed(x: str) -> str:
    return f"{x}.data_type || CASE WHEN {x}.length IS NULL THEN '' WHEN {x}.scale IS NULL THEN '(' || {x}.length || ')' ELSE '(' || {x}.length || ',' || {x}.scale || ')' END"


def _sorted(x: str) -> str:
    return f"coalesce(list_aggregate(list_sort({x}), 'string_agg', ','), '')"


def _delta(element: str, table: str, changes: list[tuple[str, str, int]]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN struct_pack(t := {text}, l := {level}) END" for test, text, level in changes)
    return f"""SELECT model_id, '{element}' AS element_type, name, kind, array_to_string(list_transform(ch, lambda c: c.t), '; ') AS changes,
      CASE WHEN kind = 'removed' THEN 'breaking' ELSE ['safe', 'caution', 'breaking'][coalesce(list_max(list_transform(ch, lambda c: c.l)), 0) + 1] END AS breaking_level FROM (
      SELECT *, CASE WHEN NOT inb THEN 'removed' WHEN NOT ina THEN 'added' WHEN len(found) > 0 THEN 'modified' ELSE 'unchanged' END AS kind, CASE WHEN ina AND inb THEN found ELSE [] END AS ch FROM (
      SELECT coalesce(a.model_id, b.model_id) AS model_id, coalesce(a.name, b.name) AS name, a.model_id IS NOT NULL AS ina, b.model_id IS NOT NULL AS inb, list_filter([{cases}], lambda c: c IS NOT NULL) AS found
      FROM {_LAST.format(table)} a FULL JOIN {_LAST.format(table + '_b')} b ON a.model_id = b.model_id AND a.name = b.name))"""


_NONE = "coalesce({0}, '(none)')"
OBJECT_DELTAS = _delta("object_type", "object_types", [
    ("a.kind <> b.kind", "'kind: ' || a.kind || ' -> ' || b.kind", 2),
    ("coalesce(a.reference_mode, '') <> coalesce(b.reference_mode, '')", f"'reference mode: ' || {_NONE.format('a.reference_mode')} || ' -> ' || {_NONE.format('b.reference_mode')}", 1),
    ("coalesce(a.definition, '') <> coalesce(b.definition, '')", "'definition changed'", 0),
    (f"{_sorted('a.allowed')} <> {_sorted('b.allowed')}", "'value constraint changed'", 1),
    (f"{_sorted('a.aliases')} <> {_sorted('b.aliases')}", "'aliases changed'", 0),
    ("a.data_type IS NOT NULL AND b.data_type IS NOT NULL AND (a.data_type, a.length, a.scale) IS DISTINCT FROM (b.data_type, b.length, b.scale)", f"'data type: ' || {_typed('a')} || ' -> ' || {_typed('b')}", 1),
    ("a.data_type IS NOT NULL AND b.data_type IS NULL", f"'data type removed: ' || {_typed('a')}", 1),
    ("a.data_type IS NULL AND b.data_type IS NOT NULL", f"'data type added: ' || {_typed('b')}", 1),
])


def _keys_cte(suffix: str) -> str:
    r, c, o = f"roles{suffix}", f"constraints{suffix}", f"operands{suffix}"
    places = f"(SELECT model_id, fact_type_id, role_id AS rid, min(pos) AS pos FROM {r} GROUP BY ALL)"
    lists = f"""(SELECT model_id, fact_type_id, constraint_id, list(coalesce(CAST(pos AS VARCHAR), rid) ORDER BY i) AS ps FROM (
      SELECT model_id, fact_type_id, constraint_id, unnest({{0}}) AS rid, generate_subscripts({{0}}, 1) AS i FROM {c}) LEFT JOIN {places} USING (model_id, fact_type_id, rid) GROUP BY ALL)"""
    j = "coalesce(array_to_string({0}, ','), '')"
    so, un = j.format("a.ps"), j.format("list_sort(a.ps)")
    paths = f"(SELECT model_id, fact_type_id, constraint_id, string_agg(x, '::' ORDER BY CASE WHEN type = 'join_subset' THEN operand END, x) AS paths FROM (SELECT *, root || '|' || array_to_string(list_transform(steps, lambda s: s.entry || '>' || s.exit), ',') || '#' || array_to_string(projection, ',') AS x FROM {o}) GROUP BY ALL)"
    return f"""ck{suffix} AS MATERIALIZED (SELECT c.model_id, c.fact_type_id, c.constraint_id, c.type, CASE c.type
      WHEN 'internal_uniqueness' THEN 'IU:' || {un} || ':' || CASE WHEN is_preferred THEN 'P' ELSE '' END WHEN 'mandatory' THEN 'M:' || {un} WHEN 'external_uniqueness' THEN 'EU:' || {un} WHEN 'value_constraint' THEN 'VC:' || {un} || ':' || {_sorted('allowed')}
      WHEN 'disjunctive_mandatory' THEN 'DM:' || {un} WHEN 'exclusion' THEN 'EX:' || {un} WHEN 'exclusive_or' THEN 'XO:' || {un} WHEN 'subset' THEN 'SUB:' || {so} || ':' || {j.format('b.ps')} WHEN 'equality' THEN 'EQ:' || {so} || ':' || {j.format('b.ps')}
      WHEN 'ring' THEN 'RING:' || {so} || ':' || ring_type WHEN 'frequency' THEN 'FREQ:' || {un} || ':' || coalesce(CAST(min AS VARCHAR), '') || ':' || coalesce(CAST(max AS VARCHAR), 'unbounded') WHEN 'cardinality' THEN 'CARD:' || {un} || ':' || coalesce(CAST(min AS VARCHAR), '') || ':' || coalesce(CAST(max AS VARCHAR), 'unbounded')
      WHEN 'join_subset' THEN 'JSUB:' || coalesce(paths, '') WHEN 'join_equality' THEN 'JEQ:' || coalesce(paths, '') ELSE 'JEXC:' || coalesce(paths, '') END || CASE WHEN modality = 'deontic' THEN '|deontic' ELSE '' END AS key
      FROM {c} c LEFT JOIN {lists.format('role_ids')} a USING (model_id, fact_type_id, constraint_id) LEFT JOIN {lists.format('role_ids_2')} b USING (model_id, fact_type_id, constraint_id) LEFT JOIN {paths} p USING (model_id, fact_type_id, constraint_id))"""


def _shape_cte(suffix: str) -> str:
    return f"""fs{suffix} AS MATERIALIZED (SELECT f.model_id, f.fact_type_id, f.name, f.seq, r.players, r.role_names, coalesce(rd.t, '') AS readings, coalesce(k.ks, []) AS ks, coalesce(derivation_kind || '|' || coalesce(derivation_storage, 'derive_on_request') || '|' || coalesce(derivation_rule, ''), '') AS derivation
      FROM fact_types{suffix} f LEFT JOIN (SELECT x.model_id, x.fact_type_id, list(coalesce(o.name, x.player_id) ORDER BY pos) AS players, list(x.name ORDER BY pos) AS role_names FROM roles{suffix} x LEFT JOIN object_types{suffix} o ON o.model_id = x.model_id AND o.object_type_id = x.player_id GROUP BY ALL) r USING (model_id, fact_type_id)
      LEFT JOIN (SELECT model_id, fact_type_id, string_agg(template, ' | ' ORDER BY pos) AS t FROM readings{suffix} GROUP BY ALL) rd USING (model_id, fact_type_id)
      LEFT JOIN (SELECT model_id, fact_type_id, list(struct_pack(key := key, type := type)) AS ks FROM ck{suffix} GROUP BY ALL) k USING (model_id, fact_type_id))"""


def _kinds(mine: str, other: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter({mine}.ks, lambda c: NOT list_contains(list_transform({other}.ks, lambda d: d.key), c.key)), lambda c: c.type)))"


SHAPES = (_keys_cte(""), _keys_cte("_b"), _shape_cte(""), _shape_cte("_b"))
_SAME = "len(a.players) = len(b.players)"
FACT_DELTAS = _delta("fact_type", "fs", [
    (f"NOT {_SAME}", "'arity: ' || len(a.players) || ' -> ' || len(b.players)", 2),
    ("a.readings <> b.readings", "'readings changed'", 0),
    (f"len({_kinds('b', 'a')}) > 0", f"'constraints added: ' || array_to_string({_kinds('b', 'a')}, ', ')", 1),
    (f"len({_kinds('a', 'b')}) > 0", f"'constraints removed: ' || array_to_string({_kinds('a', 'b')}, ', ')", 1),
    ("a.derivation <> b.derivation", "'derivation changed'", 1),
    *[(f"{_SAME} AND a.players[{i}] <> b.players[{i}]", f"'role {i - 1}: player ' || a.players[{i}] || ' -> ' || b.players[{i}]", 2) for i in (1, 2, 3)],
    *[(f"{_SAME} AND a.role_names[{i}] <> b.role_names[{i}]", f"'role {i - 1}: name ' || a.role_names[{i}] || ' -> ' || b.role_names[{i}]", 0) for i in (1, 2, 3)],
])


def _joined(df):
    return df.select("model_id", "element_type", "name", "kind", F.array_join("changes", "; ").alias("changes"), "breaking_level")


@_query("d01_object_type_deltas", OBJECT_DELTAS)
def d01(t: Tables):
    return _joined(D.object_type_deltas(catalog(t), revised(t)))


@_query("d02_fact_type_deltas", FACT_DELTAS, *SHAPES)
def d02(t: Tables):
    return _joined(D.fact_type_deltas(catalog(t), revised(t)))


# Every document is a term on both sides; some are named otherwise on one of them, and so removed, added or both.
_GLOSSARY = "SELECT doc_id % 7 AS model_id, concat(CASE WHEN doc_id % 9 = 1 THEN 'old term ' ELSE 'term ' END, doc_id) AS name, text AS definition, CASE WHEN doc_id % 4 <> 0 THEN lang END AS context, doc_id AS seq FROM documents"
_GLOSSARY_B = "SELECT doc_id % 7 AS model_id, concat(CASE WHEN doc_id % 10 = 1 THEN 'new term ' ELSE 'term ' END, doc_id) AS name, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' revised') ELSE text END AS definition, CASE WHEN doc_id % 5 <> 0 THEN lang END AS context, doc_id AS seq FROM documents"
_DEFINITION_DELTAS = _delta("definition", "gl", [
    ("a.definition <> b.definition", "'definition text changed'", 1),
    ("coalesce(a.context, '') <> coalesce(b.context, '')", f"'context: ' || {_NONE.format('a.context')} || ' -> ' || {_NONE.format('b.context')}", 1)])


def glossaries(t: Tables):
    return [t.spark.sql(x.replace("FROM documents", "FROM {documents}"), documents=t.documents) for x in (_GLOSSARY, _GLOSSARY_B)]


_GL = f"gl AS ({_GLOSSARY}), gl_b AS ({_GLOSSARY_B})"


@query("d01_all_definition_deltas", f"WITH {_GL} {_DEFINITION_DELTAS}")
def d01_definitions(t: Tables):
    return _joined(D.definition_deltas(*glossaries(t)))


@_query("d03_constraint_keys", "SELECT model_id, fact_type_id, constraint_id, type, key FROM ck", _keys_cte(""))
def d03(t: Tables):
    return D.constraint_keys(catalog(t))


@_query("d04_breaking_levels", f"SELECT model_id, element_type, breaking_level, count(*) AS n FROM ({OBJECT_DELTAS} UNION ALL {FACT_DELTAS}) GROUP BY ALL", *SHAPES)
def d04(t: Tables):
    return D.deltas(catalog(t), revised(t)).groupBy("model_id", "element_type", "breaking_level").agg(F.count("*").alias("n"))


# Synonyms: the SQL side lists the pairs that the key groups must expand to.
_SUFFIX = r"CASE WHEN starts_with(lower(reference_mode), regexp_replace(lower(name), '\s+', '_', 'g')) THEN reference_mode[length(name) + 1:] ELSE reference_mode END"
_OVERLAP = "len(list_filter(r.allowed, lambda v: list_contains(d.allowed, v))) / least(len(r.allowed), len(d.allowed)) >= 0.5"
_CHANGED = (f"rm AS (SELECT a.*, {_SUFFIX} AS sfx FROM {_LAST.format('object_types')} a WHERE (model_id, name) NOT IN (SELECT (model_id, name) FROM object_types_b))",
            f"ad AS (SELECT a.*, {_SUFFIX} AS sfx FROM {_LAST.format('object_types_b')} a WHERE (model_id, name) NOT IN (SELECT (model_id, name) FROM object_types))",
            f"""sy AS (SELECT r.model_id, r.name AS removed_name, d.name AS added_name, list_filter([CASE WHEN list_contains(d.aliases, r.name) OR list_contains(r.aliases, d.name) THEN 'alias' END, CASE WHEN r.sfx <> '' AND r.sfx = d.sfx THEN 'reference mode' END,
              CASE WHEN len(r.allowed) > 0 AND len(d.allowed) > 0 AND {_OVERLAP} THEN 'values' END], lambda x: x IS NOT NULL) AS reasons FROM rm r JOIN ad d ON r.model_id = d.model_id AND r.kind = d.kind)""")


@_query("d05_synonym_pairs", "SELECT model_id, 'object_type' AS element_type, removed_name, added_name, array_to_string(reasons, '; ') AS reasons FROM sy WHERE len(reasons) > 0", *_CHANGED)
def d05(t: Tables):
    groups = D.synonym_groups(catalog(t), revised(t)).filter("element_type = 'object_type'")
    removed = groups.filter("side = 'removed'").select("model_id", "element_type", "name").distinct()
    return D.synonym_pairs(groups, removed).withColumn("reasons", F.array_join("reasons", "; "))


@_query("d05_fact_synonym_pairs", """SELECT DISTINCT r.model_id, 'fact_type' AS element_type, r.name AS removed_name, d.name AS added_name, 'players' AS reasons FROM (SELECT * FROM """ + _LAST.format("fs") + """ x WHERE (model_id, name) NOT IN (SELECT (model_id, name) FROM fs_b)) r
  JOIN (SELECT * FROM """ + _LAST.format("fs_b") + """ x WHERE (model_id, name) NOT IN (SELECT (model_id, name) FROM fs)) d ON r.model_id = d.model_id AND len(r.players) = len(d.players)
  WHERE """ + " AND ".join(f"(len(r.players) < {i} OR r.players[{i}] = d.players[{i}] OR EXISTS (SELECT 1 FROM sy WHERE sy.model_id = r.model_id AND sy.removed_name = r.players[{i}] AND sy.added_name = d.players[{i}] AND len(reasons) > 0))" for i in (1, 2, 3)), *SHAPES, *_CHANGED)
def d05_facts(t: Tables):
    groups = D.synonym_groups(catalog(t), revised(t)).filter("element_type = 'fact_type'")
    removed = groups.filter("side = 'removed'").select("model_id", "element_type", "name").distinct()
    return D.synonym_pairs(groups, removed).withColumn("reasons", F.array_join("reasons", "; "))


def accepted(t: Tables):
    """Every delta whose name has an even length (plus the model's number) is accepted."""
    cat = catalog(t)
    return cat.store(cat.dealt(D.deltas(cat, revised(t)).filter("(length(name) + model_id) % 2 = 0").select("model_id", "element_type", "name")), "accepted")


def merged(t: Tables) -> Catalog:
    return D.merge(catalog(t), revised(t), accepted(t))


_YES = "(length({0}name) + {0}model_id) % 2 = 0"


def _merge_cte(name: str, table: str) -> str:
    a, b = _LAST.format(table), _LAST.format(table + "_b")
    delta = OBJECT_DELTAS if table == "object_types" else FACT_DELTAS
    return f"""{name} AS (SELECT d.model_id, d.name, d.kind, CASE WHEN d.kind = 'unchanged' THEN 'a' WHEN d.kind = 'added' THEN CASE WHEN {_YES.format('d.')} THEN 'b' END WHEN d.kind = 'removed' THEN CASE WHEN NOT ({_YES.format('d.')}) THEN 'a' END WHEN {_YES.format('d.')} THEN 'b' ELSE 'a' END AS source, a AS x, b AS y
      FROM ({delta}) d LEFT JOIN {a} a ON a.model_id = d.model_id AND a.name = d.name LEFT JOIN {b} b ON b.model_id = d.model_id AND b.name = d.name)"""


_MO = _merge_cte("mo", "object_types") + """, mt AS (SELECT model_id, coalesce(x.object_type_id, y.object_type_id) AS object_type_id, name, CASE source WHEN 'a' THEN x.kind ELSE y.kind END AS kind, CASE source WHEN 'a' THEN x.definition ELSE y.definition END AS definition,
  CASE WHEN kind = 'modified' AND source = 'b' THEN CASE WHEN len(list_distinct(list_concat(coalesce(x.aliases, []), coalesce(y.aliases, [])))) > 0 THEN list_distinct(list_concat(coalesce(x.aliases, []), coalesce(y.aliases, []))) END WHEN source = 'a' THEN x.aliases ELSE y.aliases END AS aliases, y.object_type_id AS other
  FROM mo WHERE source IS NOT NULL)"""


@_query("d06_merged_object_types", "SELECT model_id, object_type_id, name, kind, definition, array_to_string(list_sort(aliases), ',') AS aliases FROM mt", _MO)
def d06(t: Tables):
    return merged(t).object_types.select("model_id", "object_type_id", "name", "kind", "definition", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


_MF = _merge_cte("mf", "fs") + """, mr AS (SELECT f.model_id, coalesce(f.x.fact_type_id, f.y.fact_type_id) AS fact_type_id, r.role_id, r.pos, r.name, r.player_id AS was FROM mf f JOIN roles r ON r.model_id = f.model_id AND r.fact_type_id = f.x.fact_type_id WHERE source = 'a'
  UNION ALL SELECT f.model_id, coalesce(f.x.fact_type_id, f.y.fact_type_id), r.role_id, r.pos, r.name, r.player_id FROM mf f JOIN roles_b r ON r.model_id = f.model_id AND r.fact_type_id = f.y.fact_type_id WHERE source = 'b')"""


_MERGED_ROLES = """SELECT mr.model_id, fact_type_id, role_id, pos, mr.name, CASE WHEN k.object_type_id IS NOT NULL THEN was ELSE coalesce(m.object_type_id, was) END AS player_id
  FROM mr LEFT JOIN mt k ON k.model_id = mr.model_id AND k.object_type_id = was LEFT JOIN mt m ON m.model_id = mr.model_id AND m.other = was"""


@_query("d06_merged_roles", _MERGED_ROLES, *SHAPES, _MO, _MF)
def d06_roles(t: Tables):
    return merged(t).roles.select("model_id", "fact_type_id", "role_id", "pos", "name", "player_id")


@query("d06_all_merged_definitions", f"WITH {_GL} SELECT d.model_id, d.name, CASE WHEN src = 'a' THEN a.definition ELSE b.definition END AS definition FROM (SELECT *, CASE WHEN kind = 'unchanged' THEN 'a' WHEN kind = 'added' THEN CASE WHEN {_YES.format('')} THEN 'b' END WHEN kind = 'removed' THEN CASE WHEN {_YES.format('')} THEN NULL ELSE 'a' END WHEN {_YES.format('')} THEN 'b' ELSE 'a' END AS src FROM ({_DEFINITION_DELTAS})) d LEFT JOIN gl a ON a.model_id = d.model_id AND a.name = d.name LEFT JOIN gl_b b ON b.model_id = d.model_id AND b.name = d.name WHERE src IS NOT NULL")
def d06_definitions(t: Tables):
    a, b = glossaries(t)
    yes = a.select("model_id", "name").union(b.select("model_id", "name")).distinct().filter(_YES.format(""))
    return D.merge_definitions(a, b, yes).select("model_id", "name", "definition")


def _gate_sql() -> str:
    """The SQL of the structural rules, reading the merged models under the names of the catalog's tables."""
    from factloom.workloads.catalog import LINT

    pick = lambda c: f"CASE source WHEN 'a' THEN x.{c} ELSE y.{c} END AS {c}"
    types = f"SELECT model_id, coalesce(x.object_type_id, y.object_type_id) AS object_type_id, name, {pick('kind')}, {pick('seq')} FROM mo WHERE source IS NOT NULL"
    facts = f"SELECT model_id, coalesce(x.fact_type_id, y.fact_type_id) AS fact_type_id, name, {pick('seq')} FROM mf WHERE source IS NOT NULL"
    rules = [LINT[n] for n in ("l01_dangling_roles", "l02_duplicate_names", "l04_subtype_references", "l05_subtype_cycle", "l06_objectification")]
    shadows = [f"{n} AS MATERIALIZED (SELECT * FROM merged_{n})" for n in ("object_types", "fact_types", "roles")]
    ctes = list(dict.fromkeys(cte for _, found in rules for cte in found))
    every = " UNION ALL ".join(f"SELECT model_id, rule_id, severity FROM ({select})" for select, _ in rules)
    return f"""merged_object_types AS ({types}), merged_fact_types AS ({facts}), merged_roles AS ({_MERGED_ROLES})
  SELECT model_id, rule_id, count(*) AS n FROM (WITH RECURSIVE {', '.join([*shadows, *ctes])} SELECT * FROM ({every})) WHERE severity = 'error' GROUP BY ALL"""


@query("d07_merge_gate", with_catalog(_gate_sql(), *_B, *SHAPES, _MO, _MF).replace("\nmerged_object_types", ", merged_object_types", 1))
def d07(t: Tables):
    return D.structural_errors(merged(t)).groupBy("model_id", "rule_id").agg(F.count("*").alias("n"))


_REV = "CAST(floor(epoch(ts) / 86400) AS BIGINT)"
_RV = f"rv AS (SELECT user_id AS model_id, {_REV} AS rev, min(event_id) % 13 <> 0 AS readable FROM events GROUP BY ALL), el AS (SELECT user_id AS model_id, {_REV} AS rev, event_type AS name, CAST(max(event_id % 3) AS VARCHAR) AS hash FROM events GROUP BY ALL)"


@query("d08_history", f"""WITH {_RV}, wk AS (SELECT *, lag(rev) OVER w AS prev, lag(readable) OVER w AS was FROM rv WINDOW w AS (PARTITION BY model_id ORDER BY rev)),
  st AS (SELECT model_id, rev, prev, CASE WHEN NOT readable THEN 'unreadable' WHEN prev IS NULL THEN 'initial' WHEN NOT was THEN 'parent unreadable' ELSE 'diff' END AS status FROM wk),
  ch AS (SELECT coalesce(o.model_id, n.model_id) AS model_id, coalesce(o.rev, n.rev) AS rev, coalesce(o.name, n.name) AS name, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'modified' END AS kind
    FROM (SELECT st.model_id, st.rev, name, hash FROM st JOIN el ON el.model_id = st.model_id AND el.rev = st.prev WHERE status = 'diff') o FULL JOIN (SELECT st.model_id, st.rev, name, hash FROM st JOIN el USING (model_id, rev) WHERE status = 'diff') n ON o.model_id = n.model_id AND o.rev = n.rev AND o.name = n.name)
  SELECT st.model_id, st.rev, status, kind, CASE WHEN kind IS NOT NULL THEN 'event' END AS element_type, name FROM st LEFT JOIN (SELECT * FROM ch WHERE kind IS NOT NULL) c ON c.model_id = st.model_id AND c.rev = st.rev""")
def d08(t: Tables):
    e = t.events.withColumn("rev", F.floor(F.unix_timestamp("ts") / 86400))
    revisions = e.groupBy(F.col("user_id").alias("model_id"), "rev").agg((F.min("event_id") % 13 != 0).alias("readable"))
    elements = e.groupBy(F.col("user_id").alias("model_id"), "rev", F.lit("event").alias("element_type"), F.col("event_type").alias("name")).agg(F.max(F.col("event_id") % 3).cast("string").alias("hash"))
    return D.history(revisions, elements)


@query("w05_state_transitions", """SELECT event_type AS "from", nxt AS "to", count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY ALL""")
def w05(t: Tables):
    e = t.events.select("event_id", "ts", "user_id", "event_type")
    steps = next_value(e, ["user_id"], ["ts", "event_id"], None, "event_type", "nxt").filter("nxt IS NOT NULL")
    return steps.groupBy(F.col("event_type").alias("from"), F.col("nxt").alias("to")).agg(F.count("*").alias("n"))


# ---- lineage ----------------------------------------------------------------------------------------------

_LABEL = "CASE c.type " + " ".join(f"WHEN '{k}' THEN '{v}'" + (" || f.name" if named else "") for k, (v, named) in G.CONSTRAINT_LABELS.items()) + " ELSE 'Constraint: ' || f.name END"
_USES = """SELECT u.model_id, artifact, f.fact_type_id AS element_id, 'FactType' AS element_type, f.name AS element_name FROM us u JOIN fact_types f USING (model_id, fact_type_id)
  UNION SELECT u.model_id, artifact, r.role_id, 'Role', r.name FROM us u JOIN fact_types f USING (model_id, fact_type_id) JOIN roles r USING (model_id, fact_type_id)
  UNION SELECT u.model_id, artifact, o.object_type_id, CASE WHEN o.kind = 'entity' THEN 'EntityType' ELSE 'ValueType' END, o.name FROM us u JOIN fact_types f USING (model_id, fact_type_id) JOIN roles r USING (model_id, fact_type_id) JOIN object_types o ON o.model_id = r.model_id AND o.object_type_id = r.player_id"""
_TABLE_LINEAGE = f"""SELECT model_id, table_id AS artifact, table_id AS element_id, 'EntityType' AS element_type, o.name AS element_name FROM ky JOIN object_types o USING (model_id) WHERE o.object_type_id = ky.table_id
  UNION SELECT pc.model_id, pc.fact_type_id, pc.fact_type_id, 'FactType', fact_name FROM pc WHERE placement = 'table' UNION {_USES}
  UNION SELECT fks.model_id, fks.table_id, to_table_id, 'EntityType', o.name FROM fks JOIN object_types o ON o.model_id = fks.model_id AND o.object_type_id = to_table_id
  UNION SELECT fks.model_id, fks.table_id, c.constraint_id, 'Constraint', {_LABEL} FROM fks JOIN constraints c ON c.model_id = fks.model_id AND c.constraint_id = fks.source_id JOIN fact_types f ON f.model_id = c.model_id AND f.fact_type_id = c.fact_type_id"""
_US = """us AS (SELECT c.model_id, c.table_id AS artifact, r.fact_type_id FROM cols c JOIN roles r ON r.model_id = c.model_id AND r.role_id = c.source_role_id UNION SELECT fks.model_id, fks.table_id, c.fact_type_id FROM fks JOIN constraints c ON c.model_id = fks.model_id AND c.constraint_id = fks.source_id)"""


def table_sources(t: Tables):
    cat = catalog(t)
    return G.table_lineage(cat, M.relational(cat))


@query("g01_table_lineage", with_catalog(_TABLE_LINEAGE, *MAPPING_CTES, _US))
def g01(t: Tables):
    return table_sources(t)


_ENTITY_LINEAGE = f"""SELECT model_id, object_type_id AS artifact, object_type_id AS element_id, 'EntityType' AS element_type, name AS element_name FROM object_types WHERE kind = 'entity'
  UNION SELECT * FROM ({_USES}) WHERE element_type <> 'EntityType'
  UNION SELECT u.model_id, artifact, c.constraint_id, 'Constraint', {_LABEL} FROM us u JOIN fact_types f USING (model_id, fact_type_id) JOIN constraints c ON c.model_id = u.model_id AND c.fact_type_id = u.fact_type_id
  UNION SELECT s.model_id, e.object_type_id, o.object_type_id, 'EntityType', o.name FROM (SELECT model_id, subtype_id AS a, supertype_id AS b FROM subtype_facts UNION SELECT model_id, supertype_id, subtype_id FROM subtype_facts) s JOIN object_types e ON e.model_id = s.model_id AND e.object_type_id = s.a AND e.kind = 'entity' JOIN object_types o ON o.model_id = s.model_id AND o.object_type_id = s.b"""
_EUS = "us AS (SELECT DISTINCT r.model_id, player_id AS artifact, fact_type_id FROM roles r JOIN object_types o ON o.model_id = r.model_id AND o.object_type_id = player_id AND kind = 'entity')"


@query("g02_entity_lineage", with_catalog(_ENTITY_LINEAGE, _EUS))
def g02(t: Tables):
    return G.entity_lineage(catalog(t))


_WORDS = "CASE element_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.RELATIONSHIPS.items()) + " END || element_name"


@query("g03_impact", with_catalog(f"SELECT g.model_id, element_id, artifact, 'ddl' AS format, {_WORDS} AS relationship FROM ({_ENTITY_LINEAGE}) g JOIN object_types o ON o.model_id = g.model_id AND o.object_type_id = element_id AND o.definition IS NULL", _EUS))
def g03(t: Tables):
    cat = catalog(t)
    exports = cat.object_types.filter("kind = 'entity'").select("model_id", F.col("object_type_id").alias("artifact"), F.lit("ddl").alias("format"))
    changed = cat.object_types.filter("definition IS NULL").select("model_id", F.col("object_type_id").alias("element_id"))
    return G.impact(exports, G.entity_lineage(cat), changed)


@_query("g04_staleness", """SELECT DISTINCT o.model_id, o.object_type_id AS artifact, 'ddl' AS format, o.seq AS exported_at, d.model_id IS NOT NULL AS stale
  FROM object_types o LEFT JOIN (SELECT model_id FROM ((SELECT * FROM roles EXCEPT SELECT * FROM roles_b) UNION ALL (SELECT * FROM roles_b EXCEPT SELECT * FROM roles)) GROUP BY 1) d USING (model_id) WHERE o.kind = 'entity'""")
def g04(t: Tables):
    cat, now = catalog(t), revised(t)
    then = G.model_hashes(cat, ("roles",))
    exports = cat.object_types.filter("kind = 'entity'").select("model_id", F.col("object_type_id").alias("artifact"), F.lit("ddl").alias("format"), F.col("seq").alias("exported_at")).join(then, "model_id")
    return G.staleness(exports, G.model_hashes(now, ("roles",))).drop("reason")


_EXPORTS = "SELECT o_orderkey % 64 AS model_id, concat('out/', o_custkey % 20, '.sql') AS artifact, 'ddl' AS format, o_orderstatus AS note, o_orderkey AS seq FROM orders"


@query("g05_manifest_upsert", f"SELECT model_id, artifact, format, note, seq FROM ({_EXPORTS}) QUALIFY row_number() OVER (PARTITION BY model_id, artifact ORDER BY seq DESC) = 1")
def g05(t: Tables):
    rows = t.spark.sql(_EXPORTS.replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return G.upsert(rows.filter("note <> 'F'"), rows.filter("note = 'F'"))


@query("w07_latest_per_artifact", f"SELECT artifact, max(seq) AS seq, max_by(note, seq) AS note FROM ({_EXPORTS}) GROUP BY 1")
def w07(t: Tables):
    rows = t.spark.sql(_EXPORTS.replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return extreme_rows(rows.select("artifact", "seq", "note"), ["artifact"], F.col("seq"))


# Paths of one nation in five shapes; the first two name its artifact, the others lie above the folder, at the root, or above again.
_PATHS = """CASE n_nationkey % 5 WHEN 0 THEN './out//x/../' WHEN 1 THEN 'out/a/b/../.././' WHEN 2 THEN '../out/' WHEN 3 THEN '/../out/' ELSE 'a/../../out/' END || n_name || '.sql'"""
_ARTIFACT = "CASE WHEN n_nationkey % 2 = 0 THEN 'out/' ELSE 'x/.././out/' END || n_name || '.sql'"


@query("g06_resolve_artifacts", f"""SELECT n_regionkey AS model_id, {_PATHS} AS path, {_ARTIFACT} AS artifact, 'ddl' AS format, CAST(c_custkey AS VARCHAR) AS element_id, 'EntityType' AS element_type
  FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 5 < 2""")
def g06(t: Tables):
    n = t.nation.select(F.col("n_regionkey").alias("model_id"), "n_nationkey", F.expr(_ARTIFACT).alias("artifact"), F.expr(_PATHS).alias("path"))
    sources = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("model_id", "artifact", F.col("c_custkey").cast("string").alias("element_id"), F.lit("EntityType").alias("element_type"))
    return G.resolve_artifacts(n.select("model_id", "artifact", F.lit("ddl").alias("format")), sources, n.select("model_id", "path"))


# ---- partitioning -------------------------------------------------------------------------------------------

def domains(t: Tables):
    models = catalog(t).object_types.select("model_id").distinct()
    return models.select("model_id", F.inline(F.array(*[F.struct(F.lit(c).alias("context"), F.lit(i).alias("rank")) for i, c in enumerate(("sales", "stock", "supply"))])))


def seeds(t: Tables):
    context = F.expr("CASE WHEN substring(object_type_id, 1, 1) = 'o' AND seq % 3 = 0 THEN 'sales' WHEN substring(object_type_id, 1, 1) = 's' AND seq % 2 = 0 THEN 'supply' WHEN substring(object_type_id, 1, 1) = 'p' AND seq % 5 = 0 THEN 'stock' END")
    return catalog(t).object_types.select("model_id", "name", context.alias("context")).filter("context IS NOT NULL")


def split(t: Tables):
    return P.split(catalog(t), domains(t), seeds(t))


_CONTEXTS = "['sales', 'stock', 'supply'][rank + 1]"


def _passes(name: str, start: str) -> tuple[str, ...]:
    """The passes of a vote, one CTE each: ``name``0 is start, the last one the homes after all passes."""
    return (f"{name}0 AS MATERIALIZED ({start})", *[f"""{name}{k + 1} AS MATERIALIZED (SELECT * FROM {name}{k} UNION ALL SELECT model_id, object_type_id, min_by(rank, (-votes, rank)) AS rank FROM (
      SELECT e.model_id, e.a AS object_type_id, h.rank, sum(n) AS votes FROM ed e JOIN {name}{k} h ON h.model_id = e.model_id AND h.object_type_id = e.b
      WHERE (e.model_id, e.a) IN (SELECT (model_id, object_type_id) FROM object_types) AND (e.model_id, e.a) NOT IN (SELECT (model_id, object_type_id) FROM {name}{k}) GROUP BY ALL) GROUP BY ALL)"""
      for k in range(P.PASSES)])


_VOTED, _AGAIN = f"hv{P.PASSES}", f"hw{P.PASSES}"
_SPLIT = (
    """ed AS MATERIALIZED (SELECT model_id, a, b, count(*) AS n FROM (SELECT x.model_id, x.player_id AS a, y.player_id AS b FROM roles x JOIN roles y USING (model_id, fact_type_id)
      UNION ALL SELECT model_id, subtype_id, supertype_id FROM subtype_facts UNION ALL SELECT model_id, supertype_id, subtype_id FROM subtype_facts) WHERE a <> b GROUP BY ALL)""",
    """sd AS (SELECT model_id, name, CASE WHEN substring(object_type_id, 1, 1) = 'o' AND seq % 3 = 0 THEN 0 WHEN substring(object_type_id, 1, 1) = 's' AND seq % 2 = 0 THEN 2 WHEN substring(object_type_id, 1, 1) = 'p' AND seq % 5 = 0 THEN 1 END AS rank FROM object_types)""",
    *_passes("hv", "SELECT sd.model_id, o.object_type_id, min(rank) AS rank FROM sd JOIN (SELECT model_id, name, max_by(object_type_id, seq) AS object_type_id FROM object_types GROUP BY ALL) o USING (model_id, name) WHERE rank IS NOT NULL GROUP BY ALL"),
    f"""fv AS MATERIALIZED (SELECT f.model_id, f.fact_type_id, coalesce(w.rank, 0) AS rank FROM fact_types f LEFT JOIN (SELECT model_id, fact_type_id, min_by(rank, (-votes, pos)) AS rank FROM (
      SELECT r.model_id, r.fact_type_id, h.rank, count(*) AS votes, min(r.pos) AS pos FROM (SELECT model_id, fact_type_id, player_id, min(pos) AS pos FROM roles GROUP BY ALL) r
      JOIN {_VOTED} h ON h.model_id = r.model_id AND h.object_type_id = r.player_id GROUP BY ALL) GROUP BY ALL) w USING (model_id, fact_type_id))""",
    """re AS MATERIALIZED (SELECT o.model_id, o.object_type_id, max_by(fv.rank, o.seq) AS rank FROM objectified o JOIN fv USING (model_id, fact_type_id)
      WHERE (o.model_id, o.object_type_id) IN (SELECT (model_id, object_type_id) FROM object_types) GROUP BY ALL)""",
    *_passes("hw", f"SELECT * FROM {_VOTED} WHERE (model_id, object_type_id) NOT IN (SELECT (model_id, object_type_id) FROM re) UNION ALL SELECT * FROM re"),
    f"hm AS MATERIALIZED (SELECT model_id, object_type_id, {_CONTEXTS} AS context, CAST(rank AS INTEGER) AS rank FROM (SELECT * FROM {_AGAIN} UNION ALL SELECT model_id, object_type_id, 0 FROM object_types WHERE (model_id, object_type_id) NOT IN (SELECT (model_id, object_type_id) FROM {_AGAIN})))",
    f"fh AS MATERIALIZED (SELECT model_id, fact_type_id, {_CONTEXTS} AS context, CAST(rank AS INTEGER) AS rank FROM fv)",
)
_SEAMS = """SELECT DISTINCT u.model_id, u.context, u.p AS object_type_id, hm.context AS owner FROM (SELECT model_id, context, player_id AS p FROM roles JOIN fh USING (model_id, fact_type_id)
  UNION SELECT s.model_id, context, unnest([subtype_id, supertype_id]) FROM subtype_facts s JOIN hm ON hm.model_id = s.model_id AND hm.object_type_id = s.subtype_id UNION SELECT model_id, context, object_type_id FROM objectified JOIN fh USING (model_id, fact_type_id)) u
  JOIN hm ON hm.model_id = u.model_id AND hm.object_type_id = u.p WHERE hm.context <> u.context"""
_DROPPED = """SELECT DISTINCT u.model_id, fh.context, u.fact_type_id, u.constraint_id FROM (SELECT model_id, fact_type_id, constraint_id, unnest(list_concat(role_ids, coalesce(role_ids_2, []))) AS rid FROM constraints) u JOIN fh USING (model_id, fact_type_id)
  LEFT JOIN roles r ON r.model_id = u.model_id AND r.role_id = u.rid LEFT JOIN fh o ON o.model_id = r.model_id AND o.fact_type_id = r.fact_type_id WHERE o.context IS NULL OR o.context <> fh.context"""


@query("g07_partition", with_catalog("SELECT * FROM hm", *_SPLIT))
def g07(t: Tables):
    return split(t)[0]


@query("g07_fact_homes", with_catalog("SELECT * FROM fh", *_SPLIT))
def g07_facts(t: Tables):
    return split(t)[1]


@query("g08_seams", with_catalog(_SEAMS, *_SPLIT))
def g08(t: Tables):
    return P.seams(catalog(t), *split(t))


@query("g08_dropped_constraints", with_catalog(_DROPPED, *_SPLIT))
def g08_dropped(t: Tables):
    return P.dropped_constraints(catalog(t), split(t)[1])


# With homes given by the data instead of a vote, the seams are plain SQL.
_HOME = "CASE WHEN substring(object_type_id, 1, 1) = 'o' THEN 'sales' WHEN substring(object_type_id, 1, 1) = 's' THEN 'supply' ELSE 'stock' END"
_FIXED = (f"hm AS (SELECT model_id, object_type_id, {_HOME} AS context FROM object_types)", "fh AS (SELECT model_id, fact_type_id, CASE seq % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'stock' ELSE 'supply' END AS context FROM fact_types)")


def fixed_homes(t: Tables):
    cat = catalog(t)
    return cat.object_types.select("model_id", "object_type_id", F.expr(_HOME).alias("context")), cat.fact_types.selectExpr("model_id", "fact_type_id", "CASE seq % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'stock' ELSE 'supply' END AS context")


@query("g08_seams_of_given_homes", with_catalog(_SEAMS, *_FIXED))
def g08_given(t: Tables):
    return P.seams(catalog(t), *fixed_homes(t))


@query("g08_dropped_of_given_homes", with_catalog(_DROPPED, *_FIXED))
def g08_dropped_given(t: Tables):
    return P.dropped_constraints(catalog(t), fixed_homes(t)[1])


@query("t05_majority_vote", with_catalog("""SELECT model_id, fact_type_id, min_by(context, (-n, pos)) AS context FROM (SELECT r.model_id, r.fact_type_id, hm.context, count(*) AS n, min(pos) AS pos FROM (SELECT model_id, fact_type_id, player_id, min(pos) AS pos FROM roles GROUP BY ALL) r
  JOIN hm ON hm.model_id = r.model_id AND hm.object_type_id = r.player_id GROUP BY ALL) GROUP BY ALL""", _FIXED[0]))
def t05(t: Tables):
    homes = fixed_homes(t)[0].withColumn("rank", F.lit(0))
    fallback = domains(t).filter("rank = 0")
    voted = catalog(t).roles.join(homes, (catalog(t).roles.model_id == homes.model_id) & (F.col("player_id") == F.col("object_type_id")), "left_semi").select("model_id", "fact_type_id").distinct()
    return P.fact_homes(catalog(t), homes, fallback).join(voted, ["model_id", "fact_type_id"]).select("model_id", "fact_type_id", "context")
