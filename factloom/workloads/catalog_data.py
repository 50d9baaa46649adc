"""A corpus of models derived from the provided tables, and the same derivation in SQL.

Sixty-four consecutive orders make one model. Orders, parts and suppliers are its
object types, each (order, line number) is a fact type, and line attributes
decide arities, constraints and the faults the lint rules look for. The corpus
grows with the tables and no model has more than sixty-four orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from factloom.plans.session import materialize_by
from factloom.sources.catalog import SCHEMAS, Catalog, LazyCatalog
from factloom.workloads.registry import Tables

LINES = """SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, min(l_partkey) AS part, min(l_suppkey) AS supp, CAST(min(l_quantity) AS BIGINT) AS q,
  min(l_returnflag) AS rf, min(l_linestatus) AS ls, CAST(round(max(l_discount) * 100) AS BIGINT) AS disc, CAST(round(max(l_tax) * 100) AS BIGINT) AS tax
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""

# Row-wise expressions that mean the same in Spark SQL and in DuckDB.
BASE = "CAST(floor(k / 64.0) AS BIGINT)"
FT = "concat('f', k, '_', n)"
ARITY = "CASE WHEN q < 6 THEN 1 WHEN q < 40 THEN 2 ELSE 3 END"
FACT_TYPES = f"""SELECT {BASE} AS model_id, {FT} AS fact_type_id, concat('OrderHas Part-', (k % 64) % 20, '-', n) AS name,
  CASE WHEN tax = 8 THEN 'derived' END AS derivation_kind, CASE WHEN tax = 8 AND disc < 3 THEN ' ' WHEN tax = 8 THEN 'sum' END AS derivation_rule,
  CASE WHEN tax = 8 AND disc = 5 THEN 'stored' END AS derivation_storage, k * 10 + n AS seq FROM l"""
ROLES = f"""SELECT {BASE} AS model_id, {FT} AS fact_type_id, concat({FT}, '_r0') AS role_id, 0 AS pos, 'has' AS name, concat('o', k) AS player_id FROM l
  UNION ALL SELECT {BASE}, {FT}, concat({FT}, '_r1'), 1, 'of', CASE WHEN q % 5 = 0 THEN concat('o', k - k % 64 + (k + part) % 64) ELSE concat('p', part) END FROM l WHERE q >= 6
  UNION ALL SELECT {BASE}, {FT}, concat({FT}, '_r2'), 2, 'from', concat('s', supp) FROM l WHERE q >= 40"""
READINGS = f"""SELECT {BASE} AS model_id, {FT} AS fact_type_id, 0 AS pos, CASE WHEN q < 6 THEN '{{0}} is urgent' WHEN q < 40 THEN '{{0}} has {{1}}' ELSE '{{0}} has {{1}} from {{2}} or {{3}}' END AS template FROM l
  UNION ALL SELECT {BASE}, {FT}, 1, '{{1}} is of {{0}}' FROM l WHERE rf = 'A' AND q >= 6 AND q < 40"""
OBJECT_TYPES = """SELECT CAST(floor(o_orderkey / 64.0) AS BIGINT) AS model_id, concat('o', o_orderkey) AS object_type_id, concat('Order ', o_orderkey % 61) AS name, 'entity' AS kind,
    CASE WHEN o_orderstatus <> 'F' THEN concat('order_', o_orderkey % 61, '_id') END AS reference_mode, CASE WHEN o_orderpriority <> '1-URGENT' THEN concat('priority ', o_orderpriority) END AS definition,
    CAST(NULL AS {text}) AS data_type, CAST(NULL AS INT) AS length, CAST(NULL AS INT) AS scale,
    CASE WHEN o_orderpriority = '5-LOW' THEN {array}(concat('Ord ', o_orderkey % 61)) END AS aliases, CAST(NULL AS {texts}) AS allowed, o_orderstatus = 'O' AS independent, o_orderkey AS seq FROM orders
  UNION ALL SELECT model_id, concat('p', part), concat(p_name, ' ', part % 7), CASE WHEN p_size % 4 = 0 THEN 'entity' ELSE 'value' END,
    CASE WHEN p_size % 4 = 0 THEN 'part_code' END, NULL,
    CASE WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 THEN CASE p_type WHEN 'ECONOMY' THEN 'text' WHEN 'SMALL' THEN 'integer' WHEN 'MEDIUM' THEN 'decimal' WHEN 'PROMO' THEN 'money' WHEN 'STANDARD' THEN 'boolean' ELSE 'binary' END END,
    CASE WHEN p_size % 2 = 0 THEN p_size END, CASE WHEN p_size % 5 = 0 THEN 3 END, NULL, CASE WHEN p_size % 4 <> 0 AND p_size % 5 = 1 THEN {array}('a', p_brand) END, FALSE, 1000000000000 + part
    FROM (SELECT DISTINCT CAST(floor(k / 64.0) AS BIGINT) AS model_id, part FROM l WHERE q >= 6 AND q % 5 <> 0) JOIN part ON p_partkey = part WHERE p_size <> 13
  UNION ALL SELECT model_id, concat('s', supp), s_name, 'entity', 'supplier_id', NULL, NULL, NULL, NULL, NULL, NULL, FALSE, 2000000000000 + supp
    FROM (SELECT DISTINCT CAST(floor(k / 64.0) AS BIGINT) AS model_id, supp FROM l WHERE q >= 40) JOIN supplier ON s_suppkey = supp"""
R0, R1, RX = f"concat({FT}, '_r0')", f"concat({FT}, '_r1')", f"concat({FT}, '_rx')"

# (order number, condition, type, role list, second role list, min, max, ring type, allowed values, preferred)
_CONSTRAINTS = (
    (0, "NOT (rf = 'N' AND q % 3 = 0)", "'internal_uniqueness'",
     f"CASE WHEN q % 4 = 0 THEN CASE WHEN q < 6 THEN {{array}}({R0}) WHEN q < 40 THEN {{array}}({R0}, {R1}) ELSE {{array}}({R0}, {R1}, concat({FT}, '_r2')) END "
     f"WHEN q % 4 = 1 OR q < 6 THEN {{array}}({R0}) WHEN q % 4 = 2 THEN {{array}}({R1}) ELSE {{array}}({R0}, {RX}) END", "NULL", "NULL", "NULL", "NULL", "NULL", "ls = 'F' AND q % 4 IN (1, 2)"),
    (1, "n <= 3", "'mandatory'", f"{{array}}(CASE WHEN part % 40 = 0 THEN {RX} WHEN part % 3 = 0 AND q >= 6 THEN {R1} ELSE {R0} END)", "NULL", "NULL", "NULL", "NULL", "NULL", "FALSE"),
    (2, "disc >= 8", "'frequency'", f"CASE WHEN disc = 9 THEN CAST({{array}}() AS {{texts}}) ELSE {{array}}({R0}) END", "NULL", "CAST(tax AS INT)", "CAST(tax - 1 + (disc % 2) * 5 AS INT)", "NULL", "NULL", "FALSE"),
    (3, "tax IN (3, 4) AND q >= 6 AND q < 40", "'ring'", f"{{array}}({R0}, CASE WHEN part % 30 = 0 THEN {RX} ELSE {R1} END)", "NULL", "NULL", "NULL", "CASE WHEN q % 2 = 0 THEN 'acyclic' ELSE 'symmetric' END", "NULL", "FALSE"),
    (4, "tax = 5 AND q >= 6", "'value_constraint'", f"{{array}}(CASE WHEN part % 10 = 0 THEN {RX} ELSE {R1} END)", "NULL", "NULL", "NULL", "NULL", "{array}('a', 'b')", "FALSE"),
    (5, "tax = 6", "CASE disc % 3 WHEN 0 THEN 'exclusion' WHEN 1 THEN 'exclusive_or' ELSE 'disjunctive_mandatory' END", f"CASE WHEN part % 2 = 0 OR q < 6 THEN {{array}}({R0}) ELSE {{array}}({R0}, {R1}) END", "NULL", "NULL", "NULL", "NULL", "NULL", "FALSE"),
    (6, "tax = 7 AND q >= 6", "CASE WHEN disc % 2 = 0 THEN 'subset' ELSE 'equality' END", f"{{array}}({R0})", f"CASE WHEN part % 2 = 0 THEN {{array}}({R1}) ELSE {{array}}({R0}, {R1}) END", "NULL", "NULL", "NULL", "NULL", "FALSE"),
    (7, "tax = 1 AND q >= 6", "'external_uniqueness'", f"CASE WHEN disc % 2 = 0 THEN {{array}}({R1}, concat('f', k, '_', n + 1, '_r1')) ELSE {{array}}({R0}, {R1}) END", "NULL", "NULL", "NULL", "NULL", "NULL", "FALSE"),
    (8, "tax = 2", "'cardinality'", f"{{array}}(CASE WHEN part % 10 = 1 THEN {RX} ELSE {R0} END)", "NULL", "CAST(disc AS INT)", "5", "NULL", "NULL", "FALSE"),
    (9, "tax = 0 AND disc < 4", "CASE disc WHEN 0 THEN 'join_subset' WHEN 1 THEN 'join_equality' ELSE 'join_exclusion' END", "CAST({array}() AS {texts})", "NULL", "NULL", "NULL", "NULL", "NULL", "FALSE"),
)
SUBTYPE_FACTS = """SELECT CAST(floor(o_orderkey / 64.0) AS BIGINT) AS model_id, concat('st', o_orderkey) AS subtype_fact_id, concat('o', o_orderkey) AS subtype_id,
    CASE o_orderkey % 64 WHEN 63 THEN concat('x', o_orderkey) WHEN 62 THEN concat('p', o_orderkey % 200) ELSE concat('o', o_orderkey - o_orderkey % 64 + CAST(floor((o_orderkey % 64) / 2.0) AS BIGINT)) END AS supertype_id,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS provides_identification, CASE WHEN o_orderkey % 64 = 40 THEN 'derived' END AS derivation_kind,
    CASE WHEN o_orderkey % 64 = 40 THEN '' END AS derivation_rule FROM orders WHERE o_orderkey % 64 >= 2 AND o_orderstatus <> 'P'
  UNION ALL SELECT CAST(floor(o_orderkey / 64.0) AS BIGINT), concat('sc', o_orderkey), concat('o', o_orderkey), concat('o', o_orderkey + 3), FALSE, NULL, NULL FROM orders WHERE o_orderkey % 448 = 1"""
OBJECTIFIED = f"""SELECT {BASE} AS model_id, concat('ob', k) AS objectified_id, CASE WHEN part % 20 = 0 THEN 'fx' ELSE {FT} END AS fact_type_id,
  CASE WHEN q % 7 = 0 THEN concat('p', part) ELSE concat('o', k - k % 64 + k % 8) END AS object_type_id, k AS seq FROM l WHERE n = 7"""
POPULATIONS = f"""SELECT {BASE} AS model_id, concat('pop', k, '_', n) AS pop_id, CASE WHEN part % 30 = 0 THEN concat('fz', k) ELSE {FT} END AS fact_type_id, disc = 4 AS sample FROM l WHERE tax IN (0, 4, 8)"""
# Steps leave the order through the line's part, or break in the ways the lint rules name.
_STEP = f"{{struct}}({R0}, {R1})"
OPERANDS = f"""SELECT {BASE} AS model_id, {FT} AS fact_type_id, concat({FT}, '_c9') AS constraint_id,
    CASE disc WHEN 0 THEN 'join_subset' WHEN 1 THEN 'join_equality' ELSE 'join_exclusion' END AS type, CAST(i AS INT) AS operand,
    CASE WHEN part % 17 = 0 THEN 'nowhere' WHEN part % 19 = 0 THEN concat('s', supp) ELSE concat('o', k) END AS root,
    CASE WHEN part % 13 = 0 AND i = 1 THEN {{array}}({{step}}({R0}, {RX})) ELSE {{array}}({{step}}({R0}, {R1})) END AS steps,
    CASE WHEN part % 11 = 0 AND i = 1 THEN {{array}}(0) WHEN part % 7 = 0 THEN {{array}}(0, 2) WHEN part % 23 = 0 THEN CAST({{array}}() AS {{ints}}) WHEN part % 5 = 0 AND i = 1 THEN {{array}}(1, 0) ELSE {{array}}(0, 1) END AS projection
    FROM l, (SELECT 0 AS i UNION ALL SELECT 1) s WHERE tax = 0 AND disc < 4 AND q >= 6 AND NOT (i = 1 AND disc = 3)"""


def _constraints_sql() -> str:
    branches = [
        f"""SELECT {BASE} AS model_id, {FT} AS fact_type_id, {o} AS ord, concat({FT}, '_c{o}') AS constraint_id, {kind} AS type,
  CASE WHEN disc = 4 THEN 'deontic' ELSE 'alethic' END AS modality, {roles} AS role_ids, CAST({roles2} AS {{texts}}) AS role_ids_2, CAST({low} AS INT) AS min, CAST({high} AS INT) AS max,
  CAST({ring} AS {{text}}) AS ring_type, CAST(NULL AS {{text}}) AS operator, CAST({allowed} AS {{texts}}) AS allowed, {preferred} AS is_preferred FROM l WHERE {condition}"""
        for o, condition, kind, roles, roles2, low, high, ring, allowed, preferred in _CONSTRAINTS
    ]
    return " UNION ALL ".join(branches)


_TEMPLATES = {
    "object_types": OBJECT_TYPES, "fact_types": FACT_TYPES, "roles": ROLES, "readings": READINGS, "constraints": _constraints_sql(),
    "operands": OPERANDS, "subtype_facts": SUBTYPE_FACTS, "objectified": OBJECTIFIED, "populations": POPULATIONS,
}
# How each side writes arrays and types.
_SPARK = {"array": "array", "text": "STRING", "texts": "ARRAY<STRING>", "ints": "ARRAY<INT>", "step": "named_struct_step"}
_DUCK = {"array": "list_value", "text": "VARCHAR", "texts": "VARCHAR[]", "ints": "INTEGER[]", "step": "struct_step"}


def _fill(template: str, words: dict[str, str]) -> str:
    for word, text in words.items():
        template = template.replace("{" + word + "}", text)
    template = template.replace("{{", "{").replace("}}", "}")
    if words is _SPARK:
        return re.sub(r"named_struct_step\((concat\(.*?\), '_r0'\)), (concat\(.*?\), '_r[1x]'\))\)", r"named_struct('entry', \1, 'exit', \2)", template)
    return re.sub(r"struct_step\((concat\(.*?\), '_r0'\)), (concat\(.*?\), '_r[1x]'\))\)", r"struct_pack(entry := \1, exit := \2)", template)


CTES = "WITH RECURSIVE l AS (" + LINES + "), " + ", ".join(f"{name} AS ({_fill(sql, _DUCK)})" for name, sql in _TEMPLATES.items())


def with_catalog(select: str, *ctes: str) -> str:
    """DuckDB SQL over the derived catalog; extra CTEs go between."""
    return ", ".join([CTES, *ctes]) + "\n" + select


_SOURCE = re.compile(r"\b(FROM|JOIN) (l|lineitem|orders|part|supplier)\b")
_STORED: dict[tuple[str, str], Catalog] = {}


LINES_A_BUCKET = 200_000  # about as many line items are in a bucket of the stored tables


def buckets(t: Tables) -> int:
    """Buckets of the stored catalog: at least as many as a shuffle has partitions, more as the line items grow."""
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.lineitem.count() // LINES_A_BUCKET))


def catalog(t: Tables) -> Catalog:
    """The derived catalog, each table written once per application and folder when it is first read.

    A catalog is stored data: queries over it should start from scans with
    statistics, not from ten aggregations of the line items. Tables are stored in
    buckets by model, the first column of every key, so what is joined or counted
    within models is not shuffled.
    """
    t.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORED:
        number = buckets(t)
        lines = materialize_by(_lines(t, number), "lines", "model_id", number)
        _STORED[key] = LazyCatalog(lambda name: materialize_by(_table(t, lines, name, number), name, "model_id", number), number)
    return _STORED[key]


def _lines(t: Tables, number: int) -> DataFrame:
    used = sorted(set(re.findall(r"\bl_\w+", LINES)))
    dealt = t.lineitem.select(F.expr(BASE.replace("(k ", "(l_orderkey ")).alias("model_id"), *used).repartition(number, "model_id")
    text = LINES.replace("SELECT ", "SELECT model_id, ", 1).replace("FROM lineitem", "FROM {lineitem}").replace("GROUP BY ", "GROUP BY model_id, ")
    return t.spark.sql(text, lineitem=dealt)


def _table(t: Tables, lines: DataFrame, name: str, number: int) -> DataFrame:
    plain = _fill(_TEMPLATES[name], _SPARK).replace(f"{BASE} AS model_id", "model_id").replace(BASE, "model_id")
    text = _SOURCE.sub(r"\1 {\2}", plain.replace("{", "{{").replace("}", "}}"))
    used = {v: lines if v == "l" else getattr(t, v) for v in {m.group(2) for m in _SOURCE.finditer(plain)}}
    columns = [c.strip().split(" ") for c in _split(SCHEMAS[name])]
    made = t.spark.sql(text, **used).select(*[F.col(c[0].rstrip(":")) for c in columns])
    return made if set(used) == {"l"} else made.repartition(number, "model_id")


def _split(schema: str) -> list[str]:
    """Top-level columns of a schema text."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return parts + [schema[start:]]
