"""Relational mapping of the derived corpus, tables to facts and back, and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import naming as N
from factloom.operators import mapping as M
from factloom.plans.session import ensure_checkpoint_dir
from factloom.sources import tables as S
from factloom.workloads.catalog import ARITY
from factloom.workloads.catalog_data import catalog, with_catalog
from factloom.workloads.registry import Tables, query
from factloom.workloads.retail import facts


def snake(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1_\2', 'g'), '[\s-]+', '_', 'g'))"


def pascal(x: str) -> str:
    return f"list_aggregate(list_transform(string_split({x}, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '')"


SQL_TYPE = """CASE data_type WHEN 'text' THEN CASE WHEN length <> 0 THEN concat('VARCHAR(', length, ')') ELSE 'TEXT' END WHEN 'integer' THEN 'INTEGER' WHEN 'boolean' THEN 'BOOLEAN'
  WHEN 'decimal' THEN CASE WHEN length <> 0 AND scale IS NOT NULL THEN concat('DECIMAL(', length, ',', scale, ')') WHEN length <> 0 THEN concat('DECIMAL(', length, ')') ELSE 'DECIMAL' END
  WHEN 'money' THEN CASE WHEN length <> 0 THEN concat('DECIMAL(', length, ',', coalesce(scale, 2), ')') ELSE 'DECIMAL(19,2)' END
  WHEN 'binary' THEN CASE WHEN length <> 0 THEN concat('BINARY(', length, ')') ELSE 'BLOB' END ELSE 'TEXT' END"""

# ---- scalar functions -----------------------------------------------------------------------------


@query("f01_to_snake", f"SELECT DISTINCT n AS name, {snake('n')} AS snake FROM (SELECT p_name || 'Of Type-' || p_type AS n FROM part UNION ALL SELECT c_name || ' ' || c_mktsegment FROM customer)")
def f01(t: Tables):
    names = t.part.select(F.concat("p_name", F.lit("Of Type-"), "p_type").alias("name")).union(t.customer.select(F.concat_ws(" ", "c_name", "c_mktsegment")))
    return names.distinct().select("name", N.to_snake(F.col("name")).alias("snake"))


@query("f02_to_pascal", f"SELECT DISTINCT n AS name, {pascal('n')} AS pascal FROM (SELECT replace(p_name, ' ', '_') || '_' || p_type AS n FROM part)")
def f02(t: Tables):
    names = t.part.select(F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), "p_type").alias("name")).distinct()
    return names.select("name", N.to_pascal(F.col("name")).alias("pascal"))


@query("f03_reference_mode_suffix", with_catalog(r"""SELECT model_id, object_type_id, CASE WHEN reference_mode = '' THEN NULL WHEN starts_with(lower(reference_mode), regexp_replace(lower(name), '\s+', '_', 'g')) THEN reference_mode[length(name) + 1:] ELSE reference_mode END AS suffix FROM object_types"""))
def f03(t: Tables):
    return catalog(t).object_types.select("model_id", "object_type_id", N.reference_mode_suffix(F.col("reference_mode"), F.col("name")).alias("suffix"))


TYPE_WORDS = ("VARCHAR(10)", "bigint", "Numeric(5,2)", "double precision", "bool", "date", "TIME", "timestamptz", "bytea", "uuid", "json", "dated")


@query("f04_conceptual_type", "SELECT event_id, w AS sql_type, ['text','integer','decimal','float','boolean','date','time','datetime','binary','uuid','other','other'][event_id % 12 + 1] AS conceptual FROM (SELECT event_id, ["
       + ", ".join(f"'{w}'" for w in TYPE_WORDS) + "][event_id % 12 + 1] AS w FROM events)")
def f04(t: Tables):
    words = F.array(*[F.lit(w) for w in TYPE_WORDS])
    typed = t.events.select("event_id", F.get(words, (F.col("event_id") % 12).cast("int")).alias("sql_type"))
    return typed.withColumn("conceptual", N.conceptual_type(F.col("sql_type")))


@query("f05_sql_type", with_catalog(f"SELECT model_id, object_type_id, {SQL_TYPE} AS sql_type FROM object_types WHERE kind = 'value'"))
def f05(t: Tables):
    o = catalog(t).object_types.filter("kind = 'value'")
    return o.select("model_id", "object_type_id", N.sql_type(F.col("data_type"), F.col("length"), F.col("scale")).alias("sql_type"))


STATEMENTS = ("  select 1", "With x as (select 1) select 2", "CREATE table t(a int)", "alter TABLE t", "insert into t", "Update t", "delete from t", "grant all")


@query("f09_statement_kind", "SELECT event_id, ['select','select','create','alter','insert','update','delete','other'][event_id % 8 + 1] AS kind FROM events")
def f09(t: Tables):
    words = F.array(*[F.lit(w) for w in STATEMENTS])
    return t.events.select("event_id", N.statement_kind(F.concat(F.get(words, (F.col("event_id") % 8).cast("int")), F.lit(" -- "), "event_type")).alias("kind"))


DIALECT_TEXTS = ("-- dialect: Postgresql\nselect qualify 1", "select 1\n-- dialect: oracle\nset search_path = a", "select 1 qualify row_number() = 1",
                 "\n\n\n\n\n-- dialect: mysql\nselect struct<a int>", "create temp function f", "select 1", "create or replace stage s")


@query("f10_sql_dialect", "SELECT event_id, ['postgres','postgres','snowflake','bigquery','bigquery',NULL,'snowflake'][event_id % 7 + 1] AS dialect FROM events")
def f10(t: Tables):
    words = F.array(*[F.lit(w) for w in DIALECT_TEXTS])
    return t.events.select("event_id", N.sql_dialect(F.concat(F.get(words, (F.col("event_id") % 7).cast("int")), F.lit(" "), "event_type")).alias("dialect"))


@query("f13_content_hash", """SELECT c_custkey, sha256('{"f0":' || c_custkey || ',"f1":"' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '"' ELSE '","f2":"' || c_mktsegment || '"' END || '}') AS hash FROM customer""")
def f13(t: Tables):
    return t.customer.select("c_custkey", N.content_hash(F.col("c_custkey"), F.col("c_name"), F.expr("CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END")).alias("hash"))


@query("u05_overlap_ratio", "SELECT user_id, len(list_filter(a, lambda v: list_contains(b, v))) / least(len(a), len(b)) AS overlap FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a, list_sort(list(DISTINCT event_type) FILTER (value > 200)) AS b FROM events GROUP BY 1) WHERE len(b) > 0")
def u05(t: Tables):
    kinds = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.expr("CASE WHEN value > 200 THEN event_type END")).alias("b"))
    return kinds.filter("size(b) > 0").select("user_id", N.overlap_ratio(F.col("a"), F.col("b")).alias("overlap"))


# ---- tables and facts ------------------------------------------------------------------------------

_VALUE_COLUMNS = ("p_name", "p_brand", "p_type", "p_size")


@query("s03_table_to_facts", " UNION ALL ".join(f"SELECT 'Part has ' || {pascal(repr(c))} AS fact_type, CAST(p_partkey AS VARCHAR) AS entity_id, CAST({c} AS VARCHAR) AS value FROM part" for c in _VALUE_COLUMNS))
def s03(t: Tables):
    return S.value_facts(t.part, "part", "p_partkey", list(_VALUE_COLUMNS))


@query("s03_reference_facts", """SELECT 'Lineitem has Part' AS fact_type, CAST(l_partkey AS VARCHAR) AS target_id, CAST(l_orderkey AS VARCHAR) AS entity_id FROM lineitem
  UNION ALL SELECT 'Lineitem has Supplier', CAST(l_suppkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem""")
def s03_references(t: Tables):
    return S.reference_facts(t.lineitem, "lineitem", "l_orderkey", {"l_partkey": "part", "l_suppkey": "supplier"})


@query("s04_associative_rows", """SELECT * FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS done, CASE WHEN o_orderstatus = 'O' OR o_orderpriority = '1-URGENT' THEN o_custkey END AS open FROM orders) WHERE done IS NOT NULL OR open IS NOT NULL""")
def s04(t: Tables):
    return S.associative_rows(facts(t, "state"), "state", {"st_done": "done", "st_open": "open"})


_ENTITY_SQL = """SELECT CAST(u.v AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(first_part AS VARCHAR) AS first_part, coalesce(o_orderstatus = 'F', FALSE) AS is_finished, coalesce(o_orderpriority = '1-URGENT', FALSE) AS is_urgent
  FROM (SELECT o_orderkey AS v FROM orders UNION SELECT l_orderkey FROM lineitem) u LEFT JOIN orders ON o_orderkey = u.v
  LEFT JOIN (SELECT l_orderkey, min_by(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS first_part FROM lineitem GROUP BY 1) ON l_orderkey = u.v"""


def entity_table(t: Tables):
    return S.entity_rows(facts(t, "places", "line", "finished", "urgent"), "Order", "order_id",
                         {"customer_id": ("pl_ord", "pl_cust"), "first_part": ("ln_ord", "ln_part")}, {"is_finished": "fin_ord", "is_urgent": "urg_ord"})


@query("s05_entity_rows", _ENTITY_SQL)
def s05(t: Tables):
    return entity_table(t)


def _folder(t: Tables, name: str) -> str:
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("s06_csv_seed", "SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source || ', \"quoted\"' END AS note FROM documents")
def s06(t: Tables):
    path = _folder(t, "seed")
    df = t.documents.select("doc_id", "lang", F.expr("CASE WHEN doc_id % 3 <> 0 THEN source || ', \"quoted\"' END").alias("note"))
    S.write_seed(df, path)
    return t.spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)


@query("s07_json_example", """SELECT '{"customer":"' || o_custkey || '","order":"' || o_orderkey || '"}' AS example FROM orders ORDER BY o_orderkey LIMIT 1""")
def s07(t: Tables):
    return S.first_example(facts(t, "places"), "places", {"pl_cust": "customer", "pl_ord": "order"})


@query("s08_run_history", "SELECT event_type AS run_id, count(*) AS samples, max(event_id) AS last_event FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*), max(event_id) FROM events")
def s08(t: Tables):
    path = _folder(t, "history")
    aggs = [F.count("*").alias("samples"), F.max("event_id").alias("last_event")]
    S.append_history(t.events.groupBy(F.col("event_type").alias("run_id")).agg(*aggs), path)
    S.append_history(t.events.groupBy(F.lit("all").alias("run_id")).agg(*aggs), path)
    return S.read_history(t.spark, path, "run_id STRING, samples BIGINT, last_event BIGINT")


@query("w08_instance_numbers", """SELECT player_id, value, row_number() OVER (PARTITION BY player_id ORDER BY at_, value) AS number FROM (
  SELECT 'Customer' AS player_id, CAST(o_custkey AS VARCHAR) AS value, min(o_orderkey) AS at_ FROM orders GROUP BY 2 UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR), min(o_orderkey) FROM orders GROUP BY 2)""")
def w08(t: Tables):
    from factloom.operators.sequences import number_rows
    rows = facts(t, "places").rows("places")
    cells = rows.select("ord", F.inline(F.array(*[F.struct(F.lit(p).alias("player_id"), F.col(r).cast("string").alias("value")) for p, r in (("Customer", "pl_cust"), ("Order", "pl_ord"))])))
    seen = cells.groupBy("player_id", "value").agg(F.min("ord").alias("at"))
    return number_rows(seen, ["player_id"], ["at", "value"], None, "number").select("player_id", "value", "number")


# ---- relational mapping ------------------------------------------------------------------------------

VALUE_TYPES = f"vt AS (SELECT model_id, object_type_id, name, {SQL_TYPE} AS sql_type FROM object_types WHERE kind = 'value')"
KEYS = f"""ky AS (SELECT o.model_id, object_type_id AS table_id, {snake('o.name')} AS name, coalesce(reference_mode, {snake('o.name')} || '_id') AS key_name, coalesce(k.t, 'TEXT') AS key_type FROM object_types o
  LEFT JOIN (SELECT a.model_id, a.player_id, min_by(vt.sql_type, (CASE WHEN EXISTS (SELECT 1 FROM constraints c WHERE c.model_id = a.model_id AND c.fact_type_id = a.fact_type_id AND c.type = 'internal_uniqueness' AND c.is_preferred) THEN 0 ELSE 1 END) * 1000000000000 + f.seq) AS t
    FROM roles a JOIN ar ON ar.model_id = a.model_id AND ar.fact_type_id = a.fact_type_id AND arity = 2 JOIN roles b ON b.model_id = a.model_id AND b.fact_type_id = a.fact_type_id AND b.pos <> a.pos
    JOIN vt ON vt.model_id = b.model_id AND vt.object_type_id = b.player_id JOIN fact_types f ON f.model_id = a.model_id AND f.fact_type_id = a.fact_type_id GROUP BY ALL) k
  ON k.model_id = o.model_id AND k.player_id = o.object_type_id WHERE kind = 'entity')"""
PLACED = """rk AS (SELECT r.*, o.kind, coalesce((SELECT bool_or(c.type = 'internal_uniqueness') FROM constraints c WHERE c.model_id = r.model_id AND c.fact_type_id = r.fact_type_id AND c.role_ids = [r.role_id] AND c.type IN ('internal_uniqueness', 'mandatory')), FALSE) AS u,
    coalesce((SELECT bool_or(c.type = 'mandatory') FROM constraints c WHERE c.model_id = r.model_id AND c.fact_type_id = r.fact_type_id AND c.role_ids = [r.role_id] AND c.type IN ('internal_uniqueness', 'mandatory')), FALSE) AS m,
    (SELECT max_by(c.constraint_id, c.ord) FROM constraints c WHERE c.model_id = r.model_id AND c.fact_type_id = r.fact_type_id AND c.role_ids = [r.role_id] AND c.type = 'internal_uniqueness') AS s
    FROM roles r LEFT JOIN object_types o ON o.model_id = r.model_id AND o.object_type_id = r.player_id),
  pr AS (SELECT f.model_id, f.fact_type_id, f.name AS fact_name, f.seq, arity, a.player_id AS p1, b.player_id AS p2, a.role_id AS r1, b.role_id AS r2, a.m AS m1, b.m AS m2, a.s AS s1, b.s AS s2,
    CASE WHEN arity = 1 THEN 'flag' WHEN arity > 2 THEN 'table' WHEN a.kind = 'value' AND b.kind = 'value' THEN 'none' WHEN a.kind = 'value' OR b.kind = 'value' THEN 'value' WHEN a.u <> b.u OR (a.u AND b.u AND a.m <> b.m) THEN 'reference' ELSE 'table' END AS placement,
    CASE WHEN arity = 1 THEN 1 WHEN arity > 2 THEN NULL WHEN a.kind = 'value' AND b.kind = 'value' THEN NULL WHEN a.kind = 'value' THEN 2 WHEN b.kind = 'value' THEN 1 WHEN a.u <> b.u THEN CASE WHEN a.u THEN 1 ELSE 2 END WHEN a.u AND b.u AND a.m <> b.m THEN CASE WHEN a.m THEN 1 ELSE 2 END END AS side
    FROM fact_types f JOIN ar USING (model_id, fact_type_id) JOIN rk a ON a.model_id = f.model_id AND a.fact_type_id = f.fact_type_id AND a.pos = 0 LEFT JOIN rk b ON b.model_id = f.model_id AND b.fact_type_id = f.fact_type_id AND b.pos = 1
    WHERE (f.model_id, f.fact_type_id) NOT IN (SELECT (model_id, fact_type_id) FROM objectified)),
  pc AS (SELECT model_id, fact_type_id, fact_name, seq, placement, CASE side WHEN 1 THEN p1 WHEN 2 THEN p2 END AS owner, CASE side WHEN 1 THEN p2 WHEN 2 THEN p1 END AS target, CASE side WHEN 1 THEN r1 WHEN 2 THEN r2 END AS role_id,
    CASE side WHEN 1 THEN m1 WHEN 2 THEN m2 END AS required, CASE WHEN placement = 'reference' THEN CASE side WHEN 1 THEN s1 WHEN 2 THEN s2 END END AS source_id FROM pr)"""
_E15 = "1000000000000000"
COLUMNS = f"""cw AS (SELECT model_id, table_id, 0::BIGINT AS at_, key_name AS wanted, NULL::VARCHAR AS instead, key_type AS data_type, FALSE AS nullable, NULL::VARCHAR AS source_role_id, NULL::VARCHAR AS to_table_id, NULL::VARCHAR AS to_column, NULL::VARCHAR AS source_id FROM ky
  UNION ALL SELECT p.model_id, owner, {_E15} + p.seq * 10, {snake('fact_name')}, NULL, 'BOOLEAN', TRUE, role_id, NULL, NULL, NULL FROM pc p JOIN ky ON ky.model_id = p.model_id AND ky.table_id = owner WHERE placement = 'flag'
  UNION ALL SELECT p.model_id, owner, {_E15} + p.seq * 10, {snake('vt.name')}, NULL, vt.sql_type, NOT required, role_id, NULL, NULL, NULL FROM pc p JOIN ky ON ky.model_id = p.model_id AND ky.table_id = owner JOIN vt ON vt.model_id = p.model_id AND vt.object_type_id = target WHERE placement = 'value'
  UNION ALL SELECT p.model_id, owner, {_E15} + p.seq * 10, t.key_name, 'fk_' || t.key_name, t.key_type, NOT required, role_id, target, t.key_name, source_id FROM pc p JOIN ky ON ky.model_id = p.model_id AND ky.table_id = owner JOIN ky t ON t.model_id = p.model_id AND t.table_id = target WHERE placement = 'reference'
  UNION ALL SELECT p.model_id, p.fact_type_id, {_E15} + r.pos, t.key_name, {snake('r.name')} || '_' || t.key_name, t.key_type, FALSE, r.role_id, r.player_id, t.key_name, NULL FROM pc p JOIN roles r ON r.model_id = p.model_id AND r.fact_type_id = p.fact_type_id JOIN ky t ON t.model_id = p.model_id AND t.table_id = r.player_id WHERE placement = 'table'
  UNION ALL SELECT o.model_id, o.object_type_id, 2 * {_E15} + o.seq * 10 + r.pos, t.key_name, {snake('r.name')} || '_' || t.key_name, t.key_type, FALSE, r.role_id, r.player_id, t.key_name, o.fact_type_id FROM objectified o JOIN ky ON ky.model_id = o.model_id AND ky.table_id = o.object_type_id JOIN roles r ON r.model_id = o.model_id AND r.fact_type_id = o.fact_type_id JOIN ky t ON t.model_id = o.model_id AND t.table_id = r.player_id),
  cn AS (SELECT *, CASE WHEN at_ > min(at_) OVER (PARTITION BY model_id, table_id, wanted) AND instead IS NOT NULL THEN instead ELSE wanted END AS name, max(CASE WHEN at_ >= 2 * {_E15} THEN at_ // 10 END) OVER (PARTITION BY model_id, table_id) AS last_obj FROM cw),
  ck AS (SELECT cn.*, CASE WHEN NOT EXISTS (SELECT 1 FROM ky WHERE ky.model_id = cn.model_id AND ky.table_id = cn.table_id) THEN TRUE WHEN last_obj IS NOT NULL THEN at_ // 10 = last_obj ELSE at_ = 0 END AS is_key FROM cn),
  cu AS (SELECT model_id, table_id, min_by(name, at_) AS name, min_by(data_type, at_) AS data_type FROM ck WHERE is_key AND (model_id, table_id) IN (SELECT (model_id, table_id) FROM ky) GROUP BY ALL),
  sl AS (SELECT s.model_id, subtype_fact_id, s.subtype_id AS table_id, s.supertype_id AS target, provides_identification, a.name AS own_key, b.name AS key_name, b.data_type AS key_type,
    CASE WHEN EXISTS (SELECT 1 FROM ck WHERE ck.model_id = s.model_id AND ck.table_id = s.subtype_id AND ck.name = b.name) THEN 'fk_' || b.name ELSE b.name END AS col FROM subtype_facts s JOIN cu a ON a.model_id = s.model_id AND a.table_id = s.subtype_id JOIN cu b ON b.model_id = s.model_id AND b.table_id = s.supertype_id),
  cols AS (SELECT model_id, table_id, name, data_type, nullable, source_role_id, is_key FROM ck UNION ALL SELECT model_id, table_id, col, key_type, FALSE, NULL, FALSE FROM sl WHERE NOT provides_identification),
  fks AS (SELECT model_id, table_id, name AS "column", to_table_id, to_column, source_id FROM ck WHERE to_table_id IS NOT NULL UNION ALL SELECT model_id, table_id, CASE WHEN provides_identification THEN own_key ELSE col END, target, key_name, subtype_fact_id FROM sl)"""
_ALL = (ARITY, VALUE_TYPES, KEYS, PLACED, COLUMNS)


def _query(name: str, select: str, *ctes: str):
    return query(name, with_catalog(select, *ctes))


@_query("m01_key_columns", "SELECT * FROM ky", ARITY, VALUE_TYPES, KEYS)
def m01(t: Tables):
    return M.key_columns(catalog(t))


@_query("m02_placements", "SELECT * FROM pc", ARITY, PLACED)
def m02(t: Tables):
    return M.placements(catalog(t))


@_query("m03_columns", "SELECT * FROM cols", *_ALL)
def m03(t: Tables):
    return M.relational(catalog(t)).columns.drop("at")


@_query("m04_unary_columns", "SELECT * FROM cols WHERE data_type = 'BOOLEAN' AND NOT is_key", *_ALL)
def m04(t: Tables):
    return M.relational(catalog(t)).columns.drop("at").filter("data_type = 'BOOLEAN' AND NOT is_key")


@_query("m05_foreign_keys", "SELECT * FROM fks", *_ALL)
def m05(t: Tables):
    return M.relational(catalog(t)).foreign_keys


@_query("m06_objectified_keys", f"SELECT model_id, table_id, name, source_role_id FROM ck WHERE at_ >= 2 * {_E15} AND is_key", *_ALL)
def m06(t: Tables):
    return M.relational(catalog(t)).columns.filter("at.phase = 2 AND is_key").select("model_id", "table_id", "name", "source_role_id")


@_query("m03_tables", f"SELECT model_id, table_id, name, 'entity' AS kind FROM ky UNION ALL SELECT model_id, fact_type_id, {snake('fact_name')}, 'associative' FROM pc WHERE placement = 'table'", *_ALL)
def m03_tables(t: Tables):
    return M.relational(catalog(t)).tables


@_query("m07_column_tests", """SELECT model_id, table_id, name AS "column", 'not_null' AS test, NULL::VARCHAR AS to_table_id, NULL::VARCHAR AS to_column FROM cols WHERE NOT nullable
  UNION ALL SELECT model_id, table_id, c.name, 'unique', NULL, NULL FROM cols c JOIN (SELECT model_id, table_id, min(name) AS name FROM cols WHERE is_key GROUP BY ALL HAVING count(*) = 1) k USING (model_id, table_id, name)
  UNION ALL SELECT c.model_id, c.table_id, c.name, 'relationships', r.r.t, r.r.c FROM cols c JOIN (SELECT model_id, table_id, "column", min(struct_pack(t := to_table_id, c := to_column)) AS r FROM fks GROUP BY ALL) r ON r.model_id = c.model_id AND r.table_id = c.table_id AND r.column = c.name""", *_ALL)
def m07(t: Tables):
    return M.column_tests(M.relational(catalog(t)))
