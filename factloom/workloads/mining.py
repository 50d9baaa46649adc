"""Mining of SQL and source code written from the provided tables.

Every order becomes a SQL file and every part a source file, so the corpora grow
with the tables. The SQL side states what each text contains without reading it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

from factloom.operators import source_mining as B, sql_mining as R
from factloom.plans.session import ensure_checkpoint_dir, spread
from factloom.sources.corpus import read_source, read_sql
from factloom.workloads.registry import Tables, query

_TEXT = r"""concat('-- order ', o_orderkey, '; with a break\nCREATE TABLE order_', o_orderkey, ' (id INT NOT NULL, code VARCHAR(10) UNIQUE, state TEXT DEFAULT \'new\', amount INT CHECK (amount > 0 AND grade IN (\'a\', \'b\')), UNIQUE (id, code), FOREIGN KEY (cust_id) REFERENCES customer_', o_custkey, '(id));\n',
  'SELECT o.id, \';x\' AS s, count(*) FROM order_', o_orderkey, ' o LEFT JOIN customer_', o_custkey, ' c ON o.cust_id = c.id JOIN part_', o_orderkey % 10, ' p ON p.id = o.part_id WHERE o.state IN (\'', o_orderstatus, '\', \'x\') AND o.code IS NOT NULL AND amount > ', o_orderkey % 50, ' AND o.id BETWEEN 1 AND ', o_orderkey, ' GROUP BY o.id, 2, state ORDER BY 1;\n',
  CASE WHEN o_orderkey % 2 = 0 THEN concat('SELECT CASE o.kind WHEN \'x', o_orderkey % 3, '\' THEN 1 WHEN \'y\' THEN 2 ELSE 0 END FROM order_', o_orderkey, '\n\n') ELSE '' END,
  '; ALTER TABLE order_', o_orderkey, ' ALTER COLUMN extra SET NOT NULL')"""
_PATH = "concat('db/', o_orderkey % 7, '/order_', o_orderkey, '.sql')"


def orders(t: Tables):
    return spread(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


def corpus(t: Tables):
    return orders(t).select(F.expr(_PATH).alias("file_path"), F.concat(F.lit("order_"), "o_orderkey").alias("model"), (F.col("o_orderkey") % 7).cast("string").alias("project"), F.expr(_TEXT).alias("sql"))


def statements(t: Tables):
    return R.split_statements(corpus(t), "project", "model")


def found(t: Tables, *kinds: str):
    return R.patterns(statements(t), "project", "model", kinds=kinds or tuple(R.EXTRACTORS))


def shown(df, *details: str):
    return df.select("file_path", "statement", "start_line", "end_line", "source_text", F.array_join("tables", ",").alias("tables"), F.array_join("columns", ",").alias("columns"), *[F.col("details")[d].alias(d) for d in details])


K = "CAST(o_orderkey AS VARCHAR)"
_ALTER_AT = "CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 4 END"


def row(statement: str, start: str, end: str, text: str, tables: str, columns: str, where: str = "TRUE", extra: str = "") -> str:
    return f"SELECT {_PATH} AS file_path, CAST({statement} AS INTEGER) AS statement, CAST({start} AS INTEGER) AS start_line, CAST({end} AS INTEGER) AS end_line, {text} AS source_text, {tables} AS tables, {columns} AS columns{extra} FROM orders WHERE {where}"


_CREATE, _SELECT = ("0", "1", "2"), ("1", "3", "3")


@query("r01_statements", f"""SELECT {_PATH} AS file_path, s AS statement, CASE s WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 5 END AS start_line, CASE s WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 5 END AS end_line,
  CASE s WHEN 0 THEN 'other' WHEN 1 THEN 'select' WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'select' ELSE 'alter' END ELSE 'alter' END AS kind FROM orders, (VALUES (0), (1), (2), (3)) v(s) WHERE s < 3 OR o_orderkey % 2 = 0""")
def r01(t: Tables):
    from factloom.functions.naming import statement_kind
    return statements(t).select("file_path", "statement", "start_line", "end_line", statement_kind(F.col("sql")).alias("kind"))


@query("r02_joins", row(*_SELECT, "concat('LEFT JOIN customer_', o_custkey, ' c ON o.cust_id = c.id')", "concat('customer_', o_custkey, ',o,c')", "'cust_id'")
       + " UNION ALL " + row(*_SELECT, "concat('JOIN part_', o_orderkey % 10, ' p ON p.id = o.part_id')", "concat('part_', o_orderkey % 10, ',p,o')", "'id'"))
def r02(t: Tables):
    return shown(found(t, "join"))


def _where(text: str, column: str, kind: str, operator: str = "NULL", value: str = "NULL", lower: str = "NULL", upper: str = "NULL") -> str:
    return row(*_SELECT, text, "''", f"'{column}'", extra=f", '{kind}' AS predicate, CAST({operator} AS VARCHAR) AS operator, CAST({value} AS VARCHAR) AS value, CAST({lower} AS VARCHAR) AS lower, CAST({upper} AS VARCHAR) AS upper")


@query("r03_where_predicates", " UNION ALL ".join([
    _where("concat('o.state IN (''', o_orderstatus, ''', ''x'')')", "state", "in"), _where("'o.code IS NOT NULL'", "code", "is_not_null"),
    _where("concat('amount > ', o_orderkey % 50)", "amount", "comparison", "'>'", "o_orderkey % 50"), _where("concat('o.id BETWEEN 1 AND ', o_orderkey)", "id", "between", lower="1", upper="o_orderkey")]))
def r03(t: Tables):
    return shown(found(t, "where"), "predicate", "operator", "value", "lower", "upper")


@query("r04_case_branches", row("2", "4", "4", "concat('CASE o.kind WHEN ''x', o_orderkey % 3, ''' THEN 1 WHEN ''y'' THEN 2 ELSE 0 END')", "''", "'kind'", "o_orderkey % 2 = 0", ", concat('x', o_orderkey % 3, ',y') AS values"))
def r04(t: Tables):
    return shown(found(t, "case"), "values")


@query("r05_checks", row(*_CREATE, "'CHECK (amount > 0 AND grade IN (''a'', ''b'')'", "''", "'amount,grade,a,b'"))
def r05(t: Tables):
    return shown(found(t, "check"))


@query("r06_uniques", row(*_CREATE, "'UNIQUE (id, code)'", "''", "'id,code'") + " UNION ALL " + row(*_CREATE, "'code VARCHAR(10) UNIQUE'", "''", "'code'"))
def r06(t: Tables):
    return shown(found(t, "unique"))


@query("r07_not_nulls", row(*_CREATE, "'id INT NOT NULL'", "''", "'id'") + " UNION ALL " + row("CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END", _ALTER_AT, _ALTER_AT, f"concat('ALTER TABLE order_', o_orderkey, ' ALTER COLUMN extra SET NOT NULL')", "''", "'extra'"))
def r07(t: Tables):
    return shown(found(t, "not_null"))


@query("r08_foreign_keys", row(*_CREATE, "concat('FOREIGN KEY (cust_id) REFERENCES customer_', o_custkey, '(id)')", "concat('customer_', o_custkey)", "'cust_id'", extra=", 'id' AS referenced"))
def r08(t: Tables):
    return shown(found(t, "foreign_key"), "referenced")


@query("r09_defaults", row(*_CREATE, "', state TEXT DEFAULT ''new'''", "''", "'state'", extra=", '''new''' AS value"))
def r09(t: Tables):
    return shown(found(t, "default"), "value")


@query("r10_group_bys", row(*_SELECT, "'GROUP BY o.id, 2, state'", "''", "'id,state'"))
def r10(t: Tables):
    return shown(found(t, "group_by"))


_NESTED = r"""concat('SELECT a.x FROM t', o_orderkey, ' a WHERE a.x IN (SELECT b.y FROM u b WHERE b.z = ', o_orderkey % 5, ' AND b.t IN (\'(\', \'k\') GROUP BY b.y) AND a.w > ', o_orderkey % 50, ' GROUP BY a.x, a.q HAVING count(*) > 1 UNION ',
  'SELECT c.x FROM (SELECT * FROM v', CASE WHEN o_orderkey % 2 = 0 THEN ' WHERE v.e IS NOT NULL' ELSE '' END, ') c WHERE c.s = \'', o_orderstatus, '\' GROUP BY c.m ORDER BY 1;\nCREATE TABLE w', o_orderkey, ' (g TEXT CHECK (g IN (\'a\', \'b\') AND (n > ', o_orderkey % 3, ' OR n IS NULL)), h INT)')"""


def nested(t: Tables, kind: str):
    texts = orders(t).select(F.expr(_PATH).alias("file_path"), F.expr(_NESTED).alias("sql"))
    return R.nested_patterns(R.split_statements(texts)).filter(F.col("kind") == kind)


def _nested_where(text: str, column: str, kind: str, operator: str = "NULL", value: str = "NULL", where: str = "TRUE") -> str:
    return row("0", "1", "1", text, "''", f"'{column}'", where, extra=f", '{kind}' AS predicate, CAST({operator} AS VARCHAR) AS operator, CAST({value} AS VARCHAR) AS value")


@query("r03_every_where", " UNION ALL ".join([
    _nested_where("'a.x IN ()'", "x", "in"), _nested_where("concat('a.w > ', o_orderkey % 50)", "w", "comparison", "'>'", "o_orderkey % 50"),
    _nested_where("concat('b.z = ', o_orderkey % 5)", "z", "comparison", "'='", "o_orderkey % 5"), _nested_where("'b.t IN (''('', ''k'')'", "t", "in"),
    _nested_where("'v.e IS NOT NULL'", "e", "is_not_null", where="o_orderkey % 2 = 0"), _nested_where("concat('c.s = ''', o_orderstatus, '''')", "s", "comparison", "'='", "concat('''', o_orderstatus, '''')")]))
def r03_nested(t: Tables):
    return shown(nested(t, "where"), "predicate", "operator", "value")


@query("r05_whole_checks", row("1", "2", "2", "concat('CHECK (g IN (''a'', ''b'') AND (n > ', o_orderkey % 3, ' OR n IS NULL))')", "''", "'g,n'"))
def r05_whole(t: Tables):
    return shown(nested(t, "check"))


@query("r10_every_group_by", " UNION ALL ".join(row("0", "1", "1", f"'{text}'", "''", f"'{columns}'") for text, columns in (("GROUP BY b.y", "y"), ("GROUP BY a.x, a.q", "x,q"), ("GROUP BY c.m", "m"))))
def r10_nested(t: Tables):
    return shown(nested(t, "group_by"))


_TABLES = f"SELECT CAST(o_orderkey % 7 AS VARCHAR) AS project, concat('customer_', o_custkey) AS t FROM orders UNION SELECT CAST(o_orderkey % 7 AS VARCHAR), concat('part_', o_orderkey % 10) FROM orders UNION SELECT CAST(o_orderkey % 7 AS VARCHAR), unnest(['o', 'c', 'p']) FROM orders"
_PASCAL = "list_aggregate(list_transform(string_split(t, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '')"


@query("r11_entity_candidates", f"SELECT project, t AS table_name, {_PASCAL} AS entity, t || '_id' AS reference_mode FROM ({_TABLES})")
def r11(t: Tables):
    return R.entity_candidates(found(t, "join", "foreign_key"), "project")


@query("r11_reference_candidates", "SELECT DISTINCT CAST(o_orderkey % 7 AS VARCHAR) AS project, concat('Customer', o_custkey) AS entity, 'O' AS referenced FROM orders UNION SELECT CAST(o_orderkey % 7 AS VARCHAR), concat('Part', o_orderkey % 10), 'P' FROM orders")
def r11_references(t: Tables):
    return R.reference_candidates(found(t, "join"), "project")


_KNOWN = "SELECT concat('order_', o_orderkey) AS model, c AS column, c = 'id' AND o_orderkey % 3 = 0 AS has_mandatory, FALSE AS has_uniqueness, c = 'state' AND o_orderkey % 4 = 0 AS has_values FROM orders {unnest} WHERE c <> 'grade' OR o_orderkey % 5 = 0"


def _suggested(column: str, kind: str, values: str, where: str) -> str:
    return f"SELECT concat('order_', o_orderkey) AS model, '{column}' AS \"column\", '{kind}' AS type, {values} AS allowed FROM orders WHERE {where}"


@query("r12_constraint_suggestions", " UNION ALL ".join([
    _suggested("id", "mandatory", "NULL", "o_orderkey % 3 <> 0"), _suggested("code", "mandatory", "NULL", "TRUE"), _suggested("extra", "mandatory", "NULL", "TRUE"), _suggested("code", "internal_uniqueness", "NULL", "TRUE"),
    _suggested("state", "value_constraint", "concat(o_orderstatus, '|x')", "o_orderkey % 4 <> 0"), _suggested("grade", "value_constraint", "'a|b'", "o_orderkey % 5 = 0"),
    _suggested("kind", "value_constraint", "concat('x', o_orderkey % 3, '|y')", "o_orderkey % 2 = 0")]))
def r12(t: Tables):
    known = t.spark.sql(_KNOWN.replace("{unnest}", "LATERAL VIEW explode(array('id', 'code', 'state', 'kind', 'extra', 'grade')) x AS c").replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return R.constraint_suggestions(found(t), known, "model").withColumn("allowed", F.array_join("allowed", "|"))


@query("r13_relationship_gaps", """SELECT DISTINCT CAST(o_orderkey % 7 AS VARCHAR) AS project, concat('Customer', o_custkey) AS a, concat('Order', o_orderkey) AS b FROM orders WHERE o_orderkey % 3 <> 0
  UNION SELECT CAST(o_orderkey % 7 AS VARCHAR), concat('Order', o_orderkey), concat('Part', o_orderkey % 10) FROM orders""")
def r13(t: Tables):
    project = (F.col("o_orderkey") % 7).cast("string").alias("project")
    names = [F.concat(F.lit("Customer"), "o_custkey"), F.concat(F.lit("Order"), "o_orderkey"), F.concat(F.lit("Part"), F.col("o_orderkey") % 10)]
    entities = t.orders.select(project, F.explode(F.array(*names)).alias("entity"))
    declared = t.orders.filter("o_orderkey % 3 = 0").select(project, names[0].alias("a"), names[1].alias("b"))
    return R.relationship_gaps(found(t, "join", "foreign_key"), entities, declared)


@query("r14_column_test_report", """SELECT concat('order_', o_orderkey) AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'info' ELSE 'gap' END AS severity, 'identifier' AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'id' END AS "column" FROM orders
  UNION ALL SELECT concat('order_', o_orderkey), 'warning', 'macro', 'code' FROM orders WHERE o_orderkey % 5 = 0""")
def r14(t: Tables):
    model = F.concat(F.lit("order_"), "o_orderkey").alias("model")
    cells = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("column_pos"), F.lit(n).alias("test"), F.lit(k).alias("kind"), test.alias("on")) for c, p, n, k, test in (
        ("id", 0, "unique", "builtin", F.lit(True)), ("id", 0, "not_null", "builtin", F.col("o_orderkey") % 2 == 0), ("code", 1, "not_null", "builtin", F.lit(True)), ("code", 1, "is_sane", "custom", F.col("o_orderkey") % 5 == 0))]
    tests = t.orders.select(model, F.inline(F.array(*cells))).filter("on")
    return R.column_test_report(tests, t.orders.select(model))


def _tests(t: Tables):
    """Tests of a model per order: of its columns, with references to the customer and for finished orders the archive, and of the model."""
    fields = ("column string", "column_pos int", "test string", "kind string", "to string", "field string")
    customer, status = F.concat(F.lit("customer_"), "o_custkey"), F.col("o_orderstatus")
    cells = [F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast(f.split()[1]).alias(f.split()[0]) for f, x in zip(fields, cell)], on.alias("on")) for *cell, on in (
        ("id", 0, "unique", "builtin", None, None, F.lit(True)), ("id", 0, "not_null", "builtin", None, None, status != "P"),
        ("cust", 1, "relationships", "builtin", customer, "id", F.lit(True)), ("cust", 1, "relationships", "builtin", "archive", "key", status == "F"),
        ("cust", 1, "is_sane", "custom", None, None, status == "F"), (None, None, "adds_up", "custom", None, None, status == "O"))]
    return t.orders.select(F.concat(F.lit("order_"), "o_orderkey").alias("model"), F.inline(F.array(*cells))).filter("on").drop("on")


@query("r14_relationships", """SELECT concat('order_', o_orderkey) AS model, 'cust' AS "column", concat('customer_', o_custkey) AS target_model, 'id' AS target_field FROM orders
  UNION ALL SELECT concat('order_', o_orderkey), 'cust', 'archive', 'key' FROM orders WHERE o_orderstatus = 'F'""")
def r14_relationships(t: Tables):
    return R.relationship_tests(_tests(t))


@query("r14_model_tests", """SELECT concat('order_', o_orderkey) AS model, CASE WHEN o_orderstatus = 'P' THEN 'gap' ELSE 'info' END AS severity, 'identifier' AS category, CASE WHEN o_orderstatus <> 'P' THEN 'id' END AS "column" FROM orders
  UNION ALL SELECT concat('order_', o_orderkey), 'warning', 'macro', 'cust' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT concat('order_', o_orderkey), 'warning', 'macro', NULL FROM orders WHERE o_orderstatus = 'O'""")
def r14_model_tests(t: Tables):
    return R.column_test_report(_tests(t), t.orders.select(F.concat(F.lit("order_"), "o_orderkey").alias("model")))


@query("r15_flattened_templates", "SELECT o_orderkey, concat('select * from order_', o_orderkey, ' join raw.cust where a = ''x'' and t > 0', chr(10), chr(10), 'end this_model') AS sql FROM orders")
def r15(t: Tables):
    text = F.concat(F.lit("{{ config(materialized='table') }}\nselect * from {{ ref('order_"), "o_orderkey", F.lit("') }} join {{ source(\"raw\", 'cust') }} where a = {{ var('x') }}{% if is_incremental() %} and t > 1 {% else %} and t > 0{% endif %}{{ other() }}{%- set y = 1 -%}\n\n\n\nend {{ this }}"))
    return t.orders.select("o_orderkey", R.flatten_template(text).alias("sql"))


# ---- source code -------------------------------------------------------------------------------------------

_REPO = "concat('r', CAST(floor(p_partkey / 25.0) AS BIGINT))"
_FILE = "CASE p_partkey % 5 WHEN 0 THEN concat('src/main/T', p_partkey, '.java') WHEN 1 THEN concat('src/t', p_partkey, '.ts') WHEN 2 THEN concat('node_modules/x', p_partkey, '.js') WHEN 3 THEN concat('lib/m', p_partkey, '.py') ELSE CASE WHEN p_partkey % 25 = 4 THEN 'package.json' ELSE concat('src/k', p_partkey, '.kt') END END"
_CODE = r"""concat('\nexport enum Color', p_partkey, ' { RED = 1, GREEN }\ninterface Shape', p_partkey, ' extends Base {\n  name: string;\n  inner: { deep: number };\n  size?: number;\n}\ntype Mode', p_partkey, ' = \'on\' | \'off\';\n@Entity\npublic class Item', p_partkey,
  ' {\n  @NotNull\n  @Size(min = 1, max = ', p_size, ')\n  private String code;\n  @Min(5)\n  public int count() {\n    switch (this.status) { case \'new\': break; case \'old\': break; case \'gone\': default: { } }\n  }\n}\nexport function validateItem', p_partkey, '(item: Item', p_partkey, '): boolean {\n  if (x) { return true; }\n}\nfunction other(a: B) { }\n')"""


def parts(t: Tables):
    return spread(t.part.select("p_partkey", "p_size"), "p_partkey")


def files(t: Tables, dealt=None):
    return (parts(t) if dealt is None else dealt).select(F.expr(_REPO).alias("repo_id"), F.expr(_FILE).alias("path"), F.expr(_CODE).alias("content"))


def each_part(columns: str, more: str = "") -> str:
    return f"SELECT {_REPO} AS repo_id, {_FILE} AS path, {columns} FROM part {more}"


_LANGUAGE = "CASE p_partkey % 5 WHEN 0 THEN 'java' WHEN 1 THEN 'typescript' WHEN 3 THEN 'python' WHEN 4 THEN CASE WHEN p_partkey % 25 <> 4 THEN 'kotlin' END END"


@query("b01_language_census", f"SELECT {_REPO} AS repo_id, {_LANGUAGE} AS language, count(*) AS files FROM part WHERE {_LANGUAGE} IS NOT NULL GROUP BY ALL")
def b01(t: Tables):
    return B.language_census(files(t))


@query("b01_majority_language", f"SELECT repo_id, coalesce(l, 'unknown') AS language FROM (SELECT {_REPO} AS repo_id FROM part GROUP BY 1) LEFT JOIN (SELECT repo_id, min_by(language, (-n, language)) AS l FROM (SELECT {_REPO} AS repo_id, {_LANGUAGE} AS language, count(*) AS n FROM part WHERE {_LANGUAGE} IS NOT NULL GROUP BY ALL) GROUP BY 1) USING (repo_id)")
def b01_majority(t: Tables):
    return B.majority_language(files(t))


@query("b02_source_file_count", f"SELECT {_REPO} AS repo_id, CAST(count_if(p_partkey % 5 IN (0, 1) OR p_partkey % 5 = 4 AND p_partkey % 25 <> 4) AS BIGINT) AS files FROM part GROUP BY 1")
def b02(t: Tables):
    return B.source_file_count(files(t), ("src",), ("node_modules", "test"))


@query("b03_type_definitions", " UNION ALL ".join(each_part(f"'{k}' AS kind, concat('{n}', p_partkey) AS name, '{m}' AS members") for k, n, m in (
    ("enum", "Color", "RED,GREEN"), ("interface", "Shape", "name,inner,size"), ("type_alias", "Mode", "on,off"), ("class", "Item", "code"))))
def b03(t: Tables):
    return B.type_definitions(files(t)).withColumn("members", F.array_join("members", ","))


@query("b04_annotations", " UNION ALL ".join(each_part(f"{line} AS line, '{a}' AS annotation, concat('{c}', p_partkey) AS class_name, {target} AS target, '{kind}' AS target_kind, {params} AS parameters") for line, a, c, target, kind, params in (
    (9, "Entity", "Shape", "concat('Item', p_partkey)", "class", "''"), (11, "NotNull", "Item", "'code'", "field", "''"), (12, "Size", "Item", "'code'", "field", "concat('min=1;max=', p_size)"), (14, "Min", "Item", "'count'", "method", "'value=5'"))))
def b04(t: Tables):
    return B.annotations(files(t)).withColumn("parameters", F.array_join("parameters", ";"))


@query("b05_validations", each_part("concat('validateItem', p_partkey) AS name, 19 AS start_line, 21 AS end_line, concat('Item', p_partkey) AS target_type"))
def b05(t: Tables):
    return B.validations(files(t))


@query("b06_state_transitions", " UNION ALL ".join(each_part(f"16 AS start_line, 'status' AS state_field, {i} AS step, '{a}' AS \"from\", '{b}' AS \"to\"") for i, a, b in ((0, "new", "old"), (1, "old", "gone"))))
def b06(t: Tables):
    return B.state_transitions(files(t))


DETECTORS = [
    {"name": "beans", "languages": ["java", "kotlin"], "signals": [
        {"kind": "content", "pattern": "@Entity", "weight": "moderate"}, {"kind": "path", "pattern": r"^src/main/.*\.java$", "weight": "weak"}, {"kind": "dependency", "pattern": "Color", "weight": "strong"}]},
    {"name": "node", "languages": ["typescript", "java"], "signals": [{"kind": "path", "pattern": r"^package\.json$", "weight": "strong"}, {"kind": "content", "pattern": "Missing", "weight": "strong"}]},
    {"name": "snake", "languages": ["python"], "signals": [{"kind": "path", "pattern": r"\.py$", "weight": "weak"}]},
]
_FLAGS = f"SELECT {_REPO} AS repo_id, bool_or(p_partkey % 5 = 0) AS java, bool_or(p_partkey % 25 = 4) AS pkg FROM part GROUP BY 1"


@query("b07_framework_scores", f"""WITH m AS (SELECT repo_id, CASE WHEN repo_id LIKE '%1' THEN 'python' WHEN repo_id LIKE '%2' THEN 'typescript' ELSE 'java' END AS language FROM (SELECT DISTINCT {_REPO} AS repo_id FROM part)),
  s AS (SELECT m.repo_id, f, score, o FROM m JOIN ({_FLAGS}) g USING (repo_id), LATERAL (SELECT 'beans' AS f, 2 + java::INT + 3 * pkg::INT AS score, 0 AS o WHERE language IN ('java', 'kotlin') UNION ALL SELECT 'node', 3 * pkg::INT, 1 WHERE language IN ('typescript', 'java')) x)
  SELECT repo_id, arg_max(f, (score, -o)) AS framework, CAST(max(score) AS INTEGER) AS score, CASE WHEN max(score) >= 5 THEN 'high' WHEN max(score) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM s WHERE score >= 2 GROUP BY 1""")
def b07(t: Tables):
    language = F.when(F.col("repo_id").like("%1"), "python").when(F.col("repo_id").like("%2"), "typescript").otherwise("java")
    languages = t.part.select(F.expr(_REPO).alias("repo_id")).distinct().withColumn("language", language)
    return B.framework_scores(files(t), languages, DETECTORS)


@query("t07_best_detector", f"SELECT repo_id, CASE WHEN pkg OR java THEN 'beans' ELSE 'beans' END AS framework FROM ({_FLAGS})")
def t07(t: Tables):
    languages = t.part.select(F.expr(_REPO).alias("repo_id")).distinct().withColumn("language", F.lit("java"))
    return B.framework_scores(files(t), languages, DETECTORS).select("repo_id", "framework")


# Files of many kinds: what a file is called and what it says both follow from the part's number and size.
_SIGNAL_PATH = """CASE p_partkey % 11 WHEN 0 THEN concat('src/main/java/P', p_partkey, CASE p_size % 3 WHEN 0 THEN 'Controller.java' WHEN 1 THEN 'Repository.java' ELSE '.java' END)
  WHEN 1 THEN CASE p_size % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' WHEN 2 THEN 'Gemfile' ELSE 'pom.xml' END
  WHEN 2 THEN concat('src/a', p_partkey, '.module.ts') WHEN 3 THEN concat('src/x', p_partkey, 'routes.js')
  WHEN 4 THEN CASE p_size % 5 WHEN 0 THEN 'manage.py' WHEN 1 THEN concat('site', p_partkey, '/settings.py') WHEN 2 THEN 'app/models/user.rb' WHEN 3 THEN 'config/routes.rb' ELSE 'db/migrate/1.rb' END
  WHEN 5 THEN concat('shop/models', CASE WHEN p_size % 2 = 0 THEN '' ELSE 'x' END, '.py') WHEN 6 THEN concat('node_modules/m', p_partkey, '/views.py')
  WHEN 7 THEN concat('.git/u', p_partkey, '/urls.py') WHEN 8 THEN concat('conf/application.', CASE WHEN p_size % 2 = 0 THEN 'yml' ELSE 'xml' END)
  WHEN 9 THEN concat('lib/k', p_partkey, '.kt') ELSE concat('app/s', p_partkey, '.rb') END"""
_SIGNAL_TEXT = """CASE p_size % 14 WHEN 0 THEN concat('@Entity', chr(10), 'class A') WHEN 1 THEN concat('import x', chr(10), '@SpringBootApplication') WHEN 2 THEN '@Module (imports)'
  WHEN 3 THEN concat('const e = require(', chr(39), 'express', chr(39), '); app.get (1)') WHEN 4 THEN concat('from django.db import models', chr(10), 'class A(models.Model): pass')
  WHEN 5 THEN concat('from fastapi import FastAPI', chr(10), '@app.post(1)') WHEN 6 THEN 'class U < ApplicationRecord' WHEN 7 THEN concat(chr(34), 'express', chr(34), ': 1, ', chr(34), '@nestjs/core', chr(34))
  WHEN 8 THEN concat('django==4', chr(10), 'uvicorn', chr(10), 'pydantic') WHEN 9 THEN 'gem rails' WHEN 10 THEN 'spring-boot-starter' WHEN 11 THEN 'class M(BaseModel): pass'
  WHEN 12 THEN '@Injectable() @Controller ()' ELSE concat('nothing ', p_partkey) END"""
_SIGNAL_FILES = f"SELECT {_REPO} AS repo_id, {_SIGNAL_PATH} AS path, {_SIGNAL_TEXT} AS content FROM part"
_SPOKEN = "CASE CAST(substring(repo_id, 2, 9) AS INTEGER) % 5 WHEN 0 THEN 'java' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'ruby' ELSE 'kotlin' END"


def _signal_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({k}, '{f}', '{kind}', {quoted(p if kind in ('source', 'dependency') else B.path_pattern(kind, p))}, {B.SIGNAL_SCORES[w]})" for k, (f, kind, p, w) in enumerate(B.SIGNALS))
    places = ", ".join(f"({k}, '{name}', '{lang}')" for k, (name, spoken) in enumerate(B.FRAMEWORKS) for lang in spoken)
    builds = ", ".join(f"'{f}'" for f, *_ in B.BUILD_FILES)
    walked = f"NOT regexp_matches('/' || path, '/(?:{'|'.join(d.replace('.', '[.]') for d in B.NOT_SEARCHED)}|[.][^/]*)(?:/|$)')"
    return f"""WITH f AS ({_SIGNAL_FILES}), s(k, framework, kind, pattern, weight) AS (VALUES {rows}), w(place, framework, language) AS (VALUES {places}),
  hit AS (SELECT DISTINCT repo_id, k, s.framework, weight FROM f JOIN s ON CASE kind WHEN 'dependency' THEN path IN ({builds}) AND contains(content, pattern)
    WHEN 'glob' THEN regexp_matches(path, pattern) WHEN 'file' THEN regexp_matches(path, pattern) AND {walked} ELSE regexp_matches(content, pattern) AND {walked} END),
  sc AS (SELECT repo_id, framework, CAST(sum(weight) AS BIGINT) AS score FROM hit GROUP BY ALL HAVING sum(weight) >= 2)
  SELECT repo_id, framework, score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, place) = 1 AS best
  FROM sc JOIN w USING (framework) WHERE language = {_SPOKEN}"""


def scored_frameworks(t: Tables):
    files = t.spark.sql(_SIGNAL_FILES.replace("FROM part", "FROM {part}"), part=t.part)
    languages = t.part.select(F.expr(_REPO).alias("repo_id")).distinct().withColumn("language", F.expr(_SPOKEN))
    return B.framework_signals(files, languages, B.signal_table(t.spark))


@query("b07_framework_signals", _signal_sql())
def b07_signals(t: Tables):
    return scored_frameworks(t)


@query("t07_best_framework", f"SELECT repo_id, framework, confidence FROM ({_signal_sql()}) WHERE best")
def t07_best(t: Tables):
    return scored_frameworks(t).filter("best").select("repo_id", "framework", "confidence")


@query("b08_build_system", f"SELECT {_REPO} AS repo_id, 'npm' AS build_system, 'package.json' AS build_file FROM part WHERE p_partkey % 25 = 4 GROUP BY 1")
def b08(t: Tables):
    return B.build_system(files(t))


# ---- corpora on disk ------------------------------------------------------------------------------------------

def _written(t: Tables, name: str, df, key: str) -> str:
    """Write texts as files of bounded size below one directory per key and return the root."""
    ensure_checkpoint_dir(t.spark)
    root = f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", 1000).partitionBy(key).text(root)
    return root


@query("s09_sql_corpus", "SELECT CAST(o_orderkey % 7 AS VARCHAR) AS project, CAST(3 * count(*) + count_if(o_orderkey % 2 = 0) AS BIGINT) AS statements FROM orders GROUP BY 1")
def s09(t: Tables):
    root = _written(t, "sql", corpus(t).select("project", F.concat("sql", F.lit(";")).alias("value")), "project")
    read = read_sql(t.spark, root, "*.txt").withColumn("project", F.regexp_extract("file_path", "project=([^/]+)/", 1))
    return R.split_statements(read, "project").groupBy("project").agg(F.count("*").alias("statements"))


@query("s10_source_corpus", f"SELECT {_REPO} AS repo_id, count(*) AS enums FROM part WHERE {_REPO} <> 'r3' GROUP BY 1")
def s10(t: Tables):
    # a repository's texts are in one task, which writes them as one file or a few
    dealt = spread(t.part.select("p_partkey", "p_size"), F.expr(_REPO))
    root = _written(t, "code", files(t, dealt).select("repo_id", F.col("content").alias("value")), "repo_id")
    read = read_source(t.spark, root, (".txt",), excludes=("repo_id=r3/",)).withColumn("repo_id", F.regexp_extract("file_path", "repo_id=([^/]+)/", 1))
    return read.select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(B.ENUM), 1)).alias("e")).groupBy("repo_id").agg(F.count("*").alias("enums"))
