"""Candidate models: from the column tests of a model per order, a file of table definitions per order, and a source file per part."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factloom.operators import model_import as I, source_mining as B, sql_mining as R
from factloom.plans.session import materialize
from factloom.workloads.registry import Tables, query

PROJECT = "CAST(o_orderkey % 7 AS VARCHAR) AS project"
ORDER, CUSTOMER = "concat('order_', o_orderkey)", "concat('customer_', o_custkey)"
ORDERS, CUSTOMERS = "concat('Order', o_orderkey)", "concat('Customer', o_custkey)"


def told(source: str, column: str, extra: str, rest: str = "FROM orders") -> str:
    return f"SELECT {PROJECT}, {source} AS source, '{column}' AS \"column\", {extra} {rest}"


# ---- column tests -----------------------------------------------------------------------------------------

# Every third order also brings its customer's model; the other customers may be referred to, but are no models.
_KNOWN = "known AS (SELECT DISTINCT o_orderkey % 7 AS p, o_custkey AS c FROM orders WHERE o_orderkey % 3 = 0)"
_HAS, _LACKS = ("(o_orderkey % 7, o_custkey) {0} (SELECT (p, c) FROM known)".format(x) for x in ("IN", "NOT IN"))
_CUSTOMER_MODELS = "FROM (SELECT p AS o_orderkey, c AS o_custkey FROM known)"  # p is below 7, and so its own remainder


def columns_and_tests(t: Tables):
    def rows(df, cells, *names: str):
        made = F.array(*[F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(names, cell)]) for cell in cells])
        return df.select("project", "model", F.inline(made))

    project = (F.col("o_orderkey") % 7).cast("string").alias("project")
    orders = t.orders.select(project, F.concat(F.lit("order_"), "o_orderkey").alias("model"), "o_orderkey", "o_custkey", "o_orderstatus")
    customers = t.orders.filter("o_orderkey % 3 = 0").select(project, F.concat(F.lit("customer_"), "o_custkey").alias("model")).distinct()
    columns = rows(orders, [(c, i) for i, c in enumerate(("id", "cust", "state", "code", "kind"))], "column", "column_pos").unionByName(
        rows(customers, [("id", 0), ("full_name", 1)], "column", "column_pos"))
    none, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    key, to = F.col("o_orderkey"), F.concat(F.lit("customer_"), "o_custkey")
    accepted = F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus", F.lit("x")))
    names = ("column", "test_pos", "test", "to", "field", "values", "on")
    yes = F.lit(True)
    tests = [
        ("id", 0, "unique", none, none, texts, yes), ("id", 1, "not_null", none, none, texts, F.col("o_orderstatus") != "P"), ("cust", 0, "relationships", to, F.lit("id"), texts, yes),
        ("cust", 1, "relationships", F.lit("archive"), F.lit("key"), texts, yes), ("cust", 2, "not_null", none, none, texts, key % 2 == 0), ("state", 0, "accepted_values", none, none, accepted, yes),
        ("state", 1, "accepted_values", none, none, F.array(F.lit("later")), yes), ("code", 0, "unique", none, none, texts, yes), ("code", 1, "is_sane", none, none, texts, yes)]
    own = [("id", 0, "unique", none, none, texts, yes), ("id", 1, "not_null", none, none, texts, yes), ("full_name", 0, "not_null", none, none, texts, yes)]
    return columns, rows(orders, tests, *names).unionByName(rows(customers, own, *names)).filter("on").drop("on")


def tested(t: Tables) -> I.CandidateModel:
    return I.tested_model(*columns_and_tests(t))


_ORDERS_WITH_KEY = "FROM orders WHERE o_orderstatus <> 'P'"
_VALUE_FACT = "'value' AS kind, concat({0}, ' has {1}') AS fact_type, {0} AS first_player, '{1}' AS second_player"


@query("n01_tested_facts", f"WITH {_KNOWN} " + " UNION ALL ".join(
    [told(ORDER, column, _VALUE_FACT.format(ORDERS, name), _ORDERS_WITH_KEY) for column, name in (("state", "State"), ("code", "Code"), ("kind", "Kind"))]
    + [told(CUSTOMER, "full_name", _VALUE_FACT.format(CUSTOMERS, "FullName"), _CUSTOMER_MODELS),
       told(ORDER, "cust", f"'reference' AS kind, concat({ORDERS}, ' has ', {CUSTOMERS}) AS fact_type, {CUSTOMERS} AS first_player, {ORDERS} AS second_player", f"{_ORDERS_WITH_KEY} AND {_HAS}")]))
def n01(t: Tables):
    return tested(t).fact_types


def _constraint(source: str, column: str, ord_: str, kind: str, role: int, rest: str, allowed: str = "NULL") -> str:
    return told(source, column, f"CAST({ord_} AS INTEGER) AS ord, '{kind}' AS type, CAST({role} AS INTEGER) AS role, CAST({allowed} AS VARCHAR) AS allowed", rest)


@query("n02_tested_constraints", f"WITH {_KNOWN} " + " UNION ALL ".join(
    [_constraint(ORDER, c, "0", "internal_uniqueness", 0, _ORDERS_WITH_KEY) for c in ("state", "code", "kind")] + [
        _constraint(ORDER, "state", "1", "value_constraint", 1, f"{_ORDERS_WITH_KEY} AND o_orderkey % 5 <> 0", "concat(o_orderstatus, '|x')"),
        _constraint(ORDER, "code", "1", "internal_uniqueness", 1, _ORDERS_WITH_KEY),
        _constraint(CUSTOMER, "full_name", "0", "internal_uniqueness", 0, _CUSTOMER_MODELS), _constraint(CUSTOMER, "full_name", "1", "mandatory", 0, _CUSTOMER_MODELS),
        _constraint(ORDER, "cust", "0", "internal_uniqueness", 1, f"{_ORDERS_WITH_KEY} AND {_HAS}"),
        _constraint(ORDER, "cust", "1", "mandatory", 1, f"{_ORDERS_WITH_KEY} AND {_HAS} AND o_orderkey % 2 = 0")]))
def n02(t: Tables):
    return tested(t).constraints.withColumn("allowed", F.array_join("allowed", "|"))


@query("n03_tested_report", f"WITH {_KNOWN} " + " UNION ALL ".join([
    told(ORDER, "state", "'warning' AS severity, 'constraint' AS category", f"{_ORDERS_WITH_KEY} AND o_orderkey % 5 = 0"),
    told(ORDER, "cust", "'gap' AS severity, 'relationship' AS category", f"{_ORDERS_WITH_KEY} AND {_LACKS}"),
    told(ORDER, "cust", "'info' AS severity, 'relationship' AS category", f"{_ORDERS_WITH_KEY} AND {_HAS}")]))
def n03(t: Tables):
    return tested(t).report


# ---- table definitions --------------------------------------------------------------------------------------

_DEFINITIONS = r"""concat('-- tables of order ', o_orderkey, ';\nCREATE TABLE order_', o_orderkey, ' (id INT PRIMARY KEY, cust_id BIGINT NOT NULL, "state" VARCHAR(10), price DECIMAL(10, 2) NOT NULL,\n  note TEXT DEFAULT \'a,b\', amount MONEY, CHECK (price > 0 AND (state IN (\'x\', \'y\'))), UNIQUE (state, price), FOREIGN KEY (cust_id) REFERENCES customer_', o_custkey, ' (id));\n',
  CASE WHEN o_orderkey % 3 = 0 THEN concat('create table "customer_', o_custkey, '" (id SERIAL, region INT, full_name VARCHAR(40) NOT NULL, assigned_order_id INT,\n  PRIMARY KEY (id, "region"), FOREIGN KEY (assigned_order_id) REFERENCES "order_', o_orderkey, '" (id));\n') ELSE '' END, 'CREATE TABLE bad.name (x INT); ALTER TABLE order_', o_orderkey, ' ADD y INT')"""
_BY_THREE = "FROM orders WHERE o_orderkey % 3 = 0"


def definitions(t: Tables):
    texts = t.orders.select((F.col("o_orderkey") % 7).cast("string").alias("project"), F.concat(F.lit("ddl/"), "o_orderkey", F.lit(".sql")).alias("file_path"), F.expr(_DEFINITIONS).alias("sql"))
    return I.defined_tables(R.split_statements(texts, "project"))


def defined(t: Tables) -> I.CandidateModel:
    return I.defined_model(definitions(t))


@query("n04_defined_entities", f"""SELECT {PROJECT}, {ORDER} AS source, {ORDERS} AS entity, 'id' AS reference_mode FROM orders
  UNION ALL SELECT {PROJECT}, {CUSTOMER}, {CUSTOMERS}, concat({CUSTOMER}, '_id') {_BY_THREE}""")
def n04(t: Tables):
    return I.entity_types(definitions(t))


_COLUMN = "CAST({0} AS INTEGER) AS pos, '{1}' AS data_type, {2} AS nullable"


@query("n04_defined_columns", " UNION ALL ".join(
    [told(ORDER, c, _COLUMN.format(i, kind, null)) for i, (c, kind, null) in enumerate((("id", "INT", "TRUE"), ("cust_id", "BIGINT", "FALSE"), ("state", "VARCHAR", "TRUE"), ("price", "DECIMAL", "FALSE"), ("amount", "MONEY", "TRUE")))]
    + [told(CUSTOMER, c, _COLUMN.format(i, kind, null), _BY_THREE) for i, (c, kind, null) in enumerate((("id", "SERIAL", "TRUE"), ("region", "INT", "TRUE"), ("full_name", "VARCHAR", "FALSE"), ("assigned_order_id", "INT", "TRUE")))]))
def n04_columns(t: Tables):
    return definitions(t).select("project", "source", F.inline("columns"))


def _defined_value(source: str, entity: str, column: str, name: str, kind: str, rest: str) -> str:
    return told(source, column, f"'value' AS kind, concat({entity}, ' has {name}') AS fact_type, '{name}' AS first_player, {entity} AS second_player, '{kind}' AS data_type", rest)


@query("n05_defined_facts", f"WITH {_KNOWN} " + " UNION ALL ".join([
    *[_defined_value(ORDER, ORDERS, c, n, k, "FROM orders") for c, n, k in (("state", "State", "text"), ("price", "Price", "decimal"), ("amount", "Amount", "money"))],
    _defined_value(CUSTOMER, CUSTOMERS, "full_name", "FullName", "text", _BY_THREE),
    told(ORDER, "cust_id", f"'reference' AS kind, concat({ORDERS}, ' cust ', {CUSTOMERS}) AS fact_type, {CUSTOMERS} AS first_player, {ORDERS} AS second_player, NULL AS data_type", f"FROM orders WHERE {_HAS}"),
    told(CUSTOMER, "assigned_order_id", f"'reference' AS kind, concat({CUSTOMERS}, ' assigned to ', {ORDERS}) AS fact_type, {ORDERS} AS first_player, {CUSTOMERS} AS second_player, NULL AS data_type", _BY_THREE)]))
def n05(t: Tables):
    return defined(t).fact_types


def _defined(source: str, column: str, ord_: int, kind: str, role: int, rest: str) -> str:
    return told(source, column, f"CAST({ord_} AS INTEGER) AS ord, '{kind}' AS type, CAST({role} AS INTEGER) AS role", rest)


@query("n06_defined_constraints", f"WITH {_KNOWN} " + " UNION ALL ".join([
    _defined(ORDER, "state", 0, "internal_uniqueness", 1, "FROM orders"), _defined(ORDER, "price", 0, "internal_uniqueness", 1, "FROM orders"), _defined(ORDER, "price", 1, "mandatory", 0, "FROM orders"),
    _defined(ORDER, "amount", 0, "internal_uniqueness", 0, "FROM orders"), _defined(ORDER, "cust_id", 0, "internal_uniqueness", 1, f"FROM orders WHERE {_HAS}"),
    _defined(ORDER, "cust_id", 1, "mandatory", 1, f"FROM orders WHERE {_HAS}"), _defined(CUSTOMER, "full_name", 0, "internal_uniqueness", 0, _BY_THREE),
    _defined(CUSTOMER, "full_name", 1, "mandatory", 0, _BY_THREE), _defined(CUSTOMER, "assigned_order_id", 0, "internal_uniqueness", 1, _BY_THREE)]))
def n06(t: Tables):
    return defined(t).constraints.drop("allowed")


@query("n06_defined_report", f"WITH {_KNOWN} " + told(ORDER, "cust_id", "'gap' AS severity, 'relationship' AS category", f"FROM orders WHERE {_LACKS}"))
def n06_report(t: Tables):
    return defined(t).report


# ---- source code --------------------------------------------------------------------------------------------

REPO, SOURCE = "concat('r', CAST(floor(p_partkey / 25.0) AS BIGINT))", "concat('src/F', lpad(CAST(p_partkey AS STRING), 9, '0'), '.java')"
_SOURCE_SQL = SOURCE.replace("STRING", "VARCHAR")
_MODEL_CODE = r"""concat('package p;\nenum Color', p_partkey % 20, ' { RED, GREEN }\n@Entity\npublic class Item', p_partkey, ' {\n  @Id\n  private Long code', p_partkey % 3, ';\n  @NotNull\n  private String label;\n  @ManyToOne\n  private Maker maker', p_partkey % 7,
  ';\n  void run() { switch (this.status) { case \'new\': break; case \'old\': break; case \'', p_type, '\': break; } }\n}\ninterface Maker', p_partkey % 5, ' {\n  ', CASE WHEN p_partkey % 2 = 0 THEN 'id' ELSE 'other' END, ': string;\n}\nclass Item', p_partkey, 'Service {\n}\ntype Mode', p_partkey % 4, ' = \'on\' | \'off\';\n')"""


def model_files(t: Tables):
    return t.part.select(F.expr(REPO).alias("repo_id"), F.expr(SOURCE).alias("path"), F.expr(_MODEL_CODE).alias("content"))


def mined(t: Tables) -> I.SourceModel:
    files = materialize(model_files(t), "model-files")
    return I.source_model(B.type_definitions(files), B.annotations(files), B.state_transitions(files))


def _type(name: str, kind: str, mode: str, allowed: str, group: str = "") -> str:
    return f"SELECT {REPO} AS repo_id, {name} AS name, '{kind}' AS kind, {mode} AS reference_mode, {allowed} AS allowed FROM part {group}"


# Of several files with one name the first by path counts; paths have numbers of equal length, so the smallest part comes first.
@query("n07_source_types", " UNION ALL ".join([
    _type("concat('Color', p_partkey % 20)", "value", "NULL", "'RED|GREEN'", "GROUP BY ALL"), _type("concat('Mode', p_partkey % 4)", "value", "NULL", "'on|off'", "GROUP BY ALL"),
    _type("concat('Item', p_partkey)", "entity", "concat('code', p_partkey % 3)", "NULL"),
    _type("concat('Maker', p_partkey % 5)", "entity", "CASE WHEN min(p_partkey) % 2 = 0 THEN 'id' ELSE concat('maker', p_partkey % 5, '_id') END", "NULL", f"GROUP BY {REPO}, p_partkey % 5"),
    _type("'Status'", "value", "NULL", "concat('new|old|', min_by(p_type, p_partkey))", f"GROUP BY {REPO}")]))
def n07(t: Tables):
    return mined(t).object_types.withColumn("allowed", F.array_join("allowed", "|"))


@query("n08_source_facts", f"""SELECT {REPO} AS repo_id, concat('Item', p_partkey, ' has Maker', p_partkey % 7) AS fact_type, concat('Item', p_partkey) AS first_player, concat('Maker', p_partkey % 7) AS second_player FROM part
  WHERE ({REPO}, p_partkey % 7) IN (SELECT ({REPO}, p_partkey % 5) FROM part)""")
def n08(t: Tables):
    return mined(t).fact_types


@query("n09_source_review", f"SELECT {REPO} AS repo_id, {_SOURCE_SQL} AS path, CAST(7 AS INTEGER) AS line, 'NotNull' AS annotation, concat('Item', p_partkey) AS class_name, 'label' AS target, '' AS parameters FROM part")
def n09(t: Tables):
    return mined(t).review.withColumn("parameters", F.array_join("parameters", ";"))
