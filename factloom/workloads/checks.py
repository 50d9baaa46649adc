"""Constraint checks over the provided tables (sources, predicates, checks, joins and set aggregates)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from factloom.functions import predicates as P
from factloom.operators import engine, keys, paths, rings, sets
from factloom.plans.violations import record, report_order
from factloom.workloads.registry import Tables, flat, flat_sql, query
from factloom.workloads.retail import CONSTRAINTS, FACT_TYPES, ORDER_NATION_BY_CUSTOMER, ORDER_NATION_BY_SUPPLIER, facts

LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
FOLLOW = """(SELECT CAST(event_id AS VARCHAR) AS inst, event_type AS pop, user_id AS a,
  lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events)"""
EDGES = f"(SELECT pop, inst, a, b FROM {FOLLOW} WHERE b IS NOT NULL)"
WEIGHTED = f"(SELECT pop, a, b, count(*) AS m FROM {EDGES} GROUP BY ALL)"
REFERS = """(SELECT CAST(o_orderkey AS VARCHAR) AS inst, o_orderkey AS ord, o_orderpriority AS pop, CAST(o_custkey AS VARCHAR) AS a,
  CAST(CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 7) % 1600 END AS VARCHAR) AS b FROM orders)"""
STATE = """(SELECT CAST(o_orderkey AS VARCHAR) AS inst, o_orderpriority AS pop, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS a,
  CASE WHEN o_orderstatus = 'O' OR o_orderpriority = '1-URGENT' THEN o_custkey END AS b FROM orders)"""
ORDER_UNIVERSE = "(SELECT o_orderkey AS v FROM orders UNION SELECT l_orderkey FROM lineitem)"
BY_CUSTOMER = "(SELECT DISTINCT o_orderkey AS o, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey)"
BY_SUPPLIER = "(SELECT DISTINCT l_orderkey AS o, s_nationkey AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


STATED: dict[str, str] = {}  # the query of each constraint


def _check(name: str, constraint: str, tables: tuple[str, ...], sql: str, *details: str):
    STATED[constraint] = name

    @query(name, sql)
    def build(t: Tables):
        return flat(engine.check(facts(t, *tables), CONSTRAINTS[constraint]), *details)


def _sql(cid: str, rule: str, body: str, subject: str, **more) -> str:
    c = CONSTRAINTS[cid]
    more.setdefault("element", f"'{cid}'")
    return flat_sql(f"population/{rule}-violation", body, subject, severity=f"'{c.severity}'", constraint=f"'{cid}'",
                    fact_type=f"'{c.fact_type}'", **more)


# ---- sources -------------------------------------------------------------------------------------

@query("s01_fact_source", f"""SELECT 'lines' AS pop_id, {LINE_ID} AS inst_id, FALSE AS sample, l_orderkey AS ln_ord,
  l_linenumber AS ln_num, l_partkey AS ln_part, l_suppkey AS ln_supp, l_discount AS ln_disc FROM lineitem""")
def s01(t: Tables):
    return facts(t, "line").rows("line").drop("ord")


# ---- predicates ----------------------------------------------------------------------------------

# Texts with numbers and words mixed, so that both branches of the comparison are taken.
MIXED = """(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) ELSE ' ' || CAST(user_id AS VARCHAR) || 'e1' END AS a,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS VARCHAR) ELSE CASE WHEN event_id % 5 = 0 THEN 'NaN' ELSE '1d' END END AS b FROM events)"""
NUM = r"regexp_full_match({0}, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')"


def mixed(t: Tables):
    a = F.expr("CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN CAST(user_id AS STRING) ELSE ' ' || CAST(user_id AS STRING) || 'e1' END")
    b = F.expr("CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS STRING) ELSE CASE WHEN event_id % 5 = 0 THEN 'NaN' ELSE '1d' END END")
    return t.events.select("event_id", a.alias("a"), b.alias("b"))


_both = f"{NUM.format('a')} AND {NUM.format('b')}"
_num = "TRY_CAST(trim({0}) AS DOUBLE)"


@query("p01_compare", "SELECT event_id, " + ", ".join(
    f"CASE WHEN {_both} THEN {_num.format('a')} {op} {_num.format('b')} ELSE a {op} b END AS {alias}"
    for op, alias in (("<", "lt"), ("<=", "le"), ("=", "eq"), ("<>", "ne"), (">=", "ge"), (">", "gt"))) + f" FROM {MIXED}")
def p01(t: Tables):
    ops = (("<", "lt"), ("<=", "le"), ("=", "eq"), ("<>", "ne"), (">=", "ge"), (">", "gt"))
    return mixed(t).select("event_id", *[P.compare(F.col("a"), op, F.col("b")).alias(alias) for op, alias in ops])


@query("p02_in_range", f"""SELECT event_id, CASE WHEN {NUM.format('a')} THEN {_num.format('a')} >= 5 AND {_num.format('a')} < 300 ELSE a >= '5' AND a < '300' END AS between_5_300,
  a > 'click' AS after_click, CASE WHEN {NUM.format('a')} THEN {_num.format('a')} <= 70 ELSE a <= '70' END AS up_to_70 FROM {MIXED}""")
def p02(t: Tables):
    R = P.ValueRange
    return mixed(t).select(
        "event_id",
        P.in_range(F.col("a"), R("5", "300", max_inclusive=False)).alias("between_5_300"),
        P.in_range(F.col("a"), R("click", None, min_inclusive=False)).alias("after_click"),
        P.in_range(F.col("a"), R(None, "70")).alias("up_to_70"))


@query("p03_in_values", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS allowed FROM customer")
def p03(t: Tables):
    return t.customer.select("c_custkey", P.in_values(F.col("c_mktsegment"), ("BUILDING", "MACHINERY")).alias("allowed"))


@query("p04_incomplete_rows", f"""SELECT inst, CASE WHEN a IS NULL AND b IS NULL THEN 'done,open' WHEN a IS NULL THEN 'done' ELSE 'open' END AS missing
  FROM {STATE} WHERE a IS NULL OR b IS NULL""")
def p04(t: Tables):
    rows = facts(t, "state").rows("state")
    lacking = P.missing_roles([("st_done", "done"), ("st_open", "open")])
    return rows.filter("st_done IS NULL OR st_open IS NULL").select(F.col("inst_id").alias("inst"), F.array_join(lacking, ",").alias("missing"))


@query("p05_same_name", "SELECT doc_id FROM documents WHERE lower(lang) = lower('EN')")
def p05(t: Tables):
    return t.documents.filter(P.same_name(F.col("lang"), "EN")).select("doc_id")


@query("p06_keyword", """SELECT event_type, k, contains(replace(lower(event_type), ' ', '_'), regexp_replace(lower(k), '[\\s-]+', '_', 'g')) AS hit, count(*) AS n
  FROM events, (VALUES ('Pur'), ('CLICK'), ('sign-up'), ('sign up')) AS ks(k) GROUP BY ALL""")
def p06(t: Tables):
    words = F.explode(F.array(*[F.lit(w) for w in ("Pur", "CLICK", "sign-up", "sign up")]))
    return (t.events.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", words.alias("k"), "n")
            .withColumn("hit", P.matches_keyword(F.col("event_type"), F.col("k"))))


@query("p08_composite_key", f"""SELECT pop, a, coalesce(b, '') AS b, count(*) AS n FROM {REFERS} GROUP BY ALL""")
def p08(t: Tables):
    rows = facts(t, "refers").rows("refers").select(F.col("pop_id").alias("pop"), *[F.col(f"rf_{x}").cast("string").alias(x) for x in "ab"])
    return rows.groupBy("pop", *[P.group_key(x, T.StringType()).alias(x) for x in "ab"]).agg(F.count("*").alias("n"))


@query("f08_is_number", f"SELECT event_id, {NUM.format('a')} AS a_num, {NUM.format('b')} AS b_num FROM {MIXED}")
def f08(t: Tables):
    return mixed(t).select("event_id", P.is_number(F.col("a")).alias("a_num"), P.is_number(F.col("b")).alias("b_num"))


@query("f14_has_all_terms", """SELECT doc_id, contains(lower(text), 'th') AND contains(lower(text), 'der') AS found FROM documents""")
def f14(t: Tables):
    return t.documents.select("doc_id", P.has_all_terms(F.col("text"), F.array(F.lit("Th"), F.lit("DER"))).alias("found"))


# ---- row and key checks ---------------------------------------------------------------------------

@query("c02_incomplete_instance", flat_sql(
    "population/incomplete-instance", f"FROM {STATE} WHERE a IS NULL OR b IS NULL",
    "CASE WHEN a IS NULL AND b IS NULL THEN 'Done|Open' WHEN a IS NULL THEN 'Done' ELSE 'Open' END",
    element="inst", fact_type="'state'", pop="pop", inst="inst"))
def c02(t: Tables):
    from factloom.operators.rows import check_local
    return flat(check_local(facts(t, "state"), [], incomplete_instances=True))


_check("c03_uniqueness", "c03", ("line",), _sql("c03", "uniqueness", f"""FROM (SELECT *, {LINE_ID} AS inst, first_value({LINE_ID}) OVER w AS first_inst, row_number() OVER w AS rn
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER})) WHERE rn > 1""",
    "l_orderkey || '|' || l_linenumber", element="'lines'", pop="'lines'", inst="inst", extra=", first_inst AS first"), "first")
_check("c03_uniqueness_missing_key", "c03r", ("refers",), _sql("c03r", "uniqueness", f"""FROM (SELECT *, first_value(inst) OVER w AS first_inst, row_number() OVER w AS rn
  FROM {REFERS} WINDOW w AS (PARTITION BY pop, coalesce(b, '') ORDER BY ord)) WHERE rn > 1""",
    "coalesce(b, '')", element="pop", pop="pop", inst="inst", extra=", first_inst AS first"), "first")
_check("c03_uniqueness_turns", "c03t", ("turn",), _sql("c03t", "uniqueness", """FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn) AS rn FROM conversations) WHERE rn > 1""",
    "conv_id", element="'turns'", pop="'turns'", inst="conv_id"))
_check("c03_uniqueness_pages", "c03p", ("page",), _sql("c03p", "uniqueness", """FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages) WHERE rn > 1""",
    "url", element="'pages'", pop="'pages'", inst="page_id"))
_check("c04_external_uniqueness", "c04", ("cust_nation", "cust_segment"), _sql("c04", "external-uniqueness", """FROM (SELECT *, row_number() OVER w AS rn, first_value(c_custkey) OVER w AS f
  FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)) WHERE rn > 1""",
    "c_custkey", extra=", CAST(f AS VARCHAR) AS first"), "first")
_check("c06_value_range", "c06", ("line",), _sql("c06", "value-constraint", "FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05)", "l_discount",
    element="'lines'", pop="'lines'", inst=LINE_ID))
_check("c06_value_set_deontic", "c06d", ("document",), _sql("c06d", "value-constraint", "FROM documents WHERE NOT (lang IN ('en', 'de') OR lang BETWEEN 'f' AND 'g')", "lang",
    element="source", pop="source", inst="doc_id"))
_check("c07_value_comparison", "c07", ("dates",), _sql("c07", "value-comparison", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate",
    "CAST(l_shipdate AS VARCHAR) || '|' || CAST(o_orderdate AS VARCHAR)", element="'dates'", pop="'dates'", inst=LINE_ID))
_check("c08_frequency", "c08", ("line",), _sql("c08", "frequency", "FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n < 2 OR n > 7", "l_orderkey",
    element="'lines'", pop="'lines'", extra=", CAST(n AS VARCHAR) AS count, CASE WHEN n < 2 THEN 'min' ELSE 'max' END AS bound"), "count", "bound")
_check("c09_exclusion_local", "c09", ("follow",), _sql("c09", "exclusion", f"FROM {EDGES} WHERE a = b", "a", element="pop", pop="pop", inst="inst"))
_check("c10_exclusion_spanning", "c10", ("cust_nation", "supp_nation"), _sql("c10", "exclusion", "FROM (SELECT c_nationkey AS v FROM customer INTERSECT SELECT s_nationkey FROM supplier)", "v",
    extra=", '2' AS roles"), "roles")
_check("c11_exclusive_or_local", "c11", ("state",), _sql("c11", "exclusive-or", f"FROM {STATE} WHERE (a IS NULL) = (b IS NULL)",
    "CASE WHEN a IS NULL THEN '' ELSE 'st_done|st_open' END", element="pop", pop="pop", inst="inst"))
_check("c12_exclusive_or_spanning", "c12", ("places", "line", "finished", "urgent"), _sql("c12", "exclusive-or", f"""FROM (SELECT v, (coalesce(o_orderstatus, '') = 'F')::INT + (coalesce(o_orderpriority, '') = '1-URGENT')::INT AS n
  FROM {ORDER_UNIVERSE} LEFT JOIN orders ON v = o_orderkey) WHERE n <> 1""", "v", extra=", CAST(n AS VARCHAR) AS roles"), "roles")
_check("c13_subset_local", "c13", ("refers",), _sql("c13", "subset", f"FROM {REFERS} r WHERE NOT EXISTS (SELECT 1 FROM {REFERS} s WHERE s.pop = r.pop AND s.a = coalesce(r.b, ''))",
    "coalesce(b, '')", element="pop", pop="pop", inst="inst"))
_check("c14_subset_spanning", "c14", ("places", "line"), _sql("c14", "subset", "FROM (SELECT o_orderkey AS v FROM orders EXCEPT SELECT l_orderkey FROM lineitem)", "v"))
_check("c15_equality_local", "c15", ("refers",), _sql("c15", "equality", f"""FROM (SELECT inst, pop, a AS s, 'rf_a' AS side FROM {REFERS} r WHERE NOT EXISTS (SELECT 1 FROM {REFERS} s WHERE s.pop = r.pop AND coalesce(s.b, '') = r.a)
  UNION ALL SELECT inst, pop, coalesce(b, ''), 'rf_b' FROM {REFERS} r WHERE NOT EXISTS (SELECT 1 FROM {REFERS} s WHERE s.pop = r.pop AND s.a = coalesce(r.b, '')))""",
    "s", element="pop", pop="pop", inst="inst", extra=", side AS roles"), "roles")
_check("c16_equality_spanning", "c16", ("cust_nation", "places"), _sql("c16", "equality", """FROM ((SELECT c_custkey AS v, 'second' AS m FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
  UNION ALL (SELECT DISTINCT o_custkey, 'first' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)))""", "v", extra=", m AS missing"), "missing")

# ---- rings ----------------------------------------------------------------------------------------

_ring = dict(element="pop", pop="pop", inst="inst")
_has_reverse = f"EXISTS (SELECT 1 FROM {EDGES} s WHERE s.pop = r.pop AND s.a = r.b AND s.b = r.a)"
for _n, _c, _where in (
    ("c17_ring_irreflexive", "c17", "a = b"),
    ("c18_ring_asymmetric", "c18", _has_reverse),
    ("c19_ring_antisymmetric", "c19", f"a <> b AND {_has_reverse}"),
    ("c20_ring_symmetric", "c20", f"NOT {_has_reverse}"),
    ("c24_ring_purely_reflexive", "c24", "a <> b"),
):
    _check(_n, _c, ("follow",), _sql(_c, "ring", f"FROM {EDGES} r WHERE {_where}", "a || '|' || b", **_ring))
_paths = f"FROM {WEIGHTED} x JOIN {WEIGHTED} y ON x.pop = y.pop AND x.b = y.a"
_closed = f"EXISTS (SELECT 1 FROM {WEIGHTED} z WHERE z.pop = x.pop AND z.a = x.a AND z.b = y.b)"
_check("c21_ring_intransitive", "c21", ("follow",), _sql("c21", "ring", f"FROM (SELECT x.pop AS pop, x.a, x.b, y.b AS c, x.m * y.m AS n {_paths} WHERE {_closed})",
    "a || '|' || b || '|' || c", element="pop", pop="pop", extra=", CAST(n AS VARCHAR) AS row_pairs"), "row_pairs")
_check("c22_ring_transitive", "c22", ("follow",), _sql("c22", "ring", f"FROM (SELECT x.pop AS pop, x.a, x.b, CAST(sum(x.m * y.m) AS BIGINT) AS n {_paths} WHERE NOT {_closed} GROUP BY ALL)",
    "a || '|' || b", element="pop", pop="pop", extra=", CAST(n AS VARCHAR) AS row_pairs"), "row_pairs")


def _cycle_sql(cid: str, edges: str) -> str:
    return f"WITH RECURSIVE e AS (SELECT DISTINCT pop, a, b FROM {edges} WHERE b IS NOT NULL), r AS (SELECT pop, a, b FROM e UNION SELECT r.pop, r.a, e.b FROM r JOIN e ON r.pop = e.pop AND r.b = e.a) " + \
        _sql(cid, "ring", "FROM (SELECT DISTINCT pop FROM r WHERE a = b)", "pop", element="pop", pop="pop")


_check("c23_ring_acyclic", "c23", ("follow",), _cycle_sql("c23", EDGES))

# A part of several ranks: each order refers to a smaller one, so only some groups close a cycle.
REFERENCES = """(SELECT CAST(o_orderkey % 97 AS VARCHAR) AS pop, o_orderkey AS a,
  CASE WHEN o_orderkey % 9701 = 5 THEN o_orderkey + 97 * 40 WHEN o_orderkey >= 97 THEN o_orderkey - 97 END AS b FROM orders)"""


@query("c23_cycles_in_long_chains", f"""WITH RECURSIVE e AS (SELECT DISTINCT pop, a, b FROM {REFERENCES}), r AS (SELECT pop, a, b FROM e UNION SELECT r.pop, r.a, e.b FROM r JOIN e ON r.pop = e.pop AND r.b = e.a)
  SELECT DISTINCT pop AS pop_id FROM r WHERE a = b""")
def c23_chains(t: Tables):
    edges = t.orders.selectExpr(
        "CAST(o_orderkey % 97 AS STRING) AS pop_id", "o_orderkey AS a",
        "CASE WHEN o_orderkey % 9701 = 5 THEN o_orderkey + 97 * 40 WHEN o_orderkey >= 97 THEN o_orderkey - 97 END AS b")
    return rings.cyclic_groups(edges)


@query("c22_missing_steps", f"""SELECT DISTINCT x.pop AS pop_id, x.a, x.b, y.b AS c {_paths} WHERE x.a = x.b - 1 AND NOT {_closed}""")
def c22_steps(t: Tables):
    fs = facts(t, "follow")
    chosen = rings.edge_rows(fs, CONSTRAINTS["c22"]).filter("a = b - 1").select("pop_id", "a", "b").distinct()
    return rings.missing_steps(fs, CONSTRAINTS["c22"], chosen)


# ---- universe checks ------------------------------------------------------------------------------

_check("c25_mandatory", "c25", ("places", "line"), _sql("c25", "mandatory", f"FROM {ORDER_UNIVERSE} WHERE v NOT IN (SELECT l_orderkey FROM lineitem)", "v"))
_check("c25_mandatory_samples", "c25d", ("document", "label"), _sql("c25d", "mandatory", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "doc_id"))
_check("c25_mandatory_passing", "c25c", ("places", "cust_nation"), _sql("c25c", "mandatory", "FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "c_custkey"))
_check("c26_disjunctive_mandatory", "c26", ("places", "line", "finished", "urgent"), _sql("c26", "disjunctive-mandatory",
    f"FROM {ORDER_UNIVERSE} LEFT JOIN orders ON v = o_orderkey WHERE NOT coalesce(o_orderstatus = 'F' OR o_orderpriority = '1-URGENT', FALSE)", "v"))


@query("c27_object_cardinality", flat_sql("population/object-cardinality-violation", f"""FROM (SELECT 'Order' AS e, count(DISTINCT v) AS n, 'max' AS bound FROM {ORDER_UNIVERSE} HAVING n > 10
  UNION ALL SELECT 'Nation', count(DISTINCT v), 'max' FROM (SELECT c_nationkey AS v FROM customer UNION ALL SELECT s_nationkey FROM supplier) HAVING count(DISTINCT v) > 20
  UNION ALL SELECT 'Supplier', count(DISTINCT s_suppkey), 'min' FROM supplier HAVING count(*) BETWEEN 1 AND 0
  UNION ALL SELECT 'Document', count(DISTINCT doc_id), 'min' FROM documents HAVING count(DISTINCT doc_id) BETWEEN 1 AND 4999)""",
    "n", element="e", extra=", bound"))
def c27(t: Tables):
    return flat(sets.check_object_cardinality(facts(t, "places", "line", "cust_nation", "supp_nation", "document")), "bound")


_check("c28_role_cardinality", "c28", ("finished",), _sql("c28", "unary-role-cardinality", "FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n > 10", "n", extra=", 'max' AS bound"), "bound")

# ---- role paths -----------------------------------------------------------------------------------

_path_tables = ("places", "line", "cust_nation", "supp_nation")
_check("c29_join_subset", "c29", _path_tables, _sql("c29", "join-subset", f"FROM (SELECT * FROM {BY_SUPPLIER} EXCEPT SELECT * FROM {BY_CUSTOMER})", "o || '|' || n"))


def _rollup_sql(cid: str, rule: str, body: str) -> str:
    detail = _sql(cid, rule, f"FROM {body}", "o || '|' || n", extra=", CAST(NULL AS VARCHAR) AS tuples")
    total = _sql(cid, rule, f"FROM (SELECT count(*) AS k FROM {body}) WHERE k > 0", "''", extra=", CAST(k AS VARCHAR) AS tuples")
    return f"{detail} UNION ALL {total}"


_check("c30_join_equality", "c30", _path_tables, _rollup_sql("c30", "join-equality",
    f"((SELECT * FROM {BY_CUSTOMER} EXCEPT SELECT * FROM {BY_SUPPLIER}) UNION ALL (SELECT * FROM {BY_SUPPLIER} EXCEPT SELECT * FROM {BY_CUSTOMER}))"), "tuples")
_check("c31_join_exclusion", "c31", _path_tables, _rollup_sql("c31", "join-exclusion", f"(SELECT * FROM {BY_SUPPLIER} INTERSECT SELECT * FROM {BY_CUSTOMER})"), "tuples")


@query("j06_role_path", f"SELECT o AS t0, n AS t1 FROM (SELECT CAST(o AS VARCHAR) AS o, CAST(n AS VARCHAR) AS n FROM {BY_SUPPLIER})")
def j06(t: Tables):
    return paths.path_tuples(facts(t, "line", "supp_nation"), ORDER_NATION_BY_SUPPLIER)


@query("u03_path_intersection", f"SELECT CAST(o AS VARCHAR) AS t0, CAST(n AS VARCHAR) AS t1 FROM (SELECT * FROM {BY_SUPPLIER} INTERSECT SELECT * FROM {BY_CUSTOMER})")
def u03(t: Tables):
    fs = facts(t, *_path_tables)
    return paths.path_tuples(fs, ORDER_NATION_BY_SUPPLIER).intersect(paths.path_tuples(fs, ORDER_NATION_BY_CUSTOMER))


# ---- engine ---------------------------------------------------------------------------------------

def shipping_late(fs):
    """A rule of the user's own: rows of a wide fact type without a supplier value above zero."""
    rows = fs.rows("line").filter("ln_supp = 0")
    return rows.select(*record("custom/supplier-zero", "info", F.col("inst_id"), pop=F.col("pop_id"), inst=F.col("inst_id"),
                               subject=[F.col("ln_supp")], message="supplier zero"))


def run_everything(t: Tables):
    """All declared constraints over all bound tables, object counts, incomplete rows, undeclared populations and a custom rule."""
    loose = t.events.select(F.col("event_type").alias("pop_id"), F.when(F.col("event_type") == "click", "clicks").otherwise("follow").alias("fact_type_id"))
    return engine.store_all(facts(t), CONSTRAINTS.values(), [shipping_late], populations=loose)


def _sql_of(name: str) -> str:
    from factloom.workloads.registry import ORACLES
    cols = "rule_id, severity, element_id, constraint_id, fact_type_id, pop_id, inst_id, subject"
    return f"SELECT {cols} FROM ({ORACLES[name]})"


_CUSTOM_SQL = flat_sql("custom/supplier-zero", "FROM lineitem WHERE l_suppkey = 0", "'0'", severity="'info'", element=LINE_ID, pop="'lines'", inst=LINE_ID)
_INCOMPLETE = [flat_sql("population/incomplete-instance", f"FROM {rows} WHERE b IS NULL", f"'{player}'", element="inst", fact_type=f"'{name}'", pop="pop", inst="inst")
               for name, rows, player in (("follow", FOLLOW, "User"), ("refers", REFERS, "Customer"))]
_DANGLING = flat_sql("population/dangling-fact-type", "FROM (SELECT DISTINCT event_type FROM events WHERE event_type = 'click')", "'clicks'", element="event_type", fact_type="'clicks'", pop="event_type")
# With every table bound, customers who are only referred to are known objects too.
_KNOWN = "(SELECT c_custkey AS v FROM customer UNION SELECT CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 7) % 1600 END FROM orders)"
_CUSTOMERS = _sql("c25c", "mandatory", f"FROM {_KNOWN} WHERE v NOT IN (SELECT o_custkey FROM orders)", "v")
# Objects without a predecessor are taken away, then those whose predecessors are all gone, until none goes: a population where
# an object is left has a cycle.
_CIRCLE = _sql("c23r", "ring", f"""FROM (WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT pop, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM {REFERS} WHERE b IS NOT NULL),
  n AS MATERIALIZED (SELECT pop, a AS node FROM e UNION SELECT pop, b FROM e),
  gone(pop, node) USING KEY (pop, node) AS (SELECT pop, node FROM n WHERE (pop, node) NOT IN (SELECT (pop, b) FROM e)
    UNION SELECT c.pop, c.node FROM (SELECT DISTINCT e.pop, e.b AS node FROM e JOIN gone g ON e.pop = g.pop AND e.a = g.node) c
      WHERE NOT EXISTS (SELECT 1 FROM e f ANTI JOIN recurring.gone h ON f.pop = h.pop AND f.a = h.node WHERE f.pop = c.pop AND f.b = c.node))
  SELECT DISTINCT pop FROM n ANTI JOIN gone USING (pop, node))""", "pop", element="pop", pop="pop")
RUN_SQL = " UNION ALL ".join([_sql_of(name) for c, name in STATED.items() if c not in ("c25c", "c23r")] + [
    _sql_of("c02_incomplete_instance"), _sql_of("c27_object_cardinality"), *_INCOMPLETE, _DANGLING, _CUSTOMERS, _CIRCLE, _CUSTOM_SQL])


@query("c32_custom_rule", _CUSTOM_SQL)
def c32(t: Tables):
    return flat(engine.check_all(facts(t, "line"), [], [shipping_late], incomplete_instances=False, object_types=False))


@query("c33_run_all", RUN_SQL)
def c33(t: Tables):
    return flat(report_order(run_everything(t)))


@query("c34_errors_only", f"SELECT * FROM ({RUN_SQL}) WHERE severity = 'error'")
def c34(t: Tables):
    return flat(engine.errors_only(run_everything(t)))


@query("c35_tally", f"SELECT rule_id, count(*) AS violations FROM ({RUN_SQL}) GROUP BY 1")
def c35(t: Tables):
    return engine.tally(run_everything(t))


_TWICE = "(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM lineitem)"


@query("c36_rejects_population", f"""SELECT 'population/uniqueness-violation' AS rule_id, 'forbidden' AS element_id, count(*) AS n FROM {_TWICE}
  UNION ALL SELECT 'population/value-constraint-violation', 'forbidden', 2 * count(*) FROM {_TWICE} WHERE NOT (l_discount BETWEEN 0 AND 0.05)""")
def c36(t: Tables):
    # every line stated twice: the second statement of each is a repeated key
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    twice = t.lineitem.select(*key, "l_discount").distinct().withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    forbidden = ("line", twice, {"ln_ord": F.concat_ws("-", *key), "ln_num": "l_linenumber", "ln_disc": "l_discount"},
                 "copy", F.concat_ws("-", *key, "copy"), F.lit("forbidden"))
    found = engine.rejects_population(facts(t, "places"), [CONSTRAINTS["c03"], CONSTRAINTS["c06"]], [forbidden])
    return found.filter("rule_id <> 'population/incomplete-instance'").groupBy("rule_id", "element_id").agg(F.count("*").alias("n"))


@query("c37_not_null", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS done FROM orders WHERE o_orderstatus <> 'F'")
def c37(t: Tables):
    df = t.orders.withColumn("done", F.expr("CASE WHEN o_orderstatus = 'F' THEN o_custkey END"))
    return keys.column_not_null(df, "done", ["o_orderkey"])


@query("c38_unique", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING n > 1")
def c38(t: Tables):
    return keys.column_unique(t.lineitem, "l_orderkey")


@query("c39_accepted_values", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def c39(t: Tables):
    return keys.column_accepted_values(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("c40_relationships", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c40(t: Tables):
    return keys.column_relationships(t.documents.select("doc_id", "lang"), "doc_id", t.labels, "doc_id")


# ---- joins and set aggregates ------------------------------------------------------------------------

@query("j02_reverse_pairs", f"SELECT DISTINCT pop, a, b FROM {EDGES} r WHERE {_has_reverse}")
def j02(t: Tables):
    e = rings.edge_rows(facts(t, "follow"), CONSTRAINTS["c18"]).select(F.col("pop_id").alias("pop"), "a", "b").distinct()
    return e.join(e.select("pop", F.col("b").alias("a"), F.col("a").alias("b")), ["pop", "a", "b"], "left_semi")


@query("a01_universe", f"SELECT DISTINCT CAST(v AS VARCHAR) AS value FROM {ORDER_UNIVERSE}")
def a01(t: Tables):
    return facts(t, "places", "line").universe("Order").distinct()


@query("a02_role_values", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS value FROM labels")
def a02(t: Tables):
    return facts(t, "label").role_values("lb_doc").distinct()


@query("a03_tuples", f"SELECT DISTINCT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM {STATE} WHERE a IS NOT NULL AND b IS NOT NULL")
def a03(t: Tables):
    return facts(t, "state").tuples(("st_done", "st_open"), ["a", "b"]).distinct()


@query("a04_frequencies", f"SELECT pop AS pop_id, a AS fo_a, count(*) AS n FROM {FOLLOW} GROUP BY ALL")
def a04(t: Tables):
    return facts(t, "follow").rows("follow").groupBy("pop_id", "fo_a").agg(F.count("*").alias("n"))


@query("a05_distinct_counts", """SELECT player_id, count(DISTINCT value) AS n FROM (
  SELECT 'Customer' AS player_id, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'Document', CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 0 UNION ALL SELECT 'Quality', CAST(quality AS VARCHAR) FROM labels WHERE toxic = 0) GROUP BY 1""")
def a05(t: Tables):
    cells = facts(t, "places", "label").long_form().filter("NOT sample").select("player_id", "value").distinct()
    return cells.groupBy("player_id").agg(F.count("*").alias("n"))


@query("a05_approximate_counts", """SELECT player_id, count(DISTINCT value) AS n, TRUE AS close, TRUE AS united_close FROM (
  SELECT 'Customer' AS player_id, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'Order', CAST(l_orderkey AS VARCHAR) FROM lineitem UNION ALL SELECT 'Supplier', CAST(l_suppkey AS VARCHAR) FROM lineitem UNION ALL SELECT 'Part', CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'LineNumber', CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL SELECT 'Discount', CAST(l_discount AS VARCHAR) FROM lineitem) GROUP BY 1""")
def a05_sketches(t: Tables):
    """Exact counts beside those of one sketch of both tables, and of the sketches of each table united: within 3 % (4.6 standard errors)."""
    cells = facts(t, "places", "line").long_form().select("fact_type_id", "player_id", "value")
    exact = sets.distinct_counts(cells, ["player_id"])
    whole = sets.distinct_counts(cells, ["player_id"], approximate=True).withColumnRenamed("n", "sketched")
    apart = [sets.value_sketches(cells.filter(F.col("fact_type_id") == ft), ["player_id"]) for ft in ("places", "line")]
    united = sets.united_counts(apart, ["player_id"]).withColumnRenamed("n", "united")
    near = lambda c: F.abs(F.col(c) - F.col("n")) <= 0.03 * F.col("n")
    return exact.join(whole, "player_id").join(united, "player_id").select("player_id", "n", near("sketched").alias("close"), near("united").alias("united_close"))


@query("u02_symmetric_difference", """SELECT v AS t0, side FROM ((SELECT CAST(o_orderkey AS VARCHAR) AS v, 'first' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
  UNION ALL (SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'second' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)))""")
def u02(t: Tables):
    fs = facts(t, "places", "line")
    flags = sets._flagged([fs.tuples(("pl_ord",), ["t0"]), fs.tuples(("ln_ord",), ["t0"])], ["t0"])
    return flags.filter("s0 <> s1").select("t0", F.when(F.col("s0"), "first").otherwise("second").alias("side"))


@query("w01_first_and_later", f"""SELECT {LINE_ID} AS inst_id, first_value({LINE_ID}) OVER w AS first_id FROM lineitem
  WINDOW w AS (PARTITION BY l_partkey, l_linenumber ORDER BY {LINE_ORDER}) QUALIFY row_number() OVER w > 1""")
def w01(t: Tables):
    rows = facts(t, "line").rows("line")
    return keys.later_duplicates(rows, [F.col("ln_part"), F.col("ln_num")]).select("inst_id", "first_id")
