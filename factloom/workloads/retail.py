"""The provided tables bound to fact types, and the constraints declared on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.sequences import next_value
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint, FactType, JoinOperand, ObjectType, Role, ValueRange
from factloom.workloads.registry import Tables

OBJECT_TYPES = [
    ObjectType("Customer", "Customer"), ObjectType("Order", "Order", max=10), ObjectType("Nation", "Nation", max=20),
    ObjectType("Supplier", "Supplier", min=1), ObjectType("Document", "Document", min=5000), ObjectType("User", "User"),
    ObjectType("Done", "Done", kind="value"), ObjectType("Open", "Open", kind="value"),
]


def fact_type(id: str, name: str, **roles: str) -> FactType:
    return FactType(id, name, tuple(Role(r, p) for r, p in roles.items()))


FACT_TYPES = [
    fact_type("places", "Customer places Order", pl_cust="Customer", pl_ord="Order"),
    fact_type("line", "Order has Line", ln_ord="Order", ln_num="LineNumber", ln_part="Part", ln_supp="Supplier", ln_disc="Discount"),
    fact_type("dates", "Line is shipped after Order", da_ship="ShipDate", da_order="OrderDate"),
    fact_type("cust_nation", "Customer is in Nation", cn_cust="Customer", cn_nation="Nation"),
    fact_type("cust_segment", "Customer is in Segment", cs_cust="Customer", cs_seg="Segment"),
    fact_type("supp_nation", "Supplier is in Nation", sn_supp="Supplier", sn_nation="Nation"),
    fact_type("document", "Document is in Language", dc_doc="Document", dc_lang="Language"),
    fact_type("label", "Document has Quality", lb_doc="Document", lb_quality="Quality"),
    fact_type("follow", "User is followed by User", fo_a="User", fo_b="User"),
    fact_type("state", "Order is done or open", st_done="Done", st_open="Open"),
    fact_type("refers", "Customer refers Customer", rf_a="Customer", rf_b="Customer"),
    fact_type("finished", "Order is finished", fin_ord="Order"),
    fact_type("urgent", "Order is urgent", urg_ord="Order"),
    fact_type("turn", "Conversation has Turn", tn_conv="Conversation", tn_turn="Turn"),
    fact_type("page", "Page has Url", pg_page="Page", pg_url="Url"),
]


def follow_rows(t: Tables) -> DataFrame:
    """Each event's user and the user of the next event of the same type."""
    return next_value(t.events.select("event_id", "ts", "user_id", "event_type"), ["event_type"], ["ts", "event_id"], None, "user_id", "next_user")


BINDINGS = {
    "places": lambda fs, t: fs.bind("places", t.orders, {"pl_cust": "o_custkey", "pl_ord": "o_orderkey"},
                                    ord="o_orderkey", inst_id="o_orderkey", pop_id=F.lit("places")),
    "line": lambda fs, t: fs.bind("line", t.lineitem, {
        "ln_ord": "l_orderkey", "ln_num": "l_linenumber", "ln_part": "l_partkey", "ln_supp": "l_suppkey", "ln_disc": "l_discount"},
        ord=F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        inst_id=F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), pop_id=F.lit("lines")),
    "dates": lambda fs, t: fs.bind("dates", t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")), {
        "da_ship": "l_shipdate", "da_order": "o_orderdate"}, ord="l_shipdate",
        inst_id=F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), pop_id=F.lit("dates"), computed=True),
    "cust_nation": lambda fs, t: fs.bind("cust_nation", t.customer, {"cn_cust": "c_custkey", "cn_nation": "c_nationkey"},
                                         ord="c_custkey", inst_id="c_custkey", pop_id=F.lit("cust_nation")),
    "cust_segment": lambda fs, t: fs.bind("cust_segment", t.customer, {"cs_cust": "c_custkey", "cs_seg": "c_mktsegment"},
                                          ord="c_custkey", inst_id="c_custkey", pop_id=F.lit("cust_segment")),
    "supp_nation": lambda fs, t: fs.bind("supp_nation", t.supplier, {"sn_supp": "s_suppkey", "sn_nation": "s_nationkey"},
                                         ord="s_suppkey", inst_id="s_suppkey", pop_id=F.lit("supp_nation")),
    "document": lambda fs, t: fs.bind("document", t.documents, {"dc_doc": "doc_id", "dc_lang": "lang"},
                                      ord="doc_id", inst_id="doc_id", pop_id=F.col("source")),
    # toxic rows are illustrative samples: they count as playing the role, not as known objects
    "label": lambda fs, t: fs.bind("label", t.labels.filter("toxic = 0"), {"lb_doc": "doc_id", "lb_quality": "quality"},
                                   ord="doc_id", inst_id="doc_id", pop_id=F.lit("labels"))
                             .bind("label", t.labels.filter("toxic = 1"), {"lb_doc": "doc_id", "lb_quality": "quality"},
                                   ord="doc_id", inst_id="doc_id", pop_id=F.lit("labels-sample"), sample=True),
    "follow": lambda fs, t: fs.bind("follow", follow_rows(t), {"fo_a": "user_id", "fo_b": "next_user"},
                                    ord=F.struct("ts", "event_id"), inst_id="event_id", pop_id=F.col("event_type"), computed=True),
    "state": lambda fs, t: fs.bind("state", t.orders, {
        "st_done": F.expr("CASE WHEN o_orderstatus = 'F' THEN o_custkey END"),
        "st_open": F.expr("CASE WHEN o_orderstatus = 'O' OR o_orderpriority = '1-URGENT' THEN o_custkey END")},
        ord="o_orderkey", inst_id="o_orderkey", pop_id=F.col("o_orderpriority")),
    "refers": lambda fs, t: fs.bind("refers", t.orders, {
        "rf_a": "o_custkey", "rf_b": F.expr("CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 7) % 1600 END")},
        ord="o_orderkey", inst_id="o_orderkey", pop_id=F.col("o_orderpriority")),
    "finished": lambda fs, t: fs.bind("finished", t.orders.filter("o_orderstatus = 'F'"), {"fin_ord": "o_orderkey"},
                                      ord="o_orderkey", inst_id="o_orderkey", pop_id=F.lit("finished")),
    "urgent": lambda fs, t: fs.bind("urgent", t.orders.filter("o_orderpriority = '1-URGENT'"), {"urg_ord": "o_orderkey"},
                                    ord="o_orderkey", inst_id="o_orderkey", pop_id=F.lit("urgent")),
    "turn": lambda fs, t: fs.bind("turn", t.conversations, {"tn_conv": "conv_id", "tn_turn": "turn"},
                                  ord=F.struct("conv_id", "turn"), inst_id=F.concat_ws("-", "conv_id", "turn"), pop_id=F.lit("turns")),
    "page": lambda fs, t: fs.bind("page", t.pages, {"pg_page": "page_id", "pg_url": "url"},
                                  ord="page_id", inst_id="page_id", pop_id=F.lit("pages")),
}


def facts(t: Tables, *names: str) -> FactSet:
    fs = FactSet(FACT_TYPES, OBJECT_TYPES)
    for name in names or BINDINGS:
        fs = BINDINGS[name](fs, t)
    return fs


ORDER_NATION_BY_CUSTOMER = JoinOperand("Order", (("pl_ord", "pl_cust"), ("cn_cust", "cn_nation")), (0, 2))
ORDER_NATION_BY_SUPPLIER = JoinOperand("Order", (("ln_ord", "ln_supp"), ("sn_supp", "sn_nation")), (0, 2))

_DECLARED = [
    Constraint("c03", "internal_uniqueness", "line", ("ln_ord", "ln_num")),
    Constraint("c03t", "internal_uniqueness", "turn", ("tn_conv", "tn_turn")),
    Constraint("c03p", "internal_uniqueness", "page", ("pg_url",)),
    Constraint("c03r", "internal_uniqueness", "refers", ("rf_b",)),
    Constraint("c04", "external_uniqueness", "cust_nation", ("cn_nation", "cs_seg")),
    Constraint("c06", "value_constraint", "line", ("ln_disc",), ranges=(ValueRange("0", "0.05"),)),
    Constraint("c06d", "value_constraint", "document", ("dc_lang",), modality="deontic", values=("en", "de"), ranges=(ValueRange("f", "g"),)),
    Constraint("c07", "value_comparison", "dates", ("da_ship", "da_order"), operator=">="),
    Constraint("c08", "frequency", "line", ("ln_ord",), min=2, max=7),
    Constraint("c09", "exclusion", "follow", ("fo_a", "fo_b")),
    Constraint("c10", "exclusion", "cust_nation", ("cn_nation", "sn_nation"), modality="deontic"),
    Constraint("c11", "exclusive_or", "state", ("st_done", "st_open")),
    Constraint("c12", "exclusive_or", "finished", ("fin_ord", "urg_ord")),
    Constraint("c13", "subset", "refers", ("rf_b",), ("rf_a",)),
    Constraint("c14", "subset", "places", ("pl_ord",), ("ln_ord",)),
    Constraint("c15", "equality", "refers", ("rf_a",), ("rf_b",)),
    Constraint("c16", "equality", "cust_nation", ("cn_cust",), ("pl_cust",)),
    *[Constraint(f"c{17 + i}", "ring", "follow", ("fo_a", "fo_b"), ring=ring) for i, ring in enumerate(
        ("irreflexive", "asymmetric", "antisymmetric", "symmetric", "intransitive", "transitive", "acyclic", "purely_reflexive"))],
    Constraint("c23r", "ring", "refers", ("rf_a", "rf_b"), ring="acyclic"),
    Constraint("c25", "mandatory", "line", ("ln_ord",)),
    Constraint("c25d", "mandatory", "label", ("lb_doc",), modality="deontic"),
    Constraint("c25c", "mandatory", "places", ("pl_cust",)),
    Constraint("c26", "disjunctive_mandatory", "finished", ("fin_ord", "urg_ord")),
    Constraint("c28", "cardinality", "finished", ("fin_ord",), min=1, max=10),
    Constraint("c29", "join_subset", "places", operands=(ORDER_NATION_BY_SUPPLIER, ORDER_NATION_BY_CUSTOMER)),
    Constraint("c30", "join_equality", "places", operands=(ORDER_NATION_BY_CUSTOMER, ORDER_NATION_BY_SUPPLIER)),
    Constraint("c31", "join_exclusion", "places", operands=(ORDER_NATION_BY_CUSTOMER, ORDER_NATION_BY_SUPPLIER)),
]
CONSTRAINTS = {c.id: c for c in _DECLARED}
