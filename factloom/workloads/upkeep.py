"""Cleansing, forbidden-row generation and run statistics over the provided tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from factloom.operators import cleansing as K, engine, generate as X, runs as A
from factloom.plans.session import materialize
from factloom.sources.catalog import with_tables
from factloom.workloads.catalog import ARITY
from factloom.workloads.catalog_data import catalog, with_catalog
from factloom.workloads.registry import Tables, query
from factloom.workloads.retail import CONSTRAINTS, FACT_TYPES, OBJECT_TYPES
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint

# ---- cleansing ------------------------------------------------------------------------------------------

_CELLS = """SELECT CAST(floor(l_orderkey / 64.0) AS BIGINT) AS model_id, concat('pop', l_orderkey, '_', l_linenumber) AS pop_id, concat(l_partkey, '-', l_suppkey) AS inst_id, l_partkey AS ord, concat('f', l_orderkey, '_', l_linenumber, '_r0') AS role_id, concat('o', l_orderkey) AS value FROM lineitem WHERE l_discount < 0.08 AND l_tax IN (0.0, 0.04, 0.08)
  UNION ALL SELECT CAST(floor(l_orderkey / 64.0) AS BIGINT), concat('pop', l_orderkey, '_', l_linenumber), concat(l_partkey, '-', l_suppkey), l_partkey, concat('f', l_orderkey, '_', l_linenumber, '_r1'), CASE WHEN l_partkey % 3 = 0 THEN 'z' ELSE 'a' END FROM lineitem WHERE l_discount < 0.08 AND l_tax IN (0.0, 0.04, 0.08) AND l_quantity > 10
  UNION ALL SELECT CAST(floor(l_orderkey / 64.0) AS BIGINT), concat('pop', l_orderkey, '_', l_linenumber), concat(l_partkey, '-', l_suppkey), l_partkey, concat('f', l_orderkey, '_', l_linenumber, '_r2'), concat('s', l_suppkey) FROM lineitem WHERE l_discount < 0.08 AND l_tax IN (0.0, 0.04, 0.08) AND l_quantity > 40"""
_STORED: dict[tuple[str, str], object] = {}


def cells(t: Tables):
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORED:
        df = t.spark.sql(_CELLS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem)
        cat = catalog(t)
        known = cat.populations.select("model_id", "pop_id")
        _STORED[key] = cat.store(cat.dealt(df).join(known, ["model_id", "pop_id"], "left_semi"), "cells")
    return _STORED[key]


def doubled(t: Tables):
    """The catalog with some constraints stated twice."""
    cat = catalog(t)
    twice = F.when(F.length("constraint_id") % 2 == 0, F.array(F.col("ord"), F.col("ord") + 20)).otherwise(F.array("ord"))
    return with_tables(cat, lambda _: cat.constraints.withColumn("ord", F.explode(twice)), "constraints")


_K = (f"ce AS (SELECT * FROM ({_CELLS}) WHERE (model_id, pop_id) IN (SELECT (model_id, pop_id) FROM populations))",
      "em AS (SELECT * FROM populations WHERE (model_id, pop_id) NOT IN (SELECT (model_id, pop_id) FROM ce))",
      "orph AS (SELECT p.* FROM populations p WHERE (model_id, pop_id) IN (SELECT (model_id, pop_id) FROM ce) AND (model_id, fact_type_id) NOT IN (SELECT (model_id, fact_type_id) FROM fact_types))",
      "snd AS (SELECT p.* FROM populations p WHERE (model_id, pop_id) IN (SELECT (model_id, pop_id) FROM ce) AND (model_id, fact_type_id) IN (SELECT (model_id, fact_type_id) FROM fact_types))",
      """vl AS (SELECT * FROM snd WHERE (model_id, pop_id, fact_type_id) IN (SELECT (ce.model_id, ce.pop_id, r.fact_type_id) FROM ce JOIN roles r ON r.model_id = ce.model_id AND r.role_id = ce.role_id
        JOIN object_types o ON o.model_id = r.model_id AND o.object_type_id = r.player_id AND len(o.allowed) > 0 GROUP BY ce.model_id, ce.pop_id, r.fact_type_id, r.role_id, o.object_type_id, o.allowed HAVING bool_and(list_contains(o.allowed, ce.value))))""",
      ARITY,
      "ok AS (SELECT * FROM snd WHERE (model_id, pop_id) NOT IN (SELECT (model_id, pop_id) FROM vl))",
      "inc AS (SELECT ce.model_id, ce.pop_id, ce.inst_id, ok.fact_type_id FROM ce JOIN ok USING (model_id, pop_id) JOIN ar ON ar.model_id = ok.model_id AND ar.fact_type_id = ok.fact_type_id LEFT JOIN roles r ON r.model_id = ce.model_id AND r.fact_type_id = ok.fact_type_id AND r.role_id = ce.role_id GROUP BY ALL, arity HAVING count(DISTINCT r.role_id) < any_value(arity))".replace("GROUP BY ALL, arity", "GROUP BY ce.model_id, ce.pop_id, ce.inst_id, ok.fact_type_id"),
      """idf AS (SELECT a.model_id, a.fact_type_id, a.player_id AS entity_id, a.role_id AS entity_role, b.role_id AS value_role, f.seq = min(f.seq) OVER (PARTITION BY a.model_id, a.player_id) AS first FROM roles a JOIN ar ON ar.model_id = a.model_id AND ar.fact_type_id = a.fact_type_id AND arity = 2
        JOIN roles b ON b.model_id = a.model_id AND b.fact_type_id = a.fact_type_id AND b.pos <> a.pos JOIN object_types o ON o.model_id = a.model_id AND o.object_type_id = a.player_id AND o.kind = 'entity' AND o.reference_mode <> ''
        JOIN object_types v ON v.model_id = b.model_id AND v.object_type_id = b.player_id AND v.kind = 'value' JOIN fact_types f ON f.model_id = a.model_id AND f.fact_type_id = a.fact_type_id)""",
      "cl AS (SELECT ce.*, ok.fact_type_id FROM ce JOIN ok USING (model_id, pop_id) ANTI JOIN inc USING (model_id, pop_id, inst_id))",
      """ent AS (SELECT * FROM (SELECT DISTINCT cl.model_id, i.fact_type_id, i.entity_id, cl.value FROM cl JOIN roles r ON r.model_id = cl.model_id AND r.fact_type_id = cl.fact_type_id AND r.role_id = cl.role_id JOIN idf i ON i.model_id = r.model_id AND i.entity_id = r.player_id AND i.first)
        ANTI JOIN cl USING (model_id, fact_type_id, value))""",
      "cc AS (SELECT *, row_number() OVER () AS rid FROM (SELECT * FROM constraints UNION ALL SELECT * REPLACE (ord + 20 AS ord) FROM constraints WHERE length(constraint_id) % 2 = 0))",
      "cr AS (SELECT rid, model_id, fact_type_id, type, unnest(role_ids) AS role_id FROM cc)",
      "cu AS (SELECT DISTINCT rid FROM cr LEFT JOIN (SELECT DISTINCT model_id, role_id, TRUE AS known FROM roles) USING (model_id, role_id) WHERE known IS NULL)",
      "cp AS (SELECT rid, count(DISTINCT player_id) AS players FROM cr JOIN roles USING (model_id, fact_type_id, role_id) WHERE type = 'ring' GROUP BY 1)",
      """cj AS (SELECT c.*, CASE WHEN cu.rid IS NOT NULL THEN 'invalid_role_player'
        WHEN NOT CASE WHEN type = 'ring' THEN len(role_ids) = 2 WHEN type IN ('frequency', 'mandatory') THEN len(role_ids) = 1 WHEN type IN ('disjunctive_mandatory', 'exclusion', 'exclusive_or') THEN len(role_ids) >= 2 ELSE len(role_ids) >= 1 END THEN 'arity_mismatch'
        WHEN type = 'frequency' AND (min < 1 OR max < min) THEN 'invalid_bounds'
        WHEN type = 'ring' AND players = 2 THEN 'ring_different_players' END AS fault FROM cc c LEFT JOIN cu USING (rid) LEFT JOIN cp USING (rid))""",
      "cs AS (SELECT *, is_preferred AND (model_id, fact_type_id) NOT IN (SELECT (model_id, fact_type_id) FROM idf) AS misplaced, row_number() OVER (PARTITION BY model_id, fact_type_id, type, list_sort(role_ids) ORDER BY ord) AS rn FROM cj WHERE fault IS NULL)",
      """lg AS (SELECT model_id, 'empty_population' AS category, fact_type_id AS element FROM em UNION ALL SELECT model_id, 'orphaned_population', fact_type_id FROM orph UNION ALL SELECT model_id, 'duplicate_value_constraint_population', fact_type_id FROM vl
        UNION ALL SELECT model_id, 'incomplete_instance', fact_type_id FROM inc UNION ALL SELECT model_id, 'missing_identifier_population', fact_type_id FROM ent UNION ALL SELECT model_id, fault, fact_type_id FROM cj WHERE fault IS NOT NULL
        UNION ALL SELECT model_id, 'misplaced_is_preferred', fact_type_id FROM cs WHERE misplaced UNION ALL SELECT model_id, 'duplicate_constraint', fact_type_id FROM cs WHERE rn > 1
        UNION ALL SELECT model_id, 'orphaned_reference_mode', object_type_id FROM object_types WHERE kind = 'entity' AND reference_mode <> '' AND (model_id, object_type_id) NOT IN (SELECT (model_id, entity_id) FROM idf))""")


_K = tuple(part.replace(" AS (", " AS MATERIALIZED (", 1) for part in _K)


def _needed(select: str) -> list[str]:
    """The named parts that a SELECT reads, directly or through others, in their order."""
    kept: list[str] = []
    text = select
    for part in reversed(_K):
        name = part.split(" AS ", 1)[0]
        if re.search(rf"\b{name}\b", text):
            kept.insert(0, part)
            text += part
    return kept


def _clean(name: str, select: str):
    return query(name, with_catalog(select, *_needed(select)))


@_clean("k01_empty_populations", "SELECT model_id, pop_id, fact_type_id FROM em")
def k01(t: Tables):
    return K.empty_populations(catalog(t), cells(t)).select("model_id", "pop_id", "fact_type_id")


@_clean("k02_orphaned_populations", "SELECT model_id, pop_id, fact_type_id FROM orph")
def k02(t: Tables):
    return K.orphaned_populations(catalog(t), cells(t)).select("model_id", "pop_id", "fact_type_id")


@_clean("k03_value_list_populations", "SELECT model_id, pop_id, fact_type_id FROM vl")
def k03(t: Tables):
    return K.value_list_populations(catalog(t), cells(t)).select("model_id", "pop_id", "fact_type_id")


@_clean("k04_incomplete_instances", "SELECT * FROM inc")
def k04(t: Tables):
    return K.incomplete_instances(catalog(t), cells(t))


@_clean("k05_entailed_identifiers", "SELECT * FROM ent")
def k05(t: Tables):
    return K.entailed_identifiers(catalog(t), K.clean_cells(catalog(t), cells(t)))


@_clean("k05_repaired_cells", """SELECT model_id, pop_id, inst_id, fact_type_id, role_id, value FROM cl UNION ALL SELECT e.model_id, coalesce(p.pop_id, 'identifiers-' || e.fact_type_id), concat('entailed|', e.entity_id, '|', e.value), e.fact_type_id, unnest([i.entity_role, i.value_role]), e.value
  FROM ent e JOIN idf i ON i.model_id = e.model_id AND i.fact_type_id = e.fact_type_id AND i.entity_id = e.entity_id AND i.first LEFT JOIN (SELECT model_id, fact_type_id, min(pop_id) AS pop_id FROM cl GROUP BY ALL) p ON p.model_id = e.model_id AND p.fact_type_id = e.fact_type_id""")
def k05_repaired(t: Tables):
    return K.repaired_cells(catalog(t), K.clean_cells(catalog(t), cells(t))).drop("ord")


@_clean("k06_clean_constraints", "SELECT model_id, fact_type_id, ord, type, CASE WHEN misplaced THEN FALSE ELSE is_preferred END AS is_preferred FROM cs WHERE rn = 1")
def k06(t: Tables):
    return K.clean_constraints(doubled(t)).kept.select("model_id", "fact_type_id", "ord", "type", "is_preferred")


@_clean("k07_orphaned_reference_modes", """SELECT model_id, object_type_id AS entity_id FROM object_types WHERE kind = 'entity' AND reference_mode <> ''
  AND NOT EXISTS (SELECT 1 FROM idf WHERE idf.model_id = object_types.model_id AND idf.entity_id = object_types.object_type_id)""")
def k07(t: Tables):
    return K.orphaned_reference_modes(catalog(t))


@_clean("k08_correction_log", "SELECT * FROM lg")
def k08(t: Tables):
    return K.correction_log(doubled(t), cells(t))


# ---- forbidden rows ----------------------------------------------------------------------------------------

def _breaks(name: str, c: Constraint, rows: str):
    """Generate for every order and count the violations per order, which ``rows`` states in SQL."""
    @query(name, f"SELECT CAST(o_orderkey AS VARCHAR) AS seed, CAST({rows} AS BIGINT) AS violations FROM orders")
    def build(t: Tables):
        seeds = t.orders.select(F.col("o_orderkey").alias("seed"))
        found = engine.check(X.bind_forbidden(FactSet(FACT_TYPES, OBJECT_TYPES), c, seeds), c)
        # the seed is the part after the mark in a minted value or a population's name
        text = F.concat_ws(" ", "pop_id", F.array_join("subject", " "))
        return found.groupBy(F.regexp_extract(text, r"(?:forbidden-|@)(\d+)", 1).alias("seed")).agg(F.count("*").alias("violations"))


_breaks("x01_uniqueness", CONSTRAINTS["c03"], "1")
_breaks("x02_value_constraint", Constraint("x02", "value_constraint", "document", ("dc_lang",), values=("en", "de")), "1")
_breaks("x03_frequency_max", Constraint("x03", "frequency", "line", ("ln_ord",), max=3), "1")
_breaks("x03_frequency_min", Constraint("x03", "frequency", "line", ("ln_ord",), min=3), "1")
for _ring, _n in (("irreflexive", 1), ("asymmetric", 2), ("antisymmetric", 2), ("symmetric", 1), ("purely_reflexive", 1), ("transitive", 1), ("intransitive", 1), ("acyclic", 1)):
    _breaks(f"x04_ring_{_ring}", Constraint("x04", "ring", "follow", ("fo_a", "fo_b"), ring=_ring), str(_n))
_breaks("x05_mandatory", CONSTRAINTS["c25"], "1")
_breaks("x05_disjunctive_mandatory", CONSTRAINTS["c26"], "1")
_breaks("x06_exclusion", Constraint("x06", "exclusion", "finished", ("fin_ord", "urg_ord")), "1")
_breaks("x06_exclusive_or", CONSTRAINTS["c12"], "1")
_breaks("x07_subset", CONSTRAINTS["c14"], "1")
_breaks("x07_equality", CONSTRAINTS["c16"], "1")
_breaks("x08_external_uniqueness", CONSTRAINTS["c04"], "1")


@query("x09_minted_values", "SELECT o_orderkey AS seed, concat('Customer#3@', o_orderkey) AS valid, CASE WHEN o_orderkey >= 0 THEN 'b' END AS listed, concat('Grade#invalid-1@', o_orderkey) AS invalid FROM orders")
def x09(t: Tables):
    seed = F.col("o_orderkey")
    return t.orders.select(seed.alias("seed"), X.mint("Customer", 2, seed).alias("valid"), X.mint("Grade", 3, seed, ("a", "b")).alias("listed"), X.mint_invalid("Grade", ("Grade#invalid",), seed).alias("invalid"))


# ---- run statistics -----------------------------------------------------------------------------------------

_RUNS = """SELECT user_id AS suite_id, event_type AS case_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS case_index, event_id AS sample,
  CASE WHEN event_id % 17 <> 0 THEN CASE WHEN value > 500 THEN 1.0E0 ELSE value / 517.3E0 END END AS score, event_id % 17 = 0 AS failed, event_id % 23 = 0 AS truncated, CASE WHEN event_id % 19 = 0 THEN 'timeout' END AS error,
  CASE WHEN user_id % 3 <> 0 THEN event_id % 1000 END AS prompt_tokens, CASE WHEN user_id % 3 = 1 THEN event_id % 300 END AS completion_tokens, CASE WHEN user_id % 4 = 1 AND event_id % 2 = 0 THEN event_id % 50 END AS cache_read, CAST(NULL AS BIGINT) AS cache_write,
  event_id % 3 AS corrections, event_id % 2 AS errors, event_id % 5 AS warnings FROM events"""


def runs(t: Tables):
    return t.spark.sql(_RUNS.replace("FROM events", "FROM {events}"), events=t.events)


_RN = f"rn AS ({_RUNS})"
_CASES = """cs AS (SELECT suite_id, case_id, case_index, coalesce(avg(score), 0) AS mean, coalesce(min(score), 0) AS worst, count(score) AS samples, CAST(count_if(failed) AS BIGINT) AS failures, CAST(count_if(truncated) AS BIGINT) AS truncations, stddev_samp(score) AS sd,
  CAST(count_if(score < 0.1) AS BIGINT) AS collapses, avg(score) FILTER (score >= 0.1) AS quality_mean, stddev_samp(score) FILTER (score >= 0.1) AS quality_sd FROM rn GROUP BY ALL)"""


def _rounded(df, *columns: str):
    """Sums of floats depend on the order of rows in their last digits; both sides round."""
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query("a07_merged_tallies", """SELECT suite_id, rule_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id AS suite_id, event_type AS rule_id, CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM events UNION ALL SELECT user_id, 'all', 1 FROM events) GROUP BY ALL""")
def a07(t: Tables):
    tallied = t.events.select(F.col("user_id").alias("suite_id"), F.create_map(F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint"), F.lit("all"), F.lit(1).cast("bigint")).alias("tallies"))
    return A.merged_tallies(tallied, "tallies", ["suite_id"])


@query("a08_case_summary", f"WITH {_RN}, {_CASES} SELECT suite_id, case_id, {_r('mean', 'worst', 'sd')}, samples, failures, truncations FROM cs")
def a08(t: Tables):
    return _rounded(A.case_summary(runs(t)).drop("case_index"), "mean", "worst", "sd")


@query("a09_suite_summary", f"WITH {_RN}, {_CASES} SELECT suite_id, round(coalesce(avg(mean) FILTER (samples > 0), 0), 6) AS mean, round(coalesce(min(worst) FILTER (samples > 0), 0), 6) AS worst, CAST(sum(failures) AS BIGINT) AS failures, CAST(sum(truncations) AS BIGINT) AS truncations, sum(failures) = 0 AS complete FROM cs GROUP BY 1")
def a09(t: Tables):
    return _rounded(A.suite_summary(A.case_summary(runs(t))), "mean", "worst")


_DISPERSION = f"""SELECT suite_id, round(se, 6) AS standard_error, coalesce(lb, FALSE) AS lower_bound, round(1.96 * se * sqrt(2), 6) AS resolvable_difference, CASE WHEN total > 0 THEN top END AS dominant_case, round(CASE WHEN total > 0 THEN v / total END, 6) AS dominant_share FROM (
  SELECT suite_id, total, lb, top, v, CASE WHEN total > 0 THEN sqrt(total) / k WHEN NOT un THEN 0 END AS se FROM (SELECT suite_id, count(*) AS k, sum(var) AS total, bool_or(sd IS NULL) AS lb, bool_and(sd IS NULL) AS un, max_by(case_id, (var, -case_index)) AS top, max(var) AS v FROM (SELECT *, coalesce(sd * sd / samples, 0) AS var FROM cs WHERE samples > 0) GROUP BY 1))"""


@query("a10_dispersion", f"WITH {_RN}, {_CASES} {_DISPERSION}")
def a10(t: Tables):
    return _rounded(A.dispersion(A.case_summary(runs(t))), "standard_error", "resolvable_difference", "dominant_share")


@query("a11_floor_split", f"WITH {_RN}, {_CASES} SELECT suite_id, case_id, collapses, {_r('quality_mean', 'quality_sd')} FROM cs")
def a11(t: Tables):
    return _rounded(A.case_summary(runs(t), 0.1).select("suite_id", "case_id", "collapses", "quality_mean", "quality_sd"), "quality_mean", "quality_sd")


@query("a12_margin_of_error", f"WITH {_RN}, {_CASES}, dp AS ({_DISPERSION.replace('round(se, 6)', 'se')}) SELECT suite_id, round(1.96 * standard_error, 6) AS margin FROM dp")
def a12(t: Tables):
    found = A.dispersion(A.case_summary(runs(t)))
    return found.select("suite_id", F.round(A.margin_of_error(F.col("standard_error")), 6).alias("margin"))


@query("a13_token_totals", f"""WITH {_RN} SELECT suite_id, CAST(CASE WHEN p <> 0 OR c <> 0 THEN p END AS BIGINT) AS prompt, CAST(CASE WHEN p <> 0 OR c <> 0 THEN c END AS BIGINT) AS completion, CAST(CASE WHEN seen THEN r END AS BIGINT) AS cache_read, CAST(CASE WHEN seen THEN w END AS BIGINT) AS cache_write FROM (
  SELECT suite_id, sum(coalesce(prompt_tokens, 0)) AS p, sum(coalesce(completion_tokens, 0)) AS c, bool_or(cache_read IS NOT NULL OR cache_write IS NOT NULL) AS seen, sum(coalesce(cache_read, 0)) AS r, sum(coalesce(cache_write, 0)) AS w FROM rn GROUP BY 1)""")
def a13(t: Tables):
    return A.token_totals(runs(t))


@query("a14_mean_penalties", f"WITH {_RN} SELECT suite_id, case_id, round(avg(corrections), 6) AS corrections, round(avg(errors), 6) AS errors, round(avg(warnings), 6) AS warnings FROM rn WHERE score IS NOT NULL GROUP BY ALL")
def a14(t: Tables):
    return _rounded(A.mean_penalties(runs(t)), "corrections", "errors", "warnings")


@query("a15_sample_score", "SELECT event_id, round(greatest(0, (event_id % 7) / 7 - 0.05 * (event_id % 3) - 0.1 * (event_id % 2) - 0.02 * (event_id % 5)), 6) AS score FROM events")
def a15(t: Tables):
    e = F.col("event_id")
    return t.events.select("event_id", F.round(A.sample_score(e % 7, F.lit(7), {0.05: e % 3, 0.1: e % 2, 0.02: e % 5}), 6).alias("score"))


@query("a16_ambiguity_excess", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE greatest(0, event_id % 9 - user_id % 5) END AS excess FROM events")
def a16(t: Tables):
    return t.events.select("event_id", A.ambiguity_excess(F.col("event_id") % 9, F.expr("CASE WHEN user_id % 3 <> 0 THEN user_id % 5 END")).alias("excess"))


_MESSAGES = ("Rate limit reached", "invalid API key", "socket ETIMEDOUT", "quota exceeded for permission", "unlimited", "request timed out")
_CALLS = """SELECT event_type AS provider, concat('m', user_id % 5) AS model, CASE WHEN user_id % 2 = 0 THEN concat('m', user_id % 3) END AS model_used, event_id % 4 <> 0 AS ok, event_id % 800 AS latency_ms, CASE WHEN event_id % 3 <> 0 THEN event_id % 100 END AS prompt_tokens, event_id % 70 AS completion_tokens, event_id FROM events"""


@query("a17_call_summary", f"""SELECT provider, coalesce(model_used, model) AS model, CASE WHEN NOT ok THEN ['rate_limit', 'auth', 'network', 'rate_limit', 'other', 'network'][event_id % 6 + 1] END AS error_kind, count(*) AS calls, CAST(count_if(ok) AS BIGINT) AS succeeded, round(avg(latency_ms), 6) AS mean_latency_ms,
  CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM ({_CALLS}) GROUP BY ALL""")
def a17(t: Tables):
    calls = t.spark.sql(_CALLS.replace("FROM events", "FROM {events}"), events=t.events)
    message = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6).cast("int"))
    return _rounded(A.call_summary(calls.withColumn("error", F.when(~F.col("ok"), message))), "mean_latency_ms")


@query("f11_error_class", "SELECT event_id, ['rate_limit', 'auth', 'network', 'rate_limit', 'other', 'network'][event_id % 6 + 1] AS error_kind FROM events")
def f11(t: Tables):
    message = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6).cast("int"))
    return t.events.select("event_id", A.error_class(F.concat(message, F.lit(" "), F.col("event_type"))).alias("error_kind"))


@_clean("a18_correction_summary", """SELECT b.model_id AS run_id, b.object_types, l.category, l.n, coalesce(x.n, 0) AS corrections FROM (SELECT model_id, count(*) AS object_types FROM object_types GROUP BY 1) b
  LEFT JOIN (SELECT model_id, category, count(*) AS n FROM lg GROUP BY ALL) l USING (model_id) LEFT JOIN (SELECT model_id, count(*) AS n FROM lg GROUP BY ALL) x USING (model_id)""")
def a18(t: Tables):
    log = K.correction_log(doubled(t), cells(t)).select(F.col("model_id").alias("run_id"), "category")
    builds = catalog(t).object_types.groupBy(F.col("model_id").alias("run_id")).agg(F.count("*").alias("object_types"))
    return A.correction_summary(materialize(log, "corrections"), builds)


@query("a20_recordable", f"WITH {_RN}, {_CASES} SELECT suite_id, sum(failures) = 0 AS complete FROM cs GROUP BY 1 HAVING sum(failures) = 0")
def a20(t: Tables):
    return A.recordable(A.suite_summary(A.case_summary(runs(t)))).select("suite_id", "complete")


@query("w06_kept_payloads", f"""WITH {_RN} SELECT DISTINCT suite_id, case_id, sample FROM (SELECT suite_id, case_id, min_by(sample, (score, sample)) AS sample FROM rn WHERE score IS NOT NULL AND error IS NULL GROUP BY ALL
  UNION ALL SELECT suite_id, case_id, max_by(sample, (score, -sample)) FROM rn WHERE score IS NOT NULL AND error IS NULL GROUP BY ALL UNION ALL SELECT suite_id, case_id, sample FROM rn WHERE score IS NOT NULL AND error IS NOT NULL)""")
def w06(t: Tables):
    return A.kept_payloads(runs(t))


@query("t06_dominant_case", f"WITH {_RN}, {_CASES} SELECT suite_id, dominant_case FROM ({_DISPERSION}) WHERE dominant_case IS NOT NULL")
def t06(t: Tables):
    return A.dispersion(A.case_summary(runs(t))).filter("dominant_case IS NOT NULL").select("suite_id", "dominant_case")


@query("w03_first_rows", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 5")
def w03(t: Tables):
    from factloom.operators.sequences import first_rows
    return first_rows(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("w02_last_value", "SELECT l_orderkey, max_by(l_partkey, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY 1")
def w02(t: Tables):
    from factloom.operators.sequences import extreme_rows
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return extreme_rows(rows, ["l_orderkey"], F.col("at")).select("l_orderkey", "l_partkey")
