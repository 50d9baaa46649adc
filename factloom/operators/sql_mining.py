"""Constraint evidence mined from SQL text: each extractor is a projection of regular expressions.

Input is a corpus (file_path, sql) of any size; whole texts are processed.
Patterns are rows (file_path, start_line, end_line, kind, source_text, tables,
columns, details); columns given in ``keys`` are carried along.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.naming import to_pascal

# What \s stands for in a pattern.
BLANKS = " \t\n\x0b\f\r"
# One statement of SQL text - quoted spans, comments and anything but a delimiter, each taken for good.
STATEMENT = r"""(?s)(?:'[^']*(?:'|\z)|"[^"]*(?:"|\z)|--[^\n]*|/(?=\*).*?(?:\*/|\z)|[^;'"/-]+|[^;])++"""
# The patterns that define each kind of evidence.
JOIN = (r"(?is)(?:LEFT\s+|RIGHT\s+|INNER\s+|OUTER\s+|CROSS\s+|FULL\s+(?:OUTER\s+)?)?JOIN\s+(\w+(?:\.\w+)*)\s+(?:(?:AS\s+)?(\w+)\s+)?ON\s+(.*?)"
        r"(?=(?:\s+(?:LEFT|RIGHT|INNER|OUTER|CROSS|FULL)\s+|\s+JOIN\s+|\s+WHERE\s+|\s+GROUP\s+|\s+ORDER\s+|\s+HAVING\s+|\s+LIMIT\s+|\s+UNION\s+|\)|;|\z))")
WHERE = r"(?is)\bWHERE\s+(.*?)(?=\s+GROUP\s+BY|\s+ORDER\s+BY|\s+HAVING\s+|\s+LIMIT\s+|\s+UNION\s+|;|\z)"
IN_LIST = r"(?i)(\w+(?:\.\w+)?)\s+IN\s*\((.*?)\)"
IS_NOT_NULL = r"(?i)(\w+(?:\.\w+)?)\s+IS\s+NOT\s+NULL"
NOT_IS_NULL = r"(?i)NOT\s+(\w+(?:\.\w+)?)\s+IS\s+NULL"
COMPARISON = r"(?i)(\w+(?:\.\w+)?)\s*(=|<>|!=|>=?|<=?)\s*('[^']*'|\d+(?:\.\d+)?)"
BETWEEN = r"(?i)(\w+(?:\.\w+)?)\s+BETWEEN\s+('?[\w.-]+'?)\s+AND\s+('?[\w.-]+'?)"
CASE = r"(?is)CASE\s+(.*?)\s+END"
WHEN_VALUE = r"(?i)WHEN\s+(?:'([^']*)'|(\w+))"
CHECK = r"(?is)CHECK\s*\((.*?)\)"
CHECK_KEYWORDS = ("IN", "AND", "OR", "NOT", "NULL", "IS", "BETWEEN", "LIKE", "TRUE", "FALSE", "CHECK")
UNIQUE = r"(?i)UNIQUE\s*\(([^)]+)\)"
CREATE_BODY = r"(?is)CREATE\s+TABLE\s+\w+(?:\.\w+)*\s*\((.*)\)"
INLINE_UNIQUE = r"(?i)^\s*(\w+)\s+\w+(?:\([^)]*\))?[^,]*\bUNIQUE\b"
INLINE_NOT_NULL = r"(?i)^\s*(\w+)\s+\w+(?:\([^)]*\))?.*\bNOT\s+NULL\b"
ALTER_NOT_NULL = r"(?i)ALTER\s+TABLE\s+\w+\s+ALTER\s+(?:COLUMN\s+)?(\w+)\s+SET\s+NOT\s+NULL"
FOREIGN_KEY = r"(?i)FOREIGN\s+KEY\s*\(([^)]+)\)\s*REFERENCES\s+(\w+(?:\.\w+)?)\s*\(([^)]+)\)"
DEFAULT = r"(?i)(?:^|,|\()\s*(\w+)\s+\w+(?:\([^)]*\))?[^,)]*\bDEFAULT\s+('?[^,\n)']+'?)"
GROUP_BY = r"(?is)GROUP\s+BY\s+(.*?)(?=HAVING|ORDER\s+BY|LIMIT|UNION|\)|;|\z)"
# The word without which a statement holds no evidence of a kind.
NEEDED = {
    "join": "JOIN", "where": "WHERE", "case": "CASE", "check": "CHECK", "unique": "UNIQUE", "not_null": "NOT", "foreign_key": "FOREIGN",
    "default": "DEFAULT", "group_by": "GROUP",
}
PATTERNS = "array<struct<kind:string,source_text:string,tables:array<string>,columns:array<string>,details:map<string,string>>>"


def split_statements(corpus: DataFrame, *keys: str) -> DataFrame:
    """Statements with their number and first and last line (file_path, statement, start_line, end_line, sql).

    Semicolons inside quotes and comments do not split. A statement is matched in
    one go without backtracking, whatever its length. There is no shuffle, since
    lines are counted within the file's row, in time that grows with its lines
    however many statements it has.
    """
    pieces = F.filter(F.transform(F.regexp_extract_all("sql", F.lit(STATEMENT), 0), _trimmed), lambda s: s != "")
    cut = corpus.select(*keys, "file_path", pieces.alias("pieces"))
    # a mark for every line, true for the first of a statement: its place is the number of the line
    firsts = F.flatten(F.transform("pieces", lambda s: F.transform(F.split(s, "\n"), lambda _, i: i == 0)))
    starts = F.filter(F.transform(firsts, lambda first, i: F.when(first, i + 1)), lambda i: i.isNotNull())
    rows = cut.select(*keys, "file_path", F.posexplode(F.arrays_zip(F.col("pieces").alias("sql"), starts.alias("start_line"))).alias("statement", "s"))
    end_line = F.col("s.start_line") + F.size(F.split("s.sql", "\n")) - 1
    return rows.select(*keys, "file_path", "statement", "s.sql", "s.start_line", end_line.alias("end_line"))


def _matches(text: Column, pattern: str, groups: int) -> Column:
    """All matches as structs (g0, g1, ...): the whole match and its groups.

    The text is searched once; groups are then read from each short match.
    """
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(
        m.alias("g0"), *[F.regexp_extract(m, pattern, g).alias(f"g{g}") for g in range(1, groups + 1)]))


def _bare(column: Column) -> Column:
    return F.substring_index(column, ".", -1)


def _trimmed(text: Column) -> Column:
    """Without white space at both ends; a pattern would be tried at every character."""
    return F.btrim(text, F.lit(BLANKS))


def _names(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda c: F.replace(_trimmed(c), F.lit('"'), F.lit("")))


def _pattern(kind: str, text: Column, columns: Column, tables: Column | None = None, **details: Column) -> Column:
    tables = F.array().cast("array<string>") if tables is None else tables
    entries = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(kind).alias("kind"), _trimmed(text).alias("source_text"), tables.alias("tables"), columns.alias("columns"),
        (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("details"))


def joins(sql: Column) -> Column:
    def one(m: Column) -> Column:
        others = F.regexp_extract_all(m["g3"], F.lit(r"(\w+)\.\w+"), 1)
        columns = F.regexp_extract_all(m["g3"], F.lit(r"(?:\w+\.)?(\w+)\s*="), 1)
        return _pattern("join", m["g0"], F.array_distinct(columns), F.array_distinct(F.concat(F.array(m["g1"]), others)))

    return F.transform(_matches(sql, JOIN, 3), one)


def where_predicates(sql: Column) -> Column:
    return _predicates(F.regexp_extract(sql, WHERE, 1))


def _predicates(clause: Column) -> Column:
    def found(pattern: str, groups: int, kind: str, **details: int) -> Column:
        return F.transform(_matches(clause, pattern, groups), lambda m: _pattern(
            "where", m["g0"], F.array(_bare(m["g1"])), predicate=F.lit(kind), **{k: m[f"g{g}"] for k, g in details.items()}))

    return F.concat(
        found(IN_LIST, 1, "in"), found(IS_NOT_NULL, 1, "is_not_null"),
        found(COMPARISON, 3, "comparison", operator=2, value=3), found(BETWEEN, 3, "between", lower=2, upper=3))


def case_branches(sql: Column) -> Column:
    """Values are joined by commas in ``details``; branches without values are left out."""
    def one(m: Column) -> Column:
        values = F.transform(_matches(m["g1"], WHEN_VALUE, 2), lambda w: F.when(w["g1"] != "", w["g1"]).otherwise(w["g2"]))
        column = F.regexp_extract(_trimmed(m["g1"]), r"(?i)^(\w+(?:\.\w+)?)\s", 1)
        columns = F.when(column != "", F.array(_bare(column))).otherwise(F.array().cast("array<string>"))
        return _pattern("case", m["g0"], columns, values=F.array_join(values, ","), count=F.size(values))

    return F.filter(F.transform(_matches(sql, CASE, 1), one), lambda p: p["details"]["count"] != "0")


def checks(sql: Column) -> Column:
    def one(m: Column) -> Column:
        words = F.regexp_extract_all(m["g1"], F.lit(r"(?i)\b([a-z]\w*)\b"), 1)
        return _pattern("check", m["g0"], F.array_distinct(F.filter(words, lambda w: ~F.upper(w).isin(*CHECK_KEYWORDS))))

    return F.transform(_matches(sql, CHECK, 1), one)


def _body_parts(sql: Column) -> Column:
    return F.split(F.regexp_extract(sql, CREATE_BODY, 1), ",")


def _inline(sql: Column, kind: str, pattern: str, unless: str | None = None) -> Column:
    parts = _body_parts(sql)
    fits = F.filter(parts, lambda p: p.rlike(pattern) & (~p.rlike(unless) if unless else F.lit(True)))
    return F.transform(fits, lambda p: _pattern(kind, F.regexp_extract(p, pattern, 0), F.array(F.regexp_extract(p, pattern, 1))))


def uniques(sql: Column) -> Column:
    table_level = F.transform(_matches(sql, UNIQUE, 1), lambda m: _pattern("unique", m["g0"], F.filter(_names(m["g1"]), lambda c: c != "")))
    return F.concat(table_level, _inline(sql, "unique", INLINE_UNIQUE, r"(?i)^\s*UNIQUE\s*\("))


def not_nulls(sql: Column) -> Column:
    altered = F.transform(_matches(sql, ALTER_NOT_NULL, 1), lambda m: _pattern("not_null", m["g0"], F.array(m["g1"])))
    return F.concat(_inline(sql, "not_null", INLINE_NOT_NULL), altered)


def foreign_keys(sql: Column) -> Column:
    return F.transform(_matches(sql, FOREIGN_KEY, 3), lambda m: _pattern(
        "foreign_key", m["g0"], _names(m["g1"]), F.array(m["g2"]), referenced=F.array_join(_names(m["g3"]), ",")))


def defaults(sql: Column) -> Column:
    return F.transform(_matches(sql, DEFAULT, 2), lambda m: _pattern("default", m["g0"], F.array(m["g1"]), value=_trimmed(m["g2"])))


def group_bys(sql: Column) -> Column:
    return _grouped(F.regexp_extract(sql, GROUP_BY, 0), F.regexp_extract(sql, GROUP_BY, 1))


def _grouped(source: Column, clause: Column) -> Column:
    columns = F.filter(F.transform(F.split(clause, ","), lambda c: _bare(_trimmed(c))), lambda c: (c != "") & ~c.rlike(r"^\d+$"))
    return F.filter(F.array(_pattern("group_by", source, columns)), lambda p: F.size(p["columns"]) > 0)


EXTRACTORS = {
    "join": joins, "where": where_predicates, "case": case_branches, "check": checks, "unique": uniques,
    "not_null": not_nulls, "foreign_key": foreign_keys, "default": defaults, "group_by": group_bys,
}


def patterns(statements: DataFrame, *keys: str, kinds: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    """All evidence of the given kinds, one pass over the statements; ``place`` numbers the patterns of a statement."""
    found = [F.coalesce(F.when(F.contains(F.col("__upper"), F.lit(NEEDED[k])), EXTRACTORS[k](F.col("sql"))), F.array().cast(PATTERNS)) for k in kinds]
    both = found[0] if len(found) == 1 else F.concat(*found)
    upper = statements.withColumn("__upper", F.upper("sql"))  # once for all kinds
    return upper.select(*keys, "file_path", "statement", "start_line", "end_line", F.posexplode(both).alias("place", "p")).select(
        *keys, "file_path", "statement", "start_line", "end_line", "place", "p.*")


# ---- clauses of nested statements ---------------------------------------------------------------------------

# What a clause walk looks at, and the words that end a clause at its own level.
CLAUSE_TOKEN = r"""(?is)'[^']*(?:'|\Z)|"[^"]*(?:"|\Z)|--[^\n]*|/\*.*?(?:\*/|\Z)|[();]|\b(?:GROUP\s+BY|ORDER\s+BY|WHERE|HAVING|LIMIT|UNION|CHECK|SELECT)\b"""
ENDS_WHERE = ("group by", "order by", "having", "limit", "union", ";")
ENDS_GROUP = ("having", "order by", "limit", "union", ";")


def _walk(sql: str) -> list[dict]:
    """WHERE, GROUP BY and CHECK clauses in the order they begin, each up to the end of its own level."""
    found: list[tuple[int, int, str, int]] = []  # begin, end, kind, begin of its text
    nested: list[tuple[int, int]] = []  # brackets that hold a SELECT
    levels: list[dict] = [{"at": 0, "clause": None, "select": False, "check": None}]
    before = ("", 0, 0)  # the word before, its begin and end

    def close(end: int) -> None:
        if levels[-1]["clause"]:
            begin, kind, text = levels[-1]["clause"]
            found.append((begin, end, kind, text))
            levels[-1]["clause"] = None

    for m in re.finditer(CLAUSE_TOKEN, sql):
        word = re.sub(r"\s+", " ", m.group().lower())
        if word == "(":
            check = before[1] if before[0] == "check" and not sql[before[2]:m.start()].strip() else None
            levels.append({"at": m.start(), "clause": None, "select": False, "check": check})
        elif word == ")":
            close(m.start())
            if len(levels) > 1:
                level = levels.pop()
                if level["check"] is not None:
                    found.append((level["check"], m.end(), "check", level["at"] + 1))
                if level["select"]:
                    nested.append((level["at"], m.end()))
        elif word == "select":
            levels[-1]["select"] = True
        elif word[0] not in "'\"-/":
            kind = levels[-1]["clause"][1] if levels[-1]["clause"] else ""
            if kind == "where" and word in ENDS_WHERE or kind == "group_by" and word in ENDS_GROUP or word in ("where", "group by"):
                close(m.start())
            if word in ("where", "group by"):
                levels[-1]["clause"] = (m.start(), word.replace(" ", "_"), m.end())
        before = (word, m.start(), m.end())
    while levels:
        close(len(sql))
        levels.pop()
    nested.sort()
    rows = []
    for begin, end, kind, text in sorted(found):
        parts, at, upto = [], text, end - (kind == "check")
        for a, b in nested[bisect_left(nested, (text, 0)):bisect_left(nested, (upto, 0))]:
            if a >= at:  # a bracket inside one already left out is left out with it
                parts, at = [*parts, sql[at:a], "()"], b
        clause = "".join([*parts, sql[at:upto]])
        rows.append({"kind": kind, "clause": clause, "source_text": sql[begin:text] + clause + sql[upto:end]})
    return rows


def clauses(sql: Column) -> Column:
    """Clauses of each statement at every level. Levels are beyond regular expressions, so this one step is Python; it
    walks a statement once, with a stack of open brackets. Subqueries are shown as () in the clause around them."""
    @F.pandas_udf("array<struct<kind:string,clause:string,source_text:string>>")
    def walk(texts: pd.Series) -> pd.Series:
        return pd.Series([_walk(t) if t else [] for t in texts], dtype=object)

    return walk(sql)


def nested_patterns(statements: DataFrame, *keys: str) -> DataFrame:
    """Evidence of WHERE, GROUP BY and CHECK clauses at every level of a statement, each clause by itself: every branch of a
    UNION, outer clauses after a subquery, and whole CHECK conditions. Quoted text in a CHECK names no column."""
    def one(c: Column) -> Column:
        words = F.regexp_extract_all(F.regexp_replace(c["clause"], "'[^']*'", " "), F.lit(r"(?i)\b([a-z]\w*)\b"), 1)
        check = F.array(_pattern("check", c["source_text"], F.array_distinct(F.filter(words, lambda w: ~F.upper(w).isin(*CHECK_KEYWORDS)))))
        return F.when(c["kind"] == "where", _predicates(c["clause"])).when(c["kind"] == "group_by", _grouped(c["source_text"], c["clause"])).otherwise(check)

    needed = F.upper("sql").rlike("WHERE|GROUP|CHECK")
    found = statements.withColumn("clauses", clauses(F.when(needed, F.col("sql"))))
    return found.select(*keys, "file_path", "statement", "start_line", "end_line", F.posexplode(F.flatten(F.transform("clauses", one))).alias("place", "p")).select(
        *keys, "file_path", "statement", "start_line", "end_line", "place", "p.*")


# ---- what the evidence suggests --------------------------------------------------------------------------

def entity_candidates(found: DataFrame, *keys: str) -> DataFrame:
    """Tables named in patterns as entity types (keys, table_name, entity, reference_mode)."""
    tables = found.select(*keys, F.explode("tables").alias("table_name")).distinct()
    return tables.select(*keys, "table_name", to_pascal(F.col("table_name")).alias("entity"), F.concat("table_name", F.lit("_id")).alias("reference_mode"))


def reference_candidates(found: DataFrame, *keys: str) -> DataFrame:
    """Pairs of entity types joined somewhere (keys, entity, referenced)."""
    pairs = found.filter("kind = 'join' AND size(tables) >= 2").select(*keys, F.col("tables")[0].alias("a"), F.col("tables")[1].alias("b"))
    return pairs.distinct().select(*keys, to_pascal(F.col("a")).alias("entity"), to_pascal(F.col("b")).alias("referenced")).distinct()


def _listed(text: Column) -> Column:
    """Value lists of ``column IN (...)``: structs (column, values); quotes are dropped, subqueries are not lists."""
    lists = F.transform(_matches(text, r"(?i)(\w+(?:\.\w+)?)\s+IN\s*\(([^)]*)\)", 2), lambda m: F.struct(
        _bare(m["g1"]).alias("column"),
        F.filter(F.transform(F.split(m["g2"], ","), lambda v: F.regexp_replace(_trimmed(v), "^['\"]|['\"]$", "")), lambda v: (v != "") & ~v.startswith("SELECT")).alias("values")))
    return F.filter(lists, lambda x: F.size(x["values"]) > 0)


def constraint_suggestions(found: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Constraints the evidence supports where none is declared: (keys, column, type, allowed).

    ``known`` (keys, column, has_mandatory, has_uniqueness, has_values) lists the
    columns that have a fact type. The first evidence in file order decides.
    """
    order = F.struct("file_path", "statement", "place").alias("at")
    text = F.col("source_text")

    none = F.lit(None).cast("array<string>")

    def offer(column: Column, kind: str, values: Column = none) -> Column:
        return F.struct(column.alias("column"), F.lit(kind).alias("type"), values.alias("allowed"))

    guarded = F.array_distinct(F.transform(F.concat(F.regexp_extract_all(text, F.lit(IS_NOT_NULL), 1), F.regexp_extract_all(text, F.lit(NOT_IS_NULL), 1)), _bare))
    mandatory = F.transform(guarded, lambda c: offer(c, "mandatory"))
    listed = F.transform(_listed(text), lambda x: offer(x["column"], "value_constraint", x["values"]))
    several = (F.size("columns") == 1) & (F.coalesce(F.col("details")["count"].try_cast("int"), F.lit(0)) >= 2)
    branches = F.array(offer(_bare(F.get("columns", F.lit(0))), "value_constraint", F.split(F.col("details")["values"], ",")))
    single = F.array(offer(F.get("columns", F.lit(0)), "internal_uniqueness"))
    items = (
        F.when(F.col("kind") == "not_null", F.transform("columns", lambda c: offer(c, "mandatory")))
        .when(F.col("kind") == "where", F.concat(mandatory, listed)).when(F.col("kind") == "check", listed)
        .when((F.col("kind") == "case") & several, branches).when((F.col("kind") == "unique") & (F.size("columns") == 1), single)
    )
    # one pass over the patterns; the extraction behind them is not repeated per kind
    offered = found.select(*keys, order, F.explode(items).alias("o")).select(*keys, "at", "o.*")
    first = offered.groupBy(*keys, "column", "type").agg(F.min_by("allowed", "at").alias("allowed"))
    declared = (
        F.when(F.col("type") == "mandatory", F.col("has_mandatory")).when(F.col("type") == "internal_uniqueness", F.col("has_uniqueness")).otherwise(F.col("has_values"))
    )
    return first.join(known, [*keys, "column"]).filter(~F.coalesce(declared, F.lit(False))).select(*keys, "column", "type", "allowed")


def relationship_gaps(found: DataFrame, entities: DataFrame, declared: DataFrame, project: str = "project", model: str = "model") -> DataFrame:
    """Relations seen in joins and foreign keys that no test declares, once per unordered pair: (project, a, b).

    The near side is the model itself; the far side is the first table that names
    another known entity. entities (project, entity), declared (project, a, b) with a <= b.
    """
    seen = found.filter("kind IN ('join', 'foreign_key')").select(project, to_pascal(F.col(model)).alias("source"), "file_path", "statement", "place", F.posexplode("tables").alias("i", "t"))
    known = entities.select(project, "entity").distinct()
    near = seen.join(known.withColumnRenamed("entity", "source"), [project, "source"])
    far = near.withColumn("target", to_pascal(F.col("t"))).join(known.withColumnRenamed("entity", "target"), [project, "target"]).filter("source <> target")
    first = far.groupBy(project, "source", "file_path", "statement", "place").agg(F.min_by("target", "i").alias("target"))
    pairs = first.select(project, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.join(declared.select(project, "a", "b").distinct(), [project, "a", "b"], "left_anti")


def column_test_report(tests: DataFrame, models: DataFrame) -> DataFrame:
    """What column tests say: (model, severity, category, column).

    ``tests`` (model, column, column_pos, test, kind), kind being ``builtin`` or
    ``custom``; tests of a whole model have no column. Both unique and not_null on
    a column make it the identifier (the first such column); a model without one is
    a gap; custom tests need review, those of a model in a row without column.
    Relationships are listed by ``relationship_tests``.
    """
    both = tests.filter("column IS NOT NULL AND test IN ('unique', 'not_null')").groupBy("model", "column", "column_pos").agg(
        F.max(F.col("test") == "unique").alias("u"), F.max(F.col("test") == "not_null").alias("n")).filter("u AND n")
    key = both.groupBy("model").agg(F.min_by("column", "column_pos").alias("column"))
    identified = models.select("model").join(key, "model", "left").select(
        "model", F.when(F.col("column").isNull(), "gap").otherwise("info").alias("severity"), F.lit("identifier").alias("category"), "column")
    custom = tests.filter("kind = 'custom'").select("model", F.lit("warning").alias("severity"), F.lit("macro").alias("category"), "column")
    return identified.unionByName(custom)


def relationship_tests(tests: DataFrame) -> DataFrame:
    """References that column tests state: (model, column, target_model, target_field), a row per test.

    ``tests`` (model, column, test, to, field), ``to`` and ``field`` being the
    arguments of a relationships test. Other tests and those of a whole model give
    no row.
    """
    return tests.filter("test = 'relationships' AND column IS NOT NULL").select(
        "model", "column", F.col("to").alias("target_model"), F.col("field").alias("target_field"))


# Template constructs in the order they are replaced, and what takes their place.
TEMPLATE_RULES = (
    (r"\{\{\s*ref\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}", "$1"),
    (r"\{\{\s*source\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}", "$1.$2"),
    (r"\{\{\s*config\([^)]*\)\s*\}\}", ""),
    (r"\{%[-\s]*config\([^)]*\)\s*[-]?%\}", ""),
    (r"\{\{\s*var\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}", "'$1'"),
    (r"\{\{\s*this\s*\}\}", "this_model"),
    (r"(?s)\{%[-\s]*if\s+is_incremental\(\)\s*[-]?%\}.*?\{%[-\s]*else\s*[-]?%\}(.*?)\{%[-\s]*endif\s*[-]?%\}", "$1"),
    (r"(?s)\{%[-\s]*if\s+is_incremental\(\)\s*[-]?%\}.*?\{%[-\s]*endif\s*[-]?%\}", ""),
    (r"(?s)\{%[-\s]*.*?[-]?%\}", ""),
    (r"(?s)\{\{.*?\}\}", ""),
    (r"\n{3,}", "\n\n"),
)


def flatten_template(sql: Column) -> Column:
    """Templated SQL as plain SQL: references by name, incremental branches dropped, other markup removed."""
    for pattern, text in TEMPLATE_RULES:
        sql = F.regexp_replace(sql, pattern, text)
    return _trimmed(sql)
