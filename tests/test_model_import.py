"""Table definitions and column tests against hand-made models and a character walk."""

from __future__ import annotations

import random

from factloom.operators import model_import as I

STATEMENT = "project string, file_path string, statement int, sql string"


def tables(spark, *texts):
    return I.defined_tables(spark.createDataFrame([("p", "f", i, s) for i, s in enumerate(texts)], STATEMENT))


def test_definitions(spark):
    rows = {r.source: r for r in tables(
        spark, 'CREATE TABLE a (x INT, y TEXT NOT NULL PRIMARY KEY, z FLOAT, PRIMARY KEY (x, "z"))', "create table b(\n k uuid primary key,\n CHECK (k > (1 + (2))), m DECIMAL ( 3 , 1 ), n INT REFERENCES a (x))",
        "select 1", "CREATE TABLE s.c (x INT)", "CREATE TABLE d ()", "CREATE TABLE e (p INT, q INT, UNIQUE (p), UNIQUE(p, q), FOREIGN KEY (p, q) REFERENCES a (x, z))").collect()}
    assert set(rows) == {"a", "b", "d", "e"}
    assert [c.column for c in rows["a"].columns] == ["x", "y", "z"] and rows["a"].key == ["x", "z"] and [c.nullable for c in rows["a"].columns] == [True, False, True]
    assert [(c.column, c.data_type) for c in rows["b"].columns] == [("k", "UUID")] and rows["b"].key == ["k"]  # a blank before the bracket, or more words, is no plain column
    assert rows["d"].columns == [] and rows["d"].key == []
    assert rows["e"].uniques == [["p"], ["p", "q"]] and [(r.columns, r.to, r.fields) for r in rows["e"].references] == [(["p", "q"], "a", ["x", "z"])]


def test_parts_equal_a_character_walk(spark):
    rng, bodies = random.Random(3), []
    for _ in range(200):
        parts, depth = [], 0
        for _ in range(rng.randrange(1, 30)):
            c = rng.choice("a b,,()")
            depth += (c == "(" and depth < I.LEVELS - 1) - (c == ")" and depth > 0)
            parts.append(c if c not in "()" or (c == "(") == (depth > 0) else "x")
        body, level, clean = "", 0, []
        for c in "".join(parts):
            if c == "(" and level < I.LEVELS - 1:
                level += 1
            elif c == ")" and level:
                level -= 1
            elif c in "()":
                c = "x"
            clean.append(c)
        bodies.append("".join(clean) + ")" * level)
    want = []
    for body in bodies:
        found, current, level = [], "", 0
        for c in body:
            level += (c == "(") - (c == ")")
            if c == "," and not level:
                found.append(current)
                current = ""
            else:
                current += c
        want.append([x for x in [*found, current] if x])
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = df.select("i", I.F.regexp_extract_all("b", I.F.lit(I._part_pattern()), 0).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == want


def test_defined_model(spark):
    made = I.defined_model(tables(
        spark, "CREATE TABLE ward (id INT PRIMARY KEY, name TEXT)", "CREATE TABLE patient (id INT PRIMARY KEY, ward_id INT NOT NULL, doctor_id INT, owned_ward_fk INT, code CHAR(3) NOT NULL, UNIQUE (code), "
        "FOREIGN KEY (ward_id) REFERENCES ward (id), FOREIGN KEY (doctor_id) REFERENCES doctor (id), FOREIGN KEY (owned_ward_fk) REFERENCES ward (id))"))
    assert sorted((r.column, r.fact_type, r.data_type) for r in made.fact_types.collect()) == [
        ("code", "Patient has Code", "text"), ("name", "Ward has Name", "text"), ("owned_ward_fk", "Patient owned to Ward", None), ("ward_id", "Patient references Ward", None)]
    assert sorted((r.column, r.ord, r.type, r.role) for r in made.constraints.collect()) == [
        ("code", 0, "internal_uniqueness", 1), ("code", 1, "mandatory", 0), ("name", 0, "internal_uniqueness", 0), ("owned_ward_fk", 0, "internal_uniqueness", 1),
        ("ward_id", 0, "internal_uniqueness", 1), ("ward_id", 1, "mandatory", 1)]
    assert [(r.source, r.column, r.severity) for r in made.report.collect()] == [("patient", "doctor_id", "gap")]


def test_tested_model(spark):
    columns = spark.createDataFrame([("p", "orders", c, i) for i, c in enumerate(("code", "id", "who", "state", "size"))] + [("p", "people", "id", 0), ("q", "orders", "id", 0)], "project string, model string, column string, column_pos int")
    test = lambda m, c, i, t, to=None, values=None, p="p": (p, m, c, i, t, to, None, values)
    tests = spark.createDataFrame([
        test("orders", "id", 0, "unique"), test("orders", "id", 1, "not_null"), test("orders", "size", 0, "not_null"), test("orders", "size", 1, "unique"), test("orders", "who", 0, "relationships", "people"),
        test("orders", "state", 0, "accepted_values", None, []), test("people", "id", 0, "unique"), test("people", "id", 1, "not_null"), test("orders", None, 0, "custom")],
        "project string, model string, column string, test_pos int, test string, to string, field string, values array<string>")
    made = I.tested_model(columns, tests)
    # both size and id are unique and not null; the first by position identifies, and the other project's model has no identifier
    assert sorted((r.project, r.column, r.kind, r.fact_type) for r in made.fact_types.collect()) == [
        ("p", "code", "value", "Orders has Code"), ("p", "size", "value", "Orders has Size"), ("p", "state", "value", "Orders has State"), ("p", "who", "reference", "Orders has People")]
    assert sorted((r.column, r.ord, r.type, r.role) for r in made.constraints.collect()) == [
        ("code", 0, "internal_uniqueness", 0), ("size", 0, "internal_uniqueness", 0), ("size", 1, "mandatory", 0), ("size", 2, "internal_uniqueness", 1), ("state", 0, "internal_uniqueness", 0),
        ("who", 0, "internal_uniqueness", 1)]
    assert sorted((r.column, r.severity, r.category) for r in made.report.collect()) == [("state", "warning", "constraint"), ("who", "info", "relationship")]
    assert I.tested_model(columns.limit(0), tests.limit(0)).fact_types.collect() == []
