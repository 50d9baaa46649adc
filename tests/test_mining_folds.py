"""Folds within a row: clauses of nested statements, annotations, and signals found through literals."""

from __future__ import annotations

import random
import re

import pytest

from factloom.operators import source_mining as B, sql_mining as R
from factloom.operators.sets import distinct_counts, united_counts, value_sketches


@pytest.mark.parametrize("sql, want", [
    ("select 1", []),
    ("SELECT a FROM t WHERE a = 1 GROUP BY a HAVING b > 2 ORDER BY c", [("where", "a = 1"), ("group_by", "a")]),
    ("select a from t where x in (select y from u where z = 2 group by y) and w = 3 union select b from v where q = 4",
     [("where", "x in () and w = 3"), ("where", "z = 2"), ("group_by", "y"), ("where", "q = 4")]),
    ("SELECT (SELECT max(x) FROM (SELECT x FROM u WHERE a = 1) i WHERE b = 2) FROM t WHERE c = 3", [("where", "b = 2"), ("where", "a = 1"), ("where", "c = 3")]),
    ("CREATE TABLE t (a INT CHECK (a IN (1, 2) AND (b > 0)), CHECK(c))", [("check", "a IN (1, 2) AND (b > 0)"), ("check", "c")]),
    ("select ')' from t where a = '(' -- where b = 1\n and c = \"d)\" limit 3", [("where", "a = '(' -- where b = 1\n and c = \"d)\"")]),
    ("select a from t where (b = 1 group by c", [("where", "(b = 1 group by c"), ("group_by", "c")]),
    ("a) where b = 1", [("where", "b = 1")]), ("", [])])
def test_clauses_end_at_their_own_level(sql, want):
    got = [(r["kind"], r["clause"].strip()) for r in R._walk(sql)]
    assert sorted(got) == sorted(want)
    begins = [sql.find(r["source_text"].split("()")[0]) for r in R._walk(sql)]
    assert begins == sorted(begins)


def test_deep_brackets_take_linear_time():
    rows = R._walk("select a from t where " + "(select b from u where " * 20_000 + "x = 1" + ")" * 20_000)
    assert len(rows) == 20_001 and all(len(r["clause"]) < 30 for r in rows)


def test_nested_patterns_state_columns(spark):
    df = spark.createDataFrame([("f", 0, 1, 1, "SELECT a FROM t WHERE t.x > 1 UNION SELECT b FROM u WHERE u.y IS NOT NULL GROUP BY u.z, 1"), ("f", 1, 2, 2, None),
                                ("f", 2, 3, 3, "CREATE TABLE t (k TEXT CHECK (k IN ('in', 'out') OR length(k) < 9))")],
                               "file_path string, statement int, start_line int, end_line int, sql string")
    got = [(r.statement, r.place, r.kind, r.columns) for r in R.nested_patterns(df).orderBy("statement", "place").collect()]
    assert got == [(0, 0, "where", ["x"]), (0, 1, "where", ["y"]), (0, 2, "group_by", ["z"]), (2, 0, "check", ["k", "length"])]


def plain_annotations(text):
    """Line by line: the type header above or on the line, and the first line that may be a target among the four below."""
    lines, rows = text.split("\n"), []
    for i, line in enumerate(lines):
        for m in re.finditer(r"@(\w+)(?:\(([^)]*)\))?", line):
            if m.group(1) in B.ANNOTATIONS:
                above = [h for x in lines[:i + 1] if (h := re.search(r"(?:class|interface|enum)\s+(\w+)", x))]
                below = [x.strip(" ") for x in lines[i + 1:i + 5]]
                target = next((x for x in below if x and not re.match(r"@|//|\*", x)), None)
                rows.append((i + 1, m.group(1), above[-1].group(1) if above else None, target))
    return rows


def test_annotations_keep_state_between_lines(spark):
    rng = random.Random(2)
    parts = ["@NotNull", "  @Size(min = 1)", "private String a;", "class A {", "", "// note", "* doc", "enum E", "@Other", "@Id @Column(name = \"x\") int b;", "public int c() {"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(80)]
    df = spark.createDataFrame([("r", f"{i}", t) for i, t in enumerate(texts)] + [("r", "none", None)], "repo_id string, path string, content string")
    read = df.select("path", B.F.inline(B._annotated(B.ANNOTATIONS)(B.F.col("content")))).collect()
    for i, text in enumerate(texts):
        assert [(r.line, r.annotation, r.class_name, r.next) for r in read if r.path == str(i)] == plain_annotations(text), text
    assert "Exchange" not in B.annotations(df)._jdf.queryExecution().executedPlan().toString()


def test_signals_through_literals_equal_all_patterns(spark):
    rng = random.Random(7)
    words = ["@Entity", "app.get(1)", "@app.post (", "from 'express'", "class M(BaseModel)", "class  U  <  ApplicationRecord", "x", "django", '"express"', "rails", "@Module (", "application.yml"]
    names = ["pom.xml", "src/application.yml", "a/b/UserController.java", "manage.py", "x/manage.py", ".hid/models.py", "node_modules/views.py", "app/models/x.rb", "package.json", "routes", "a/myroutes.js", "Gemfile"]
    files = [(f"r{rng.randrange(9)}", rng.choice(names), " ".join(rng.sample(words, rng.randrange(0, 5)))) for _ in range(120)] + [("r0", "pom.xml", None)]
    got = {(r.repo_id, r.signal) for r in B.signal_hits(spark.createDataFrame(files, "repo_id string, path string, content string"), B.signal_table(spark)).collect()}
    want, builds = set(), {f for f, *_ in B.BUILD_FILES}
    for repo, path, content in files:
        folders = path.split("/")[:-1]
        walked = not any(f in B.NOT_SEARCHED for f in folders) and not any(p.startswith(".") for p in path.split("/"))
        for k, (_, kind, pattern, _) in enumerate(B.SIGNALS):
            if kind == "dependency":
                hit = path in builds and content is not None and pattern in content
            elif kind == "source":
                hit = walked and content is not None and re.search(pattern, content)
            else:
                hit = re.search(B.path_pattern(kind, pattern), path) and (walked or kind == "glob")
            want |= {(repo, k)} if hit else set()
    assert got == want and len({k for _, k in want}) > 12


def test_sketches_are_near_and_unite(spark):
    df = spark.range(200_000).selectExpr("CAST(id % 3 AS STRING) AS k", "CAST(id DIV 2 AS STRING) AS value")
    exact = {r.k: r.n for r in distinct_counts(df, ["k"]).collect()}
    near = {r.k: r.n for r in distinct_counts(df, ["k"], approximate=True).collect()}
    halves = [value_sketches(df.filter(f"value % 2 = {h}"), ["k"]) for h in (0, 1)]
    united = {r.k: r.n for r in united_counts(halves, ["k"]).collect()}
    for k, n in exact.items():
        assert abs(near[k] - n) <= 0.03 * n and abs(united[k] - n) <= 0.03 * n
