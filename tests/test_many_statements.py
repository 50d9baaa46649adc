"""Files of many statements are split in time that grows with their length; what splits them is unchanged."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from factloom.operators import sql_mining as R

TOKEN = r"""(?s)'[^']*(?:'|\Z)|"[^"]*(?:"|\Z)|--[^\n]*|/(?=\*).*?(?:\*/|\Z)|;|[^;'"/-]+|."""


def plainly(text):
    """Tokens between delimiters, joined and trimmed, with their lines."""
    parts = [""]
    for token in re.findall(TOKEN, text):
        if token == ";":
            parts.append("")
        else:
            parts[-1] += token
    rows, line = [], 0
    for sql in (p.strip(" \t\n\x0b\f\r") for p in parts):
        if sql:
            lines = sql.count("\n") + 1
            rows.append((len(rows), line + 1, line + lines, sql))
            line += lines
    return rows


def test_splitting_is_that_of_tokens(spark):
    rng = random.Random(7)
    texts = ["", ";", " ; ;", "a", "'", "\"x;", "--;\n;b", "/*;", "/*/;*/;c", "a-b;c/d;;\n\ne", "é;\U0001f600 x;'😀;'"]
    texts += ["".join(rng.choice(["'", '"', "--", "/*", "*/", "/", "-", ";", ";", "\n", " ", "a", "B\n1", "\r"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("null", None)], "file_path STRING, sql STRING")
    found = {}
    for r in R.split_statements(df).collect():
        found.setdefault(r.file_path, []).append((r.statement, r.start_line, r.end_line, r.sql))
    assert {k: sorted(v) for k, v in found.items()} == {str(k): rows for k, t in enumerate(texts) if (rows := plainly(t))}


def test_a_file_of_many_statements(spark):
    def seconds(files: int, n: int) -> float:
        text = F.concat_ws(";\n", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("SELECT " + "'a;b' - " * 20 + "1,\n"), k)))
        df = spark.range(files, numPartitions=1).select(F.col("id").cast("string").alias("file_path"), text.alias("sql"))
        began = time.monotonic()
        last = R.split_statements(df).agg(F.count("*").alias("n"), F.max("start_line").alias("start"), F.max("end_line").alias("end")).first()
        assert tuple(last) == (files * n, 2 * n - 1, 2 * n)
        return time.monotonic() - began

    seconds(2, 100)
    # as much text in one file as in a hundred: once every statement went through the tokens of its whole file
    assert seconds(1, 20_000) < 4 * seconds(100, 200) + 2


def test_a_long_statement(spark):
    df = spark.range(1).select(F.lit("f").alias("file_path"), F.concat(F.repeat(F.lit("'x;' - /* ; */ a /\n"), 50_000), F.lit(";b")).alias("sql"))
    assert [(r.start_line, r.end_line) for r in R.split_statements(df).orderBy("statement").collect()] == [(1, 50_000), (50_001, 50_001)]
