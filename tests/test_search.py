"""Order-dependent and iterative operators against plain re-implementations on small data."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict, deque

from pyspark.sql import Window, functions as F

from factloom.operators import catalog_queries as Q, partition as P, sequences as S, sql_mining as R
from factloom.workloads.catalog_data import catalog
from factloom.workloads.evolution import domains, seeds
from factloom.workloads.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def test_bucketed_windows_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "k STRING, o BIGINT, v INT")
    w = Window.partitionBy("k").orderBy("o")
    bucket = F.floor(F.col("o") / 7)
    for got, want in (
        *[(step(df, ["k"], ["o"], None, *names), df.withColumn("x", plain)) for step, names, plain in (
            (S.next_value, ("v", "x"), F.lead("v").over(w)), (S.previous_value, ("v", "x"), F.lag("v").over(w)), (S.number_rows, ("x",), F.row_number().over(w).cast("bigint")))],
        (S.next_value(df, ["k"], ["o"], bucket, "v", "x"), df.withColumn("x", F.lead("v").over(w))),
        (S.previous_value(df, ["k"], ["o"], bucket, "v", "x"), df.withColumn("x", F.lag("v").over(w))),
        (S.number_rows(df, ["k"], ["o"], bucket, "x"), df.withColumn("x", F.row_number().over(w).cast("bigint"))),
        (S.first_rows(df, ["k"], ["o"], 3), df.withColumn("x", F.row_number().over(w)).filter("x <= 3").drop("x")),
    ):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_buckets_stay_even_when_one_key_and_hour_hold_most_rows(spark):
    """90 % of the rows are one player's, in one hour: no bucket holds many more rows than another, and numbers are right."""
    hot = spark.range(90_000).selectExpr("'hot' AS k", "id % 3600 AS second", "id")
    df = hot.union(spark.range(90_000, 100_000).selectExpr("concat('k', id % 50) AS k", "id * 97 % 864000 AS second", "id"))
    wide = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in S.bucketed(df, ["k"], ["second", "id"]).groupBy("_b").agg(F.count("*").alias("n")).collect()]
        got = S.number_rows(df, ["k"], ["second", "id"], None, "x")
        steps = S.next_value(df, ["k"], ["second", "id"], None, "id", "x")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", wide)
    assert len(sizes) >= 6 and max(sizes) < 2.5 * 100_000 / len(sizes)
    w = Window.partitionBy("k").orderBy("second", "id")
    for found, plain in ((got, F.row_number().over(w).cast("bigint")), (steps, F.lead("id").over(w))):
        assert found.exceptAll(df.withColumn("x", plain)).isEmpty()


def test_shortest_paths_equal_breadth_first_search(spark):
    cat = catalog(Tables(spark, FOLDER))
    names, by_model = {}, defaultdict(list)
    for o in cat.object_types.orderBy("seq").collect():
        names.setdefault((o.model_id, o.name.lower()), o.object_type_id)
    roles = defaultdict(list)
    for r in cat.roles.collect():
        roles[(r.model_id, r.fact_type_id)].append((r.pos, r.player_id))
    for f in cat.fact_types.orderBy("model_id", "seq").collect():
        by_model[f.model_id].append((f.fact_type_id, [p for _, p in sorted(roles[(f.model_id, f.fact_type_id)])]))
    got = {r.model_id: [(s["fact_type_id"], s["from"], s["to"]) for s in r.steps] if r.found else None for r in Q.shortest_paths(cat, "Order 3", "Order 40").collect()}
    for model, path in got.items():
        start, end = names[(model, "order 3")], names[(model, "order 40")]
        before, queue = {start: None}, deque([start])
        while queue and end not in before:
            node = queue.popleft()
            for ft, players in by_model[model]:
                for i, p in enumerate(players):
                    for j, q in enumerate(players):
                        if p == node and i != j and q not in before:
                            before[q] = (ft, node, q)
                            queue.append(q)
        want, node = [], end
        while end in before and before[node] is not None:
            want.insert(0, before[node])
            node = before[node][1]
        assert path == (want if end in before else None), model


def test_partition_votes_equal_plain_votes(spark):
    t = Tables(spark, FOLDER)
    cat = catalog(t)
    edges = [(r.model_id, r.a, r.b, r.n) for r in P.neighbours(cat).collect()]
    last = {(r.model_id, r.name): r.object_type_id for r in cat.object_types.orderBy("seq").collect()}
    rank = {"sales": 0, "stock": 1, "supply": 2}
    home: dict = {}
    for r in sorted(seeds(t).collect(), key=lambda r: rank[r.context]):
        home.setdefault((r.model_id, last[(r.model_id, r.name)]), r.context)
    objects = [(o.model_id, o.object_type_id) for o in cat.object_types.collect()]
    for _ in range(P.PASSES):
        votes = defaultdict(Counter)
        for m, a, b, n in edges:
            if (m, a) not in home and (m, b) in home:
                votes[(m, a)][home[(m, b)]] += n
        home.update({k: max(v, key=lambda c: (v[c], -rank[c])) for k, v in votes.items() if k in set(objects)})
    start = seeds(t).join(cat.object_types.groupBy("model_id", "name").agg(F.max_by("object_type_id", "seq").alias("object_type_id")), ["model_id", "name"]).join(domains(t), ["model_id", "context"])
    start = start.groupBy("model_id", "object_type_id").agg(F.min_by(F.struct("context", "rank"), "rank").alias("w")).select("model_id", "object_type_id", "w.*")
    got = P.vote_homes(start, P.neighbours(cat), cat.object_types.select("model_id", "object_type_id"))
    assert {(r.model_id, r.object_type_id): r.context for r in got.collect()} == home


def plain_split(sql: str) -> list[str]:
    out, current, state, i = [], "", "", 0
    while i < len(sql):
        two = sql[i:i + 2]
        if state == "" and two in ("--", "/*"):
            state = two
        elif state == "--" and sql[i] == "\n":
            state = ""
        elif state == "/*" and two == "*/":
            current, i, state = current + two, i + 2, ""
            continue
        elif state == "" and sql[i] in "'\"":
            state = sql[i]
        elif state == sql[i]:
            state = ""
        if state == "" and sql[i] == ";":
            out.append(current)
            current = ""
        else:
            current += sql[i]
        i += 1
    return [s.strip() for s in [*out, current] if s.strip()]


def test_statement_split_equals_character_walk(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", ";", "'", '"', "--", "\n", "/*", "*/", " ", "b;", "-", "/"]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts.append("select 'x;y' " * 20000 + "; select 1")  # a long text is cut whole
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(texts)], "file_path STRING, sql STRING")
    got = defaultdict(list)
    for r in R.split_statements(df).orderBy("statement").collect():
        got[r.file_path].append(r.sql)
    for i, text in enumerate(texts):
        assert got[str(i)] == [re.sub(r"^\s+|\s+\Z", "", s) for s in plain_split(text)], text[:200]
