"""Ring checks: properties of the directed graph formed by two roles of one fact type."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.operators.rows import check_rows
from factloom.plans.factset import FactSet
from factloom.plans.model import Constraint
from factloom.plans.session import cut_lineage, materialize
from factloom.plans.violations import record, union

RULE = "population/ring-violation"


def edge_rows(facts: FactSet, c: Constraint) -> DataFrame:
    a, b = c.roles
    return facts.rows(c.fact_type).select("pop_id", "inst_id", F.col(a).alias("a"), F.col(b).alias("b")).dropna(subset=["a", "b"])


def _rows_violation(df: DataFrame, c: Constraint, message: str) -> DataFrame:
    return df.select(*record(
        RULE, c.severity, F.col("pop_id"), constraint=c.id, fact_type=c.fact_type, pop=F.col("pop_id"),
        inst=F.col("inst_id"), subject=[F.col("a"), F.col("b")], message=f"{c.ring}: {message}"))


def _reverse(edges: DataFrame) -> DataFrame:
    """Distinct reversed pairs; the de-duplication keeps a hot pair to one row on the small side."""
    return edges.select("pop_id", F.col("b").alias("a"), F.col("a").alias("b")).distinct()


def check_asymmetric(facts: FactSet, c: Constraint) -> DataFrame:
    # A self pair is its own reverse, so the semi-join covers it too.
    edges = edge_rows(facts, c)
    return _rows_violation(edges.join(_reverse(edges), ["pop_id", "a", "b"], "left_semi"), c, "self pair or reverse pair present")


def check_antisymmetric(facts: FactSet, c: Constraint) -> DataFrame:
    edges = edge_rows(facts, c).filter("a <> b")
    return _rows_violation(edges.join(_reverse(edges), ["pop_id", "a", "b"], "left_semi"), c, "reverse pair present")


def check_symmetric(facts: FactSet, c: Constraint) -> DataFrame:
    edges = edge_rows(facts, c).filter("a <> b")
    return _rows_violation(edges.join(_reverse(edges), ["pop_id", "a", "b"], "left_anti"), c, "reverse pair missing")


def weighted_edges(facts: FactSet, c: Constraint) -> DataFrame:
    """Distinct pairs with ``m``, the number of rows that state them."""
    return edge_rows(facts, c).groupBy("pop_id", "a", "b").agg(F.count("*").alias("m"))


def closed_paths(edges: DataFrame) -> DataFrame:
    """Every a->b->c with a->c present: (pop_id, a, b, c, n), n = row pairs forming it.

    A plain self-join on b would build in(b) x out(b) pairs at a hub. Instead,
    paths over three different objects are found as triangles of the undirected
    graph: each undirected edge is owned by its end of lower degree, so no object
    owns more than sqrt(2 x edges) of them and the wedge join is bounded by
    edges^1.5 however skewed the degrees are. Paths with a loop are linear joins.
    """
    loops = edges.filter("a = b").select("pop_id", "a", F.col("m").alias("ml"))
    plain = edges.filter("a <> b")

    # a = b: (a,a),(a,c) is closed by (a,c) itself, c = a included.
    loop_first = loops.join(edges.select("pop_id", "a", F.col("b").alias("c"), "m"), ["pop_id", "a"]).select(
        "pop_id", "a", F.col("a").alias("b"), "c", (F.col("ml") * F.col("m")).alias("n"))
    # b = c: (a,b),(b,b) is closed by (a,b).
    loop_last = plain.join(loops.select("pop_id", F.col("a").alias("b"), "ml"), ["pop_id", "b"]).select(
        "pop_id", "a", "b", F.col("b").alias("c"), (F.col("m") * F.col("ml")).alias("n"))
    # a = c: (a,b),(b,a) is closed by the loop (a,a).
    back = plain.select("pop_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("mr"))
    there_and_back = plain.join(back, ["pop_id", "a", "b"]).join(loops.select("pop_id", "a"), ["pop_id", "a"], "left_semi").select(
        "pop_id", "a", "b", F.col("a").alias("c"), (F.col("m") * F.col("mr")).alias("n"))
    return union([loop_first, loop_last, there_and_back, _triangles(plain)])


def _triangles(plain: DataFrame) -> DataFrame:
    up = F.col("a") < F.col("b")
    # One row per unordered pair; f counts x->y rows and g counts y->x rows.
    pairs = (
        plain.select(
            "pop_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"),
            F.when(up, F.col("m")).otherwise(0).alias("f"), F.when(up, 0).otherwise(F.col("m")).alias("g"))
        .groupBy("pop_id", "x", "y").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    )
    degree = (
        pairs.select("pop_id", F.explode(F.array("x", "y")).alias("v"))
        .groupBy("pop_id", "v").agg(F.count("*").alias("d"))
    )
    ranked = (
        pairs.join(degree.select("pop_id", F.col("v").alias("x"), F.col("d").alias("dx")), ["pop_id", "x"])
        .join(degree.select("pop_id", F.col("v").alias("y"), F.col("d").alias("dy")), ["pop_id", "y"])
    )
    x_low = (F.col("dx") < F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") < F.col("y")))
    # out: low -> high row count, back: high -> low row count
    owned = ranked.select(
        "pop_id",
        F.when(x_low, F.col("x")).otherwise(F.col("y")).alias("lo"),
        F.when(x_low, F.col("y")).otherwise(F.col("x")).alias("hi"),
        F.when(x_low, F.col("dy")).otherwise(F.col("dx")).alias("dh"),
        F.when(x_low, F.col("f")).otherwise(F.col("g")).alias("out"),
        F.when(x_low, F.col("g")).otherwise(F.col("f")).alias("back"),
    )
    one = owned.select("pop_id", "lo", F.col("hi").alias("v"), F.col("dh").alias("dv"), F.col("out").alias("uv"), F.col("back").alias("vu"))
    two = owned.select("pop_id", "lo", F.col("hi").alias("w"), F.col("dh").alias("dw"), F.col("out").alias("uw"), F.col("back").alias("wu"))
    v_first = (F.col("dv") < F.col("dw")) | ((F.col("dv") == F.col("dw")) & (F.col("v") < F.col("w")))
    closing = owned.select("pop_id", F.col("lo").alias("v"), F.col("hi").alias("w"), F.col("out").alias("vw"), F.col("back").alias("wv"))
    found = one.join(two, ["pop_id", "lo"]).filter(v_first).join(closing, ["pop_id", "v", "w"]).withColumnRenamed("lo", "u")

    def path(a: str, b: str, c: str) -> Column:
        m_ab, m_bc, m_ac = F.col(a + b), F.col(b + c), F.col(a + c)
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"),
                        F.when(m_ac > 0, m_ab * m_bc).otherwise(0).alias("n"))

    orders = F.array(*[path(*p) for p in ("uvw", "uwv", "vuw", "vwu", "wuv", "wvu")])
    return found.select("pop_id", F.inline(F.filter(orders, lambda p: p["n"] > 0)))


TRIANGLE_KINDS = ("intransitive", "transitive")


def check_triangles(facts: FactSet, constraints: list[Constraint]) -> list[DataFrame]:
    """Intransitive and transitive constraints over the same roles: distinct pairs and closed paths are stored once for all.

    Intransitive: one row per path a->b->c that a->c closes; ``row_pairs`` counts the pairs of rows forming it.
    Transitive: one row per pair (a, b) that has successors of b which a does not reach directly; ``row_pairs`` is the exact
    number of missing steps, counted by row pairs: all continuations of (a, b) minus the closed ones. Listing each missing
    pair would be quadratic at hubs; ``missing_steps`` lists them for chosen pairs.
    """
    edges = materialize(weighted_edges(facts, constraints[0]), "weighted-edges")
    closed = closed_paths(edges)
    if len(constraints) > 1:
        closed = materialize(closed, "closed-paths")
    return [(_intransitive if c.ring == "intransitive" else _transitive)(c, edges, closed) for c in constraints]


def _intransitive(c: Constraint, edges: DataFrame, closed: DataFrame) -> DataFrame:
    return closed.select(*record(
        RULE, c.severity, F.col("pop_id"), constraint=c.id, fact_type=c.fact_type, pop=F.col("pop_id"),
        subject=[F.col("a"), F.col("b"), F.col("c")], detail={"row_pairs": F.col("n")},
        message="intransitive: the shortcut pair is present"))


def _transitive(c: Constraint, edges: DataFrame, closed: DataFrame) -> DataFrame:
    out = edges.groupBy("pop_id", F.col("a").alias("b")).agg(F.sum("m").alias("next"))
    ended = closed.groupBy("pop_id", "a", "b").agg(F.sum("n").alias("closed"))
    missing = (
        edges.join(out, ["pop_id", "b"]).join(ended, ["pop_id", "a", "b"], "left")
        .withColumn("n", F.col("m") * F.col("next") - F.coalesce("closed", F.lit(0)))
        .filter("n > 0")
    )
    return missing.select(*record(
        RULE, c.severity, F.col("pop_id"), constraint=c.id, fact_type=c.fact_type, pop=F.col("pop_id"),
        subject=[F.col("a"), F.col("b")], detail={"row_pairs": F.col("n")},
        message=F.concat(F.lit("transitive: steps without a direct pair: "), F.col("n").cast("string"))))


def _triangle_check(facts: FactSet, c: Constraint) -> DataFrame:
    return check_triangles(facts, [c])[0]


def missing_steps(facts: FactSet, c: Constraint, chosen: DataFrame) -> DataFrame:
    """For chosen (pop_id, a, b) pairs: each c with b->c but no a->c."""
    edges = edge_rows(facts, c).select("pop_id", "a", "b").distinct()
    steps = chosen.select("pop_id", "a", "b").join(
        edges.select("pop_id", F.col("a").alias("b"), F.col("b").alias("c")), ["pop_id", "b"])
    return steps.join(edges.select("pop_id", "a", F.col("b").alias("c")), ["pop_id", "a", "c"], "left_anti").select("pop_id", "a", "b", "c")


SMALL = 100_000  # edges of a group that one task may search by itself


def _search(edges: list[tuple[str, str]]) -> bool:
    """Whether the pairs form a cycle: objects without a predecessor are taken away until none is left to take."""
    after, waiting = {}, {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        waiting[b] = waiting.get(b, 0) + 1
    free = [a for a in after if a not in waiting]
    while free:
        for b in after.pop(free.pop(), ()):
            waiting[b] -= 1
            if not waiting[b]:
                free.append(b)
    return bool(after)


def _cyclic_runs(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.RecordBatch]:
    """Groups that have a cycle, from rows in group order. Of the batches read so far only the group they end in is kept."""
    last, edges, kind = None, [], None
    for batch in batches:
        kind, cyclic = batch.schema.field(group).type, []
        for key, a, b in zip(*(batch.column(c).to_pylist() for c in (group, "a", "b"))):
            if edges and key != last:
                if _search(edges):
                    cyclic.append(last)
                edges = []
            last = key
            edges.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array(cyclic, kind)], [group])
    if edges and _search(edges):
        yield pa.RecordBatch.from_arrays([pa.array([last], kind)], [group])


def _small_cyclic(edges: DataFrame, group: str) -> DataFrame:
    """One pass of Python over each task's rows in group order: a call for every group would cost far more than its search."""
    dealt = edges.select(group, "a", "b").repartition(group).sortWithinPartitions(group)
    return dealt.mapInArrow(partial(_cyclic_runs, group=group), T.StructType([edges.schema[group]]))


def cyclic_groups(edges: DataFrame, group: str = "pop_id", small: int = SMALL) -> DataFrame:
    """Groups whose directed graph (group, a, b) has a cycle; one row per group.

    Pairs with a null end are no edges. A group of up to ``small`` edges is searched
    within one task; larger ones by rounds over all tasks. Each round (1) sets
    aside groups that show a self-loop, (2) drops edges that leave a source or enter
    a sink, neither of which lies on a cycle; a group that loses none has a
    predecessor for every object and so a cycle; and (3) shortens chains: an object
    with a single predecessor is merged into it when a per-round coin says so, which
    keeps every cycle (it must pass that predecessor) and ends as a self-loop.
    Chains of any length vanish in logarithmically many rounds. A group that is not
    answered loses edges in every round, so the rounds end by themselves; each is
    checkpointed.
    """
    live = cut_lineage(edges.select(group, F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).dropna(subset=["a", "b"]).distinct())
    sizes = cut_lineage(live.groupBy(group).agg(F.count("*").alias("edges")).filter(F.col("edges") > small).select(group))
    if sizes.isEmpty():
        return _small_cyclic(live, group)
    answered = _small_cyclic(live.join(sizes, group, "left_anti"), group)
    live = live.join(sizes, group, "left_semi")
    # self-loops and two-way pairs answer most cyclic groups before the first round
    back = live.select(group, F.col("b").alias("a"), F.col("a").alias("b"))
    found = [cut_lineage(live.join(back, [group, "a", "b"], "left_semi").select(group).distinct())]
    live = live.join(found[0], group, "left_anti")
    for turn in itertools.count():
        # groups with a self-loop are answered; the checkpointed rows make this step cheap to recompute
        live = live.join(live.filter("a = b").select(group).distinct(), group, "left_anti")
        if live.isEmpty():
            return union([answered, *found]).distinct()
        heads = live.select(group, F.col("b").alias("n")).groupBy(group, "n").agg(F.count("*").alias("ins"))
        tails = live.select(group, F.col("a").alias("n")).distinct()
        trimmed = (
            live.join(heads.select(group, F.col("n").alias("a")), [group, "a"], "left_semi")
            .join(tails.select(group, F.col("n").alias("b")), [group, "b"], "left_semi")
        )
        trimmed = cut_lineage(trimmed)
        edges_of = lambda df: df.groupBy(group).agg(F.count("*").alias("edges"))
        stuck = cut_lineage(edges_of(live).join(edges_of(trimmed), [group, "edges"]).select(group))
        found.append(stuck)
        trimmed = trimmed.join(stuck, group, "left_anti")

        def coin(node: str) -> Column:
            return F.pmod(F.xxhash64(F.col(node), F.lit(turn)), F.lit(2))

        parents = (
            trimmed.groupBy(group, "b").agg(F.count("*").alias("ins"), F.min("a").alias("p"))
            .filter((F.col("ins") == 1) & (coin("b") == 1) & (coin("p") == 0))
            .select(group, F.col("b").alias("n"), "p")
        )
        # A merged object is never itself a merge target (the coins differ), so one renaming step suffices.
        renamed = (
            trimmed.join(parents.select(group, F.col("n").alias("a"), F.col("p").alias("pa")), [group, "a"], "left")
            .join(parents.select(group, F.col("n").alias("b"), F.col("p").alias("pb")), [group, "b"], "left")
            .filter("pb IS NULL")  # the only edge into a merged object is the merging edge itself
            .select(group, F.coalesce("pa", "a").alias("a"), "b")
            .distinct()
        )
        live = cut_lineage(renamed)
        found.append(live.filter("a = b").select(group).distinct())


def check_acyclic(facts: FactSet, c: Constraint) -> DataFrame:
    edges = edge_rows(facts, c).select(F.col("pop_id"), "a", "b")
    return cyclic_groups(edges).select(*record(
        RULE, c.severity, F.col("pop_id"), constraint=c.id, fact_type=c.fact_type, pop=F.col("pop_id"),
        subject=[F.col("pop_id")], message="acyclic: the pairs form a cycle"))


def _local(facts: FactSet, c: Constraint) -> DataFrame:
    return check_rows(facts.rows(c.fact_type), facts.fact_types[c.fact_type], [c])


RING_CHECKS = {
    "irreflexive": _local,
    "purely_reflexive": _local,
    "asymmetric": check_asymmetric,
    "antisymmetric": check_antisymmetric,
    "symmetric": check_symmetric,
    "intransitive": _triangle_check,
    "transitive": _triangle_check,
    "acyclic": check_acyclic,
}


def check_ring(facts: FactSet, c: Constraint) -> DataFrame:
    return RING_CHECKS[c.ring](facts, c)
