"""Connected components of an edge table by repeated minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.plans.session import materialize


def components(edges: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(node, label) for every node of an edge, label being the smallest node reachable. Repeated edges and loops do no harm.

    Each round takes the least label among the neighbours, then the label of that label. Every round is stored in the shared
    folder; the number of rounds follows from the data."""
    there, back = F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other"))
    # both directions from one row: a union would compute the edges twice
    graph = materialize(edges.select(F.inline(F.array(there, back))).distinct(), "graph")
    labels = materialize(graph.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = graph.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = materialize(low.join(jump, "label").select("node", F.least("label", "further").alias("label"), "old"), "labels")
        if after.filter("label <> old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
