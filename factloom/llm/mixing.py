"""Mixing of sources to target weights by distributed prefix sums over hash-random order.

Every document gets a random-looking key, its MD5. Equal ranges of the key space split each source into parts of nearly
equal size; word counts are summed by part, the sums are accumulated per source, and inside each part a window counts up
to the document. A source's budget cuts that order exactly: whole passes first, then the rest up to a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.operators.sequences import number_rows
from factloom.plans.session import materialize

WEIGHTS = (5, 2, 1)  # by place in code point order, repeating
MOST_EPOCHS = 3
PART_ROWS = 2048  # rows of all sources in one range of the key space
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source_key, source_null, source_size), a row per source -> with target: shares of the total by weight, none
    above epochs times the size; what goes beyond is shared again by weight among the rest.

    The table has a row per source, so its windows need no partitioning."""
    place = F.row_number().over(Window.orderBy("source_null", "source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("most_per_weight", "source_null", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    left_total = F.col("total") - F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0))
    left_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    placed = (
        sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("most_per_weight", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", left_total / left_weight)
        .withColumn("rank", F.row_number().over(Window.orderBy("most_per_weight", "source_null", "source_key"))))
    # the sources before the first that stays below its most take their most, the others share what is left
    upto = Window.orderBy("most_per_weight", "source_null", "source_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("below", F.max(F.col("most_per_weight") >= F.col("level")).over(upto))
    level = F.max_by(F.when(F.col("below"), F.col("level")), F.when(F.col("below"), -F.col("rank"))).over(everything)
    return placed.select("source_key", "source_null", "source_size",
                         F.when(~F.col("below"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _distinct_rows(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """The distinct (doc_id, source, size, body), body being a hash of the text, with key and repeats; stored."""
    identity = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source_key"), F.col(source).isNull().alias("source_null"),
        _size(text).alias("size"), F.md5(F.concat(F.lit(f"{seed}|"), identity)).alias("key"), F.xxhash64(text).alias("body"))
    return materialize(keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("repeats")), "mix-rows")


def _taken(rows: DataFrame, weights: tuple[int, ...], epochs: int, part_rows: int) -> DataFrame:
    """rows, one for each of its repeats, with copy (from 0), source_size, target and taken."""
    parts = max(1, -(-rows.count() // part_rows))
    rows = rows.withColumn("part", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * parts, 32))

    group = ["source_key", "source_null"]
    sums = rows.groupBy(*group, "part").agg(F.sum(F.col("size") * F.col("repeats")).alias("part_size"))
    targets = source_targets(sums.groupBy(*group).agg(F.sum("part_size").alias("source_size")), weights, epochs)
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("part_before", F.coalesce(F.sum("part_size").over(earlier), F.lit(0))).join(targets, group)

    before = Window.partitionBy(*group, "part").orderBy("key", "doc_id", "size", "body").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    placed = (
        rows.join(sums, [*group, "part"])
        .withColumn("before", F.col("part_before") + F.coalesce(F.sum(F.col("size") * F.col("repeats")).over(before), F.lit(0)))
        .withColumn("whole", whole).withColumn("rest", budget - F.col("whole") * F.col("source_size"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1))))
    last = F.least(F.greatest(F.col("rest") - F.col("before") - F.col("copy") * F.col("size"), F.lit(0)), F.col("size"))
    return placed.withColumn("taken", (F.col("whole") * F.col("size") + last).cast("long")).withColumn("source", F.when(~F.col("source_null"), F.col("source_key")))


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, part_rows: int = PART_ROWS, seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, source, size (words), source_size, target, taken (words, repeats counted).

    Null text has size 0. A null source is a source of its own, last in order. Each source takes floor(target) words: all
    its documents as often as they fit, then those first in key order, the last of them in part. The key is a digest of the
    doc_id, or of the text where that is null; equal keys go by doc_id, size and a hash of the text. No document is taken
    more than `epochs` times. Other columns take no part; an empty table gives an empty result."""
    rows = _distinct_rows(docs, doc_id, text, source, seed)
    return _taken(rows, weights, epochs, part_rows).select("doc_id", "source", "size", "source_size", "target", "taken")


def _numbered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with copy: 0, 1, ... among those equal in i, s and h. Only rows that known repeats are numbered, task by task with
    sums of the tasks before, so that not even those of one key gather."""
    repeats = known.filter("repeats > 1").select(F.col("doc_id").alias("i"), F.when(~F.col("source_null"), F.col("source_key")).alias("s"), F.col("body").alias("h")).distinct()
    if repeats.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in "ish"]
    placed = rows.withColumn("row", F.monotonically_increasing_id())
    several = number_rows(placed.alias("l").join(repeats.alias("r"), same, "left_semi"), ["i", "s", "h"], ["row"], F.shiftright("row", 33), "copy")
    single = placed.alias("l").join(repeats.alias("r"), same, "left_anti").withColumn("copy", F.lit(1).cast("long"))
    return several.unionByName(single).withColumn("copy", F.col("copy") - 1).drop("row")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, part_rows: int = PART_ROWS, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as it is taken whole, then cut after the last word taken.

    Options and order are those of plan_mix; every source gives exactly the words of its plan, whatever ids repeat or are
    null. A column n_chars, where there is one, follows the text. Rows of which nothing is taken do not appear."""
    space = r"\x20\x09-\x0D"
    known = _distinct_rows(docs, doc_id, text, source, seed)
    shares = _taken(known, weights, epochs, part_rows).filter("taken > 0").select(
        F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("body").alias("h"), "copy", "size", "taken")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(doc_id).alias("i"), F.col(source).alias("s"), F.xxhash64(text).alias("h"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("i", "s", "h", "copy")]
    taken = _numbered(rows, known).alias("l").join(shares.alias("r"), same).select("doc", "size", "taken")
    whole, rest = F.expr("taken DIV size"), F.col("taken") % F.col("size")
    copies = taken.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), whole + F.when(rest > 0, 1).otherwise(0))))
    # pieces are words with the white space after them
    body = F.col("doc")[text]
    words = F.split(F.regexp_replace(body, f"^[{space}]+", ""), f"(?<=[{space}])(?=[^{space}])")
    cut = F.regexp_replace(F.array_join(F.slice(words, 1, rest.cast("int")), ""), f"[{space}]+$", "")
    mixed = copies.withColumn("body", F.when(F.col("turn") <= whole, body).otherwise(cut))
    changed = {text: F.col("body")} | ({"n_chars": F.length("body").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return mixed.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
