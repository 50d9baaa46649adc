"""Exact duplicates by skew-safe combining (DataFrame functions only).

Copies are folded three times, each time comparing the full text next to its SHA-256 digest: inside each task, among the
rows of one digest and salt, and among the winners of the salts. A group of copies of any size costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 32  # a text's rows meet in so many places before their winners meet in one
SPREAD = 16  # and their decisions go back to so many places


def _bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(body, 256).alias("text_sha256"), body.alias("body"))


def copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (largest doc_id), group_size.

    Null text counts as empty. A group whose ids are all null has a null keep_id. Two texts with one digest raise an error.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    salted = _bodies(docs, doc_id, text).groupBy("text_sha256", "body", salt).agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = salted.groupBy("text_sha256", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    one_text = F.count(F.lit(1)) == 1
    return texts.groupBy("text_sha256").agg(
        F.when(one_text, F.max("keep_id")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest"))).alias("keep_id"),
        F.max("group_size").alias("group_size"))


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of equal texts is kept; among rows with that id and text, exactly one. Rows without a
    doc_id are kept only if no copy has one. Other columns take no part; an empty table gives an empty result.
    """
    rows = _bodies(docs, doc_id, text).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("repeats"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    several = copy_groups(docs, doc_id, text, salts).filter("group_size > 1")
    several = several.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        rows.join(several, ["text_sha256", "place"], "left").withColumn("keep_id", keep_id)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
        .select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The kept rows of docs, with all their columns; among rows equal in id and text, any one."""
    # plain keys for join and drop alike, so that texts are dealt out once for both; the row itself travels as one column
    def keyed(df: DataFrame, digest, identity, *more) -> DataFrame:
        return df.select(digest.alias("digest"), F.coalesce(identity, F.lit(0).cast("long")).alias("identity"), identity.isNull().alias("none"), *more)

    keys = ["digest", "identity", "none"]
    kept = keyed(copy_groups(docs, doc_id, text, salts), F.col("text_sha256"), F.col("keep_id"))
    rows = keyed(docs, F.sha2(F.coalesce(F.col(text), F.lit("")), 256), F.col(doc_id).cast("long"), F.struct(*docs.columns).alias("row"))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")
