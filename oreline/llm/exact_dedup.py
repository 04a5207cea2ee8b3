"""Exact deduplication by 128-bit content hash, confirmed by comparing the bytes.

Texts are equal when identical after each run of ASCII white space became one space; a null
text counts as empty.  Rows are grouped by the hash of that text.  In groups of more than
one row every text is compared with the text of the row that stays; texts that differ (a
collision of hashes) are grouped among themselves by their full bytes.

Only hash, id and counts are aggregated, combined in the map tasks; the rows of a large
group are never gathered: the joins read plain shuffles, which adaptive execution splits.

Rows without an id come after all others: such a group has a null ``keep_id``, and all its
rows are kept.  Repeated rows count in ``group_size``, each has a row of the result, and
rows that repeat the staying id are all marked kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oreline.operators.absent import join_afresh
from oreline.sources.paths import stored


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_fn=content_hash,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    ``hash_fn`` maps the normalised text column to the grouping hash; any function of the
    text gives the same result, as collisions are resolved.
    """
    text = normalised(F.col("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", text.alias("text")).withColumn("hash", hash_fn(F.col("text")))
    keyed = stored(rows.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256")), "hashes")
    groups = keyed.groupBy("hash").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size"))
    several = groups.where("size > 1").select("hash", "keep_id")

    # All joins shuffle both sides anew, or a large group's texts would follow the aggregated
    # hash into one task.
    members = stored(join_afresh(rows, several, ["hash"], "inner", step=2), "members")
    first = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("hash")
    first = first.agg(F.min("text").alias("kept_text"))
    differing = join_afresh(members, first, ["hash"], "inner", step=3).where("text != kept_text").select("hash", "doc_id", "text")
    collided = differing.groupBy("hash", "text").agg(
        F.min("doc_id").alias("other_id"), F.count("*").alias("other_size")
    )
    # Rows of a collision are told apart by their SHA-256, which the result holds anyway.
    collided = stored(
        collided.select("hash", F.sha2("text", 256).alias("text_sha256"), "other_id", "other_size"),
        "collisions",
    )
    fewer = collided.groupBy("hash").agg(F.sum("other_size").alias("gone"))
    groups = groups.join(fewer, "hash", "left").select(
        "hash", "keep_id", (F.col("size") - F.coalesce("gone", F.lit(0))).alias("size")
    )
    found = join_afresh(keyed, groups, ["hash"], "inner", step=1).join(collided, ["hash", "text_sha256"], "left")
    other = F.col("other_size").isNotNull()
    keep = F.when(other, F.col("other_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("other_size", "size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
