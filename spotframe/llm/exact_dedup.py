"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z; null counts as empty.

1. Rows are grouped by (digest, whole text, salt).  Spark combines rows within each task
   before the shuffle, and the salt, a hash of doc_id over about one value per
   ``SALT_ROWS`` rows of the table, splits even a group that holds a third of all rows
   into groups whose id lists stay near ``SALT_ROWS`` entries.
2. The salt winners are grouped by (digest, whole text): again combined locally first.
3. Winners hand the result back to their members through the winner's key.

The whole text is a grouping key at both stages; the digest only leads it, so a digest
collision cannot merge two texts.

The row with the largest doc_id stays (null is smallest).  Of rows that repeat a doc_id
and a text one is marked kept.  Texts are compared whole, however long.  A table without
rows gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import fresh, text_of

SALT_ROWS = 20_000


def normalised(column: str = "text") -> Column:
    return F.translate(text_of(column), string.ascii_uppercase, string.ascii_lowercase)


def exact_groups(docs: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept,
    text_sha256."""
    salts = max(16, -(-docs.count() // salt_rows))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("id"),
                       F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(salts)), F.lit(0)).alias("salt"),
                       normalised().alias("body"))
    # no key is null and Spark knows it, so both uses of ``local`` plan the same exchange
    # and the second reuses the shuffled texts of the first
    rows = rows.withColumn("digest", F.coalesce(F.sha2("body", 256), F.lit("")))
    local = rows.groupBy("digest", "body", "salt").agg(F.collect_list("id").alias("ids"))
    local = local.withColumn("winner", F.array_max("ids"))
    best = (local.select("digest", "body", F.struct("winner", "salt").alias("part"), F.size("ids").alias("n"))
            .groupBy("digest", "body")
            .agg(F.max("part.winner").alias("keep"), F.sum("n").alias("group_size"),
                 F.collect_list("part").alias("parts")))
    # one row per salt group; winners are unique within (digest, salt)
    best = (best.select("digest", "keep", "group_size", F.explode("parts").alias("part"))
            .select("digest", "keep", "group_size", "part.winner", "part.salt"))
    members = local.select("digest", "salt", "winner", "ids")
    found = members.join(best, ["digest", "salt", "winner"])
    found = found.withColumn("first", F.array_position("ids", F.col("keep")))
    out = found.select("digest", "keep", "group_size", "first", F.posexplode("ids").alias("at", "id"))
    return out.select(F.col("id.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"),
                      F.col("group_size").cast("long").alias("group_size"),
                      (F.col("at") + 1 == F.col("first")).alias("kept"),
                      F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``docs`` with one row for each distinct text, all its columns as they were."""
    columns = docs.columns
    own_id, own_digest = fresh(columns, "own_id"), fresh(columns, "own_digest")
    # the id as a struct: a null id equals itself, and one partitioning serves both steps
    kept = exact_groups(docs, salt_rows).filter("kept").select(
        F.struct("doc_id").alias(own_id), F.col("text_sha256").alias(own_digest))
    rows = docs.withColumns({own_id: F.struct(F.col("doc_id").cast("long").alias("doc_id")),
                             own_digest: F.sha2(normalised(), 256)})
    stay = rows.join(kept, [own_id, own_digest], "left_semi")
    # only rows that repeat a doc_id and a text remain doubled
    return stay.dropDuplicates([own_id, own_digest]).select(*columns)
