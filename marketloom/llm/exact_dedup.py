"""Exact de-duplication with skew-safe combining, in DataFrame functions only.

Texts are equal if they are identical after A-Z has been lower-cased.  Three stages find the groups, and each of them compares
whole texts, since the text is a grouping key beside its digest:

1. locally: Spark's map-side aggregation leaves one row per text and input partition;
2. the local rows of a text meet per salt (the input partition's number modulo ``salts``), so that a text which a third of all rows
   hold, or which every partition holds, is merged by several tasks;
3. the winners of the salts are combined per text: at most ``salts`` rows.

Texts then stay behind: each row finds its group by the digest.  Where one digest stands for several texts (counted in stage 3),
its rows are joined by digest and text, so a collision joins nothing.  The row with the largest doc_id stays.

Defined cases: a null text is an empty one; a null doc_id is smaller than any other, and ``keep_id`` is null where a group has no other;
of rows equal in id and text exactly one is kept (the first in the written result); texts of any length go whole; an empty table gives
an empty result; further input columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored, text_or_empty

SALTS = 8


def normalised() -> Column:
    """The text with A-Z lower-cased, and nothing else."""
    text = text_or_empty()
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_groups(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: _digest, _norm (the text), keep_id, group_size."""
    rows = docs.select("doc_id", normalised().alias("_norm")).select("doc_id", "_norm", digest(F.col("_norm")).alias("_digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    merged = rows.groupBy("_digest", "_norm", "_salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return merged.groupBy("_digest", "_norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = text_groups(docs, digest, salts)
    variants = F.count(F.lit(1)).alias("_texts")
    sole = groups.groupBy("_digest").agg(variants, F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    sole = stored(sole, "exact-groups")
    rows = docs.select("doc_id", normalised().alias("_norm"), F.monotonically_increasing_id().alias("_spread"))
    rows = rows.select("doc_id", digest(F.col("_norm")).alias("_digest"), F.sha2("_norm", 256).alias("text_sha256"), "_norm", "_spread")
    found = salted_join(rows.drop("_norm"), sole.where("_texts = 1"), "_digest", "_spread", salts).select("doc_id", "keep_id", "group_size", "text_sha256")
    shared = sole.where("_texts > 1").select("_digest")
    if not shared.isEmpty():  # several texts under one digest: they are told apart by their content
        several = groups.join(shared, "_digest", "left_semi")
        rest = rows.join(shared, "_digest", "left_semi")
        found = found.unionByName(salted_join(rest, several, ["_digest", "_norm"], "_spread", salts).select("doc_id", "keep_id", "group_size", "text_sha256"))
    found = stored(found.withColumn("_row", F.monotonically_increasing_id()), "exact-rows")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256").agg(F.min("_row").alias("_row"))
    out = found.join(first.select("_row", F.lit(True).alias("_first")), "_row", "left")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce("_first", F.lit(False)).alias("kept"), "text_sha256")


EXACT_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""
