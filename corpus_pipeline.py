"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet and
read again before the next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import stored, table, text_or_empty
from marketloom.llm.decontaminate import contaminated_rows, row_key
from marketloom.llm.mixing import mix_sources
from marketloom.llm.near_dedup import representatives
from marketloom.llm.quality import quality_filter
from marketloom.llm.sharding import shard_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame, *keys: Column) -> DataFrame:
    """All columns of each row under the one name ``row``, and the keys; so no name of a stage's own meets one of the input's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)


def _plain(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select("doc_id", "text", *columns)


def _key(*branch: str) -> list[Column]:
    """What tells rows apart: the id, a hash of the text, and the names of the branch."""
    return [F.col("doc_id").cast("long").alias("id"), F.md5(text_or_empty()).alias("hash"), *[F.coalesce(F.col(c), F.lit("und")).alias(c) for c in branch]]


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps, with all their columns.

    A document is judged by its own text alone: rows equal in text stay or go together, a null text counts as an empty one, long texts go
    whole.  Where there is nothing to train on, every score is 0.  An empty table stays empty.  Ties at the threshold stay.
    """
    return quality_filter(_packed(docs, F.col("doc_id"), F.col("text"))).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (Jaccard similarity of 5-word shingles of 0.8 or more, and what that reaches): the
    smallest id (null last), then the smallest hash of the text.

    Null, empty and blank texts are one group.  Rows count as the same only where both id and text are equal, so null or repeated ids cost no
    text; of rows equal in both one stays.  Texts go whole.  An empty table stays empty.
    """
    kept = representatives(_plain(docs)).select(F.col("doc_id").alias("id"), F.col("_text").alias("hash"))
    rows = _packed(docs, *_key())
    return rows.join(kept, _same(rows, kept, ["id", "hash"]), "left_semi").dropDuplicates(["id", "hash"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window; of rows with one id, only those whose text has one go.

    Null texts have no words and stay; equal rows stay or go together; texts go whole; an empty table or benchmark removes nothing.
    """
    hit = contaminated_rows(_plain(docs), table(spark, sf_dir, "benchmark"))
    return _packed(docs, *row_key()).join(hit, ["_id", "_th"], "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix, repeated for each epoch that includes them.

    A null lang or source is the branch ``und``; texts without tokens (null, empty) are in no mix; long texts go whole.  Rows equal in id, text, lang
    and source are interchangeable and share their copies as evenly as they divide; ties in the shuffle are broken by id and hash.
    An empty table stays empty.
    """
    names = ["id", "hash", "lang", "source"]
    taken = mix_sources(_plain(docs, "lang", "source")).select(F.col("doc_id").cast("long").alias("id"), F.col("_text").alias("hash"), "lang", "source", "copies")
    taken = taken.groupBy(*names).agg(F.sum("copies").alias("copies"))
    rows = _packed(docs, *_key("lang", "source"))
    equal = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    shares = stored(taken.join(equal, _same(taken, equal, names)).select(*[taken[c] for c in names], "copies", "n"), "pipeline-shares")
    found = rows.join(shares, _same(rows, shares, names)).select("row", *[shares[c] for c in names], "copies", "n")
    even = found.where("copies % n = 0").select("row", (F.col("copies") / F.col("n")).cast("int").alias("times"))
    # a key whose copies do not divide is where a leaf's last epoch ends inside equal rows: one key a leaf at most
    turn = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    uneven = found.where("copies % n <> 0").select("row", F.expr("copies div n").alias("all"), F.expr("copies % n").alias("more"), turn.alias("turn"))
    uneven = uneven.select("row", (F.col("all") + (F.col("turn") <= F.col("more")).cast("int")).cast("int").alias("times"))
    return even.unionByName(uneven).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document (law ``bytes``); the columns of the input are not returned.

    Groups of equal texts, null as empty, stay together and in the order of their smallest id; equal rows have a slot each; texts count
    whole; an empty table gives no rows.
    """
    return shard_documents(_plain(docs))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier's training is not expressible in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
