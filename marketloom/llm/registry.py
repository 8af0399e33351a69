"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import CONTAMINATION_SQL, contamination
from .exact_dedup import EXACT_SQL, exact_duplicates
from .langid import identify
from .line_dedup import LINES_SQL, dedup_lines
from .mixing import MIX_SQL, mix_sources, target_weights
from .near_dedup import near_duplicates
from .parsing import edited_likeness
from .quality import quality_scores
from .sharding import shard_documents
from .spelling import FORMS_SQL, spelling_forms
from .tokens import count_tokens
from .vector_codes import CODES_SQL, vector_codes
from .warc import WARC_SQL, archive_pages


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", F.sha2("clean_text", 256).alias("clean_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=target_weights(spark)).drop("_text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_fingerprints": op6_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {"op2_decontamination": CONTAMINATION_SQL, "op8_line_dedup": LINES_SQL, "op9_mixing": MIX_SQL, "op10_warc": WARC_SQL, "op11_vector_codes": CODES_SQL, "op12_exact_dedup": EXACT_SQL, "op13_spelling": FORMS_SQL}
