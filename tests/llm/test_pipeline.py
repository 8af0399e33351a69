"""The pipeline's stages, each on what the one before it kept, against brute force."""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm.quality import quality_scores

from .test_near_dedup import groups
from .test_text_ops import brute_contamination

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        old, new = [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]
        if name != "shard":
            assert after.columns == docs.columns and new
            assert {(r["doc_id"], r["text"]) for r in new} <= {(r["doc_id"], r["text"]) for r in old}
        if name == "quality":
            assert {r["doc_id"] for r in new} == {r.doc_id for r in quality_scores(before).collect() if r.keep} and len(new) < len(old)
        if name == "near_dedup":
            assert sorted(r["doc_id"] for r in new) == sorted(set(groups({r["doc_id"]: r["text"] for r in old}).values()))
        if name == "decontaminate":
            dirty = {int(r[0]) for r in brute_contamination([(r["doc_id"], r["text"]) for r in old], items) if r[5]}
            assert {r["doc_id"] for r in new} == {r["doc_id"] for r in old} - dirty
        if name == "mix":
            assert max(sum(r["doc_id"] == x["doc_id"] for r in new) for x in new) <= 2
        if name == "shard":
            assert sorted(r["doc_id"] for r in new) == sorted(r["doc_id"] for r in old) and {r["shard"] for r in new} == set(range(16))
        before = after


def test_stages_take_nulls_repeats_and_extra_columns(spark, tmp_path):
    rows = [(i, f"A plain sentence about topic number {i} with several words in it.", "en", "src1", 9, "x") for i in range(30)] + [(None, "Null id but a plain sentence here.", None, None, None, None), (3, None, "en", "src2", 0, "y"), (4, "A plain sentence about topic number 4 with several words in it.", "en", "src1", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_null_and_repeated_ids_cost_no_text(spark):
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(8)]
    ids = [None, None, None, 5, 5, 5, 6, 7]  # every text is its own group
    rows = list(zip(ids, own)) + [(None, own[0]), (5, own[3]), (9, own[4]), (2, own[7]), (None, None), (None, "")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    want = [(None, own[0]), (None, own[1]), (None, own[2]), (5, own[3]), (5, own[4]), (5, own[5]), (6, own[6]), (2, own[7]), (None, "")]
    assert kept.columns == ["doc_id", "text"] and sorted(got, key=str) == sorted(want, key=str)


def test_a_contaminated_row_takes_only_its_own_text(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    clean = [(i, f"clean text {n} with words of its own") for n, i in enumerate([None, None, 4, 4, 8])]
    rows = [*clean, (None, f"before {item} after"), (4, f"again {item} here"), (4, f"again {item} here")]
    left = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert left.columns == ["doc_id", "text"] and sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, clean))


def test_no_column_of_the_input_meets_one_of_a_stages_own(spark, tmp_path):
    """Every name that a stage or an operator uses, as an extra column, changes nothing and comes back with its values."""
    root = Path(corpus_pipeline.__file__).parent
    code = "".join(p.read_text() for p in [*(root / "marketloom" / "llm").glob("*.py"), root / "corpus_pipeline.py"])
    own = ("doc_id", "text", "lang", "source", "n_chars")
    names = sorted({n.lower() for n in re.findall(r"[\"' ,(]([A-Za-z_]\w{0,24})[\"',). ]", code)} - set(own))
    assert {"_mixed", "_epoch", "copies", "_id", "_th", "_kept", "_text", "row", "id", "hash", "cls"} & set(names) and len(names) > 200
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        wide = docs.select("*", *[F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for i, n in enumerate(names)])
        stage(spark, wide, SF).write.parquet(str(tmp_path / f"{name}-wide"))
        got = spark.read.parquet(str(tmp_path / f"{name}-wide"))
        if name != "shard":
            assert got.columns == [*docs.columns, *names], name
            wrong = [F.col(f"`{n}`") != F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")) for i, n in enumerate(names)]
            assert got.where(F.exists(F.array(*wrong), lambda x: x)).isEmpty(), name
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs_after = spark.read.parquet(str(tmp_path / name))
        plain = sorted(map(str, docs_after.collect()))
        assert sorted(map(str, got.select(*docs_after.columns).collect())) == plain and plain, name
        docs = docs_after


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "same text " * 20, "en", "src1", 1)] * 5 + [(i, f"other text {i} " * 20, "en", "src1", 1) for i in range(2, 9)] + [(1, "same text " * 20, "de", None, 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix(spark, docs, SF)
    from marketloom.llm.mixing import mix_sources

    want = {}
    for r in mix_sources(docs).collect():
        want[r.doc_id, r.lang] = want.get((r.doc_id, r.lang), 0) + r.copies
    have = {}
    for r in got.collect():
        have[r.doc_id, r.lang] = have.get((r.doc_id, r.lang), 0) + 1
    assert have == want and got.columns == docs.columns
