"""Cases that a review found wrong: ties, signs, sizes."""

import datetime
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketloom import registry
from marketloom.operators.vectors import best_of
from marketloom.plans import learning, matrix, models
from marketloom.sources import feeds


def twin_of(name, folder, *tables):
    """Rows of the query's SQL over the folder's tables."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(registry.oracle_sql()[name]).fetchall())


def test_of_rates_at_one_time_the_first_in_the_file_is_the_last(spark, tmp_path):
    (tmp_path / "funding_btc.csv").write_text("calc_time,funding_interval_hours,last_funding_rate\n1704067200000,8,0.001\n1704067201000,8,0.005\n1704067201000,8,0.002\n1704067201000,8,0.009\n")
    assert [(r.symbol, r.funding_last) for r in feeds.funding(spark, str(tmp_path)).collect()] == [("BTC", 0.005)]
    (tmp_path / "oi_btc.csv").write_text("create_time,sum_open_interest,sum_open_interest_value,sum_taker_long_short_vol_ratio,sum_toptrader_long_short_ratio\n2024-01-01 00:05:00,1,2,1,1\n2024-01-01 00:10:00,,7,1,1\n2024-01-01 00:10:00,5,8,1,1\n2024-01-01 00:10:00,6,9,1,1\n")
    assert [(r.oi, r.oi_value) for r in feeds.open_interest(spark, str(tmp_path)).collect()] == [(5.0, 7.0)]


def test_feeds_with_many_ticks_at_one_time_equal_their_sql(spark, tmp_path):
    start, i = datetime.datetime(2024, 1, 1), F.col("id")
    ts = F.lit(start) + F.make_dt_interval(F.floor(i / 900).cast("int"), F.lit(0), F.lit(0), F.lit(7))  # one time a day
    e = spark.range(3000, numPartitions=1).select(i.alias("event_id"), ts.cast("timestamp_ntz").alias("ts"), (i % 40).alias("user_id"), F.lit("view").alias("event_type"), ((i * 37 % 1000) / 100).alias("value"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    for name in ("feed_funding", "feed_open_interest"):
        assert sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == twin_of(name, tmp_path, "events")


def test_the_screener_leaves_out_a_loss_that_rounds_to_nothing(spark, tmp_path):
    closes = [1_000_000.0, 999_999.9, 999_999.9, 1_000_000.0]
    lines = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(weeks=k), k, 1, 1, 1, c, 1.0) for k, c in enumerate(closes)]
    spark.createDataFrame(lines, "l_shipdate timestamp_ntz, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "Brand#1")], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in registry.queries()["screener"](spark, str(tmp_path)).collect())
    assert [str(r[1]) for r in got] == ["2024-01-15", "2024-01-22"] and got == twin_of("screener", tmp_path, "lineitem", "part")


def test_a_reply_is_parsed_once(spark, tmp_path):
    spark.range(16).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value").write.parquet(str(tmp_path / "events.parquet"))
    df = registry.queries()["reply_scores"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # the reply and its elements
    assert sorted(tuple(r) for r in df.collect()) == sorted((r[0], r[1], r[2], r[3]) for r in twin_of("reply_scores", tmp_path, "events"))


def test_a_block_of_scores_is_held_in_slices():
    rng = np.random.default_rng(3)

    def block(ids):
        return pd.DataFrame({"vec_id": ids, "collection": (ids % 3).astype("int32"), "embedding": list(rng.integers(-1, 2, (len(ids), 4)).astype("float32"))})  # many ties, some zero vectors

    left, right = block(rng.permutation(20_000)), block(np.arange(0, 30_000, 50))
    tracemalloc.start()
    got = best_of(4)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # one matrix of all scores has 96 MB
    e = {i: v.astype(float) for i, v in zip(left["vec_id"], left["embedding"])}
    rows = {kind: sorted(i for i in e if i % 3 == kind) for kind in range(3)}
    for query, q in list(zip(right["vec_id"], right["embedding"]))[::60]:
        for kind, ids in rows.items():
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.round(np.array([e[i] for i in ids]) @ q.astype(float) / (np.linalg.norm(q.astype(float)) * np.linalg.norm([e[i] for i in ids], axis=1)), 6)
            want = sorted((-s, i) for s, i in zip(score, ids) if i != query and not np.isnan(s))[:4]
            mine = got[(got["query_id"] == query) & (got["collection"] == kind)]
            assert list(zip(-mine["score"], mine["vec_id"])) == want


def test_training_reads_the_lines_once(spark, monkeypatch):
    calls = []
    for module in (learning, models, matrix):
        monkeypatch.setattr(module, "bars", lambda *a, of=module.bars: calls.append(a) or of(*a))
    matrix.wide_events(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    b = learning.stored_bars(spark, "/root/testdata/sf0.001")
    models.features(spark, "/root/testdata/sf0.001", b)
    models.regimes(spark, "/root/testdata/sf0.001", b)
    assert len(calls) == 2
