"""Small hand-computed cases: what the SQL twins cannot show, because they are written beside the queries."""

import datetime
import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import portfolio as pf
from marketloom.operators.asof import asof_forward
from marketloom.operators.evaluation import drift
from marketloom.operators.options import chain_measures, nearest_expiry
from marketloom.operators.recursive import smooth
from marketloom.operators.vectors import nearest_vectors
from marketloom.plans.altdata import blended_sentiment
from marketloom.plans.rules import enabled_blocks, feature_columns, has_skill, listed, with_regime
from marketloom.plans.text import narrative, parsed_verdict, redacted
from marketloom.sources import feeds
from marketloom.sources.files import KeyedTable, append, copy_since
from marketloom.streaming import jobs

DAY = datetime.date(2024, 1, 1)


def days(n):
    return DAY + datetime.timedelta(days=n)


def test_leverage_of_quiet_returns_is_one(spark):
    flat = spark.createDataFrame([(days(i), 0.01) for i in range(14)], "date date, r double")
    assert {(r.leverage, r.scaled) for r in pf.vol_target(flat, "r", 0.05).collect()} == {(1.0, 0.01)}
    x = [0.01 * (-1) ** i for i in range(12)] + [0.5, 0.02]
    got = [r.leverage for r in pf.vol_target(spark.createDataFrame([(days(i), v) for i, v in enumerate(x)], "date date, r double"), "r", 0.02).orderBy("date").collect()]
    want = [1.0 if i < 10 else min(3.0, 0.02 / np.std(x[:i], ddof=1)) for i in range(len(x))]
    assert got[:10] == [1.0] * 10 and np.allclose(got, want) and got[-1] < 0.2  # the jump only shows after it


def test_drift_by_accuracy_or_calibration(spark):
    rows = [("low", int(i % 10 < 4), 0.62) for i in range(250)] + [("few", 0, 0.62) for _ in range(199)] + [("good", int(i % 10 < 6), 0.62) for i in range(250)] + [("sure", int(i % 10 < 6), 0.95) for i in range(200)]
    got = {r.symbol: r for r in drift(spark.createDataFrame(rows, "symbol string, correct int, p double"), ["symbol"], "correct", "p").collect()}
    assert got["low"].drift and abs(got["low"].accuracy - 0.4) < 1e-9 and abs(got["low"].ece - 0.22) < 1e-9
    assert not got["few"].drift and got["few"].accuracy is None and got["few"].ece is None
    assert not got["good"].drift and abs(got["good"].ece - 0.02) < 1e-9
    assert got["sure"].drift and got["sure"].accuracy >= 0.48  # by calibration alone


def test_sentiment_without_general_news_keeps_all_symbols(spark):
    symbols = spark.createDataFrame([("A",), ("B",), ("ALL",)], "symbol string")
    sums = spark.createDataFrame([("A", 2.0, 4.0, 3)], "symbol string, ws double, w double, n long")
    got = {r.symbol: (r.sentiment, r.label, r.n) for r in blended_sentiment(symbols, sums, "ALL").collect()}
    assert got == {"A": (0.5, "bullish", 3), "B": (0.0, "neutral", 0)}
    both = sums.unionByName(spark.createDataFrame([("ALL", -3.0, 3.0, 2)], sums.schema))
    got = {r.symbol: (r.sentiment, r.label, r.n) for r in blended_sentiment(symbols, both, "ALL").collect()}
    assert got == {"A": (round(1 / 11, 6), "neutral", 5), "B": (-1.0, "bearish", 2)}


def test_secrets_are_masked(spark):
    lines = [
        ("GET https://x/q?symbol=A&token=abc123&limit=5", "GET https://x/q?symbol=A&token=***&limit=5"), ("ApiKey=K1 API_KEY='x' end", "ApiKey=*** API_KEY='x' end"),
        ('url "x_cg_demo_api_key=9" and x_cg_pro_api_key=8<br>', 'url "x_cg_demo_api_key=***" and x_cg_pro_api_key=***<br>'), ("plain text, mytoken=5 tokens=3", "plain text, mytoken=5 tokens=3"), (None, None),
    ]
    got = spark.createDataFrame(lines, "a string, b string").select(redacted(F.col("a")).alias("a"), "b").collect()
    assert all(r.a == r.b for r in got)


def test_verdicts_are_parsed(spark):
    rows = [("BTC — model says UP @ 70% (regime trend). Verifier: VETO → final 35%. News is bad.\nVery. Risk: gaps, halts\nmore",), ("BTC — model says DOWN @ 5% (regime ). Verifier: agree → final 5%.  Risk: ",), ("nothing",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "line string").coalesce(1).select(*parsed_verdict(F.col("line"))).collect()]
    assert got[0] == ("UP", 70, "trend", "VETO", 35, "News is bad.\nVery.", "gaps, halts\nmore")
    assert got[1] == ("DOWN", 5, "", "agree", 5, "", "") and got[2] == got[3] == (None,) * 7


def test_price_sentences(spark):
    rows = [("Bitcoin", "BTC", 64000.5, -2.345, 1.26e12, "crypto"), (None, "X", 1.0, None, None, None), ("Y", "Y", 2.00005, 0.125, 0.0, "etf")]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, s string, p double, c double, m double, k string").coalesce(1).select(narrative(*map(F.col, "nspcmk"))).collect()]
    assert got[0] == "Bitcoin (BTC) is trading at 64000.5000, 2.34% down in 24h. Market cap: $1260.0B. Asset type: crypto."
    assert got[1] == "X (X) is trading at 1.0000, 0.00% up in 24h. Asset type: unknown." and "0.12% up" in got[2]


def test_keyed_table_is_found_again(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "symbol string, day int, price double"
    new = lambda: KeyedTable(spark, path, ["symbol", "day"], schema, buckets=4)
    assert new().read().count() == 0
    first = [(f"S{i}", 1, float(i)) for i in range(20)]
    new().upsert(spark.createDataFrame(first, schema), [F.col("price")])
    new().upsert(spark.createDataFrame([("S3", 1, 33.0), ("S3", 1, 34.0), ("T", 2, 1.0)], schema), [F.desc("price")])
    want = {(s, d): p for s, d, p in first} | {("S3", 1): 34.0, ("T", 2): 1.0}
    rows = lambda: {(r.symbol, r.day): r.price for r in new().read().collect()}
    assert rows() == want and new().read().count() == 21
    new().insert_ignore(spark.createDataFrame([("S3", 1, 0.0), ("U", 1, 5.0), ("U", 1, 6.0)], schema), [F.col("price")])
    assert rows() == want | {("U", 1): 5.0}
    (tmp_path / "t" / "v=99").mkdir()  # a version without its marker does not count
    new().prune(F.col("day") == 1)
    assert rows() == {k: v for k, v in (want | {("U", 1): 5.0}).items() if k[1] == 1}
    new().prune(F.lit(False))
    assert new().read().count() == 0
    new().vacuum()
    assert new().read().count() == 0 and sum(p.name.startswith("v=") for p in (tmp_path / "t").iterdir()) == 2


def test_retention_of_no_days_keeps_all(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], "id int, day date")
    t.upsert(spark.createDataFrame([(i, days(i)) for i in range(10)], "id int, day date"), [F.col("id")])
    for keep in (0, -3):
        t.prune_older("day", F.lit(days(9)), keep)
        assert t.read().count() == 10
    t.prune_older("day", F.lit(days(9)), 4)
    assert sorted(r.id for r in t.read().collect()) == [5, 6, 7, 8, 9]


def test_copies_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([("A", days(0), 1.0), ("A", days(5), 2.0), ("B", days(6), 3.0)], "symbol string, date date, close double")
    t = KeyedTable(spark, str(tmp_path / "t"), ["symbol", "date"], "symbol string, date date, close double")
    dry = copy_since(rows, t, "date", "2024-01-03", [F.col("close")])
    assert {(r.symbol, r.n) for r in dry.collect()} == {("A", 1), ("B", 1)} and t.read().count() == 0
    copy_since(rows, t, "date", "2024-01-03", [F.col("close")], apply=True)
    assert t.read().count() == 2
    for _ in range(2):
        append(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_next_row_at_or_after(spark):
    left = spark.createDataFrame([("A", 1), ("A", 3), ("A", 5), ("B", 1)], "k string, t int")
    right = spark.createDataFrame([("A", 3, "x"), ("A", 4, None), ("A", 2, "w")], "k string, t int, v string")
    got = {(r.k, r.t): r.v for r in asof_forward(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("A", 1): "w", ("A", 3): "x", ("A", 5): None, ("B", 1): None}


def test_smoothing_equals_the_recursion():
    x = [np.nan, 1.0, np.nan, 4.0, 2.0, np.nan, np.nan, 8.0]
    want, mean, old = [], np.nan, 1.0
    for v in x:
        if v == v:
            if mean != mean:
                mean, old = v, 1.0
            else:
                old *= 0.7
                mean, old = (old * mean + 0.3 * v) / (old + 0.3), 1.0
        elif mean == mean:
            old *= 0.7
        want.append(mean)
    assert np.allclose(smooth(np.array(x), 0.3), want, equal_nan=True)
    assert np.isnan(smooth(np.array(x), 0.3, 3)[:4]).tolist() == [True, True, True, True] and smooth(np.array(x), 0.3, 3)[4] == pytest.approx(want[4])


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, rng.normal(size=8).tolist()) for i in range(240)] + [(500, 0, [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, collection int, embedding array<double>")
    want = set()
    for i, _, q in rows[::100]:
        for kind in range(3):
            own = sorted((-round(float(np.dot(q, e) / np.linalg.norm(q) / np.linalg.norm(e)), 6), j) for j, c, e in rows if c == kind and j not in (i, 500))[:4]
            want |= {(i, j, kind, -s) for s, j in own}
    for blocks in ((20_000, 2_000), (50, 1)):
        got = nearest_vectors(v, v.where("vec_id % 100 = 0 and vec_id < 500"), 4, *blocks).collect()
        assert {(r.query_id, r.vec_id, r.collection, r.score) for r in got} == want


def test_options_by_hand(spark):
    schema = "symbol string, side string, expiry date, strike double, iv double, bid double, open_interest int, id int"
    near, far = days(30), days(88)
    rows = [
        ("A", "call", near, 100.0, 0.5, 1.0, 0, 1), ("A", "put", near, 101.0, 0.7, None, 4, 2), ("A", "put", near, 90.0, 0.9, 1.0, 0, 3), ("A", "call", near, 110.0, 0.4, 1.0, 0, 4), ("A", "call", near, 100.0, 1e-5, 1.0, 1, 5),
        ("A", "call", near, 100.0, 0.1, 0.0, 0, 6), ("A", "call", far, 99.0, 0.8, 2.0, None, 7), ("B", "call", near, 10.0, 9.0, 1.0, 1, 8), ("C", "call", days(-3), 10.0, 0.5, 1.0, 1, 9), ("D", "put", near, 10.0, 0.3, 1.0, 1, 10),
    ]
    chain = spark.createDataFrame(rows, schema)
    spots = spark.createDataFrame([("A", 100.0), ("B", 10.0), ("C", 10.0), ("D", 10.0)], "symbol string, spot double")
    got = {r.symbol: r for r in chain_measures(chain, spots, F.lit(DAY)).collect()}
    assert set(got) == {"A", "D"} and got["A"].n_contracts == 4 and (got["A"].near, got["A"].far) == (near, far)
    assert got["A"].atm_iv == pytest.approx(0.6) and got["A"].skew == pytest.approx(0.5) and got["A"].term_slope == pytest.approx(0.2)
    assert got["D"].atm_iv == pytest.approx(0.3) and got["D"].skew is None and got["D"].term_slope is None
    dates = spark.createDataFrame([("A", days(n)) for n in (-1, 0, 20, 40, 41)], "symbol string, expiry date")
    assert nearest_expiry(dates, F.lit(DAY), 30).first().expiry == days(20) and nearest_expiry(dates, F.lit(DAY), 31).first().expiry == days(40)


def test_regimes_have_a_default(spark):
    events = spark.createDataFrame([(1, days(0)), (2, days(3)), (3, days(9)), (4, days(3))], "id int, date date")
    regimes = spark.createDataFrame([(days(2), "chop"), (days(9), "risk_off")], "date date, regime string")
    assert {(r.id, r.regime) for r in with_regime(events, regimes).collect()} == {(1, "trend"), (2, "chop"), (3, "risk_off"), (4, "chop")}
    assert {r.regime for r in with_regime(events, regimes.limit(0)).collect()} == {"trend"}


def test_lists_columns_blocks_and_skill(spark):
    df = spark.createDataFrame([("a", 1), ("S7", 2), ("s13", 3), (None, 4)], "symbol string, id int")
    assert sorted(r.id for r in listed(df).collect()) == [1, 4]
    assert feature_columns(spark.range(1).selectExpr("id as symbol", "1 as date", "1 as open", "1 as rsi", "1 as ffd_order")) == ["rsi"]
    assert enabled_blocks() == ["price"] and enabled_blocks({"USE_EQUITY": "1", "USE_MACRO": "yes"}) == ["price", "equity"]
    rows = spark.createDataFrame([(0.9, 1.0), (1.0, 1.0), (1.2, 1.0), (None, 1.0), (0.0, 1.0), (0.5, 0.0)], "m double, n double").coalesce(1)
    assert [r[0] for r in rows.select(has_skill(F.col("m"), F.col("n"))).collect()] == [True, False, False, False, False, False]


def test_feed_readers_take_what_files_hold(spark, tmp_path):
    (tmp_path / "funding_btc.csv").write_text("calc_time,funding_interval_hours,last_funding_rate\n1704067200000,8,0.001\n1704096000000,8,0.002\n1704153600000,8,bad\n,8,0.5\n1704153600001,8,0.004\n")
    assert {(r.symbol, r.date, round(r.funding, 9), r.funding_last) for r in feeds.funding(spark, str(tmp_path)).collect()} == {("BTC", days(0), 0.003, 0.002), ("BTC", days(1), 0.004, 0.004)}
    for name, body in {"hash-rate.csv": "2024-01-01 00:00:00,5\n2024-01-04 00:00:00,x\n", "n-transactions.csv": "2024-01-02,7\n2024-01-02,8\n", "n-unique-addresses.csv": "soon,1\n2024-01-03,2\n", "transaction-fees.csv": "2024-01-04,3\n"}.items():
        (tmp_path / name).write_text(body)
    got = [tuple(r)[1:] for r in feeds.chain_health(spark, str(tmp_path)).orderBy("date").collect()]
    assert [g[0] for g in got] == [days(i) for i in range(4)] and got[-1] == (days(3), 5.0, got[1][2], 2.0, 3.0) and got[1][2] in (7.0, 8.0) and got[0][1:] == (5.0, None, None, None)
    (tmp_path / "fng.json").write_text(json.dumps({"name": "x", "data": [{"value": "40", "value_classification": "Fear", "timestamp": "1704067200"}, {"value": "n", "timestamp": "1704153600"}, {"value": "1", "timestamp": None}]}, indent=1))
    assert {tuple(r) for r in feeds.fear_greed(spark, str(tmp_path / "fng.json")).collect()} == {(days(0), 40.0, "Fear"), (days(1), None, None)}
    (tmp_path / "feed.json").write_text(json.dumps({"feed": [{"time_published": "20240101T093000", "ticker_sentiment": [{"ticker": "aapl", "relevance_score": "0.5", "ticker_sentiment_score": "0.2"}, {"ticker": "MSFT", "relevance_score": "0", "ticker_sentiment_score": "0.4"}]}, {"time_published": "20240101T100000", "ticker_sentiment": [{"ticker": "AAPL", "relevance_score": "1.0", "ticker_sentiment_score": "-0.1"}]}, {"time_published": "", "ticker_sentiment": None}]}))
    got = {r.symbol: (r.date, round(r.av_sent, 9), r.av_relevance, r.av_n) for r in feeds.news_sentiment(spark, str(tmp_path / "feed.json")).collect()}
    assert got == {"AAPL": (days(0), 0.0, 0.75, 2), "MSFT": (days(0), 0.4, 0.0, 1)}


DAY_TS = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def put(df, folder, number):
    """One more file in a stream's folder, later than those before."""
    before = set(Path(folder).glob("part-*")) if Path(folder).exists() else set()
    df.coalesce(1).write.mode("append").parquet(folder)
    for new in set(Path(folder).glob("part-*")) - before:
        os.utime(new, (1_700_000_000 + 10 * number,) * 2)


def test_limiter_over_several_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    batches = [[(1, 0), (2, 10), (3, 20)], [(4, 30), (5, 59)], [(6, 61), (7, 75)]]
    for n, rows in enumerate(batches):
        put(spark.createDataFrame([(i, "A", DAY_TS + datetime.timedelta(seconds=s)) for i, s in rows], "id long, symbol string, ts timestamp"), folder, n)
    stream = spark.readStream.schema("id long, symbol string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r.id: (r.admitted, r.retry) for r in jobs.drain(jobs.limited(stream, "symbol", 3, 60.0), "limit").collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (True, None), 4: (False, 30), 5: (False, 1), 6: (True, None), 7: (True, None)}


def test_streams_keep_state_across_batches(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "id long, symbol string, ts timestamp, price double"
    at = lambda minutes: DAY_TS + datetime.timedelta(minutes=minutes)
    files = [[(1, "A", at(1), 10.0), (2, "A", at(30), 12.0)], [(3, "A", at(50), 9.0), (4, "B", at(5), 1.0)], [(5, "A", at(3000), 20.0)], [(7, "B", at(3001), 2.0)], [(6, "A", at(40), 99.0)]]  # the last comes after the watermark
    for n, rows in enumerate(files):
        put(spark.createDataFrame(rows, schema), folder, n)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    bars = {(r.symbol, r.start.day): (r.open, r.high, r.low, r.close, r.n) for r in jobs.drain_upserts(jobs.bars_from_ticks(stream()), "bars", ["symbol", "start"]).collect()}
    assert bars == {("A", 1): (10.0, 12.0, 9.0, 9.0, 3), ("B", 1): (1.0, 1.0, 1.0, 1.0, 1), ("A", 3): (20.0, 20.0, 20.0, 20.0, 1), ("B", 3): (2.0, 2.0, 2.0, 2.0, 1)}
    levels = spark.createDataFrame([("A", 11.0, "above"), ("A", 5.0, "below")], "symbol string, level double, direction string")
    fired = jobs.drain(jobs.alerts_once(stream(), levels), "alerts").collect()
    assert [(r.symbol, r.level, r.price, r.id) for r in fired] == [("A", 11.0, 12.0, 2)]  # once, though three later batches cross it again
    once = jobs.drain(jobs.deduplicated(stream(), ["symbol"]).select("symbol", "id"), "dedupe").collect()
    assert {(r.symbol, r.id) for r in once} == {("A", 1), ("B", 4)}


def test_empty_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.schema("id long, symbol string, ts timestamp, price double").parquet(str(tmp_path / "in"))
    assert jobs.drain_upserts(jobs.bars_from_ticks(stream()), "bars", ["symbol", "start"]).count() == 0
    assert jobs.drain_complete(jobs.sessions(stream()), "sessions").count() == 0
    assert jobs.drain(jobs.limited(stream(), "symbol", 3, 60.0), "limit").count() == 0


def test_leg_weights_by_hand(spark):
    rows = [("a", "A", 0.60, 0.02), ("a", "B", 0.70, 0.04), ("a", "C", 0.45, 0.01), ("b", "A", 0.5, 0.1), ("b", "B", 0.5, 0.1), ("c", "A", None, None), ("c", "B", 0.9, 0.2), ("c", "C", 0.2, 0.4)]
    df = spark.createDataFrame(rows, "date string, symbol string, meta double, vol double")
    got = {(r.date, r.symbol): r.weight for r in pf.leg_weights(df).collect()}
    tilt = [0.05 / 0.02, 0.10 / 0.04, 0.075 / 0.01]  # C has no edge and takes the mean share
    assert [got["a", s] for s in "ABC"] == pytest.approx([t / sum(tilt) for t in tilt]) and got["b", "A"] == pytest.approx(0.5)
    tilt = [0.2 / 0.3, 0.2 / 0.2, 0.2 / 0.4]  # A takes the median volatility
    assert [got["c", s] for s in "ABC"] == pytest.approx([t / sum(tilt) for t in tilt])


def test_simulated_period_by_hand(spark):
    rows = [(days(0), f"S{i}", r, 1.0, i % 2, 0.5, 0.1, "chop", s) for i, (r, s) in enumerate(zip([0.10, 0.02, 0.01, 0.0, -0.01, -0.02, -0.04, -0.06, 0.03, 0.05], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]))]
    p = spark.createDataFrame(rows, "date date, symbol string, ret double, beta double, sector int, meta double, vol double, regime string, score int")
    dates = p.select("date").distinct()
    raw = pf.simulate(p, dates).first()
    assert raw.ret == pytest.approx(0.6 * (0.5 * (0.06 - 0.0005) + 0.5 * (-0.04 - 0.0005))) and (raw.breadth, raw.n_leg) == (10, 2)
    mean = sum(r[2] for r in rows) / 10
    hedged = pf.simulate(p, dates, mode="market", use_regime=False).first()
    assert hedged.ret == pytest.approx(0.5 * (0.06 - mean - 0.0005) + 0.5 * (mean - 0.04 - 0.0005))
    assert pf.simulate(p, dates, long_short=False, use_regime=False).first().ret == pytest.approx(0.06 - 0.0005)


def test_streams_without_losses_have_an_infinite_profit_factor(spark):
    p = pf.performance(spark.createDataFrame([("A", i, 0.01) for i in range(3)] + [("B", i, x) for i, x in enumerate([0.1, -0.05])], "s string, t int, x double"), "x", ["s"], "t", 4.0)
    got = {r.s: r for r in p.collect()}
    assert got["A"].profit_factor == float("inf") and got["B"].profit_factor == pytest.approx(2.0) and got["B"].annual_return == pytest.approx(1.025**4 - 1)


def test_holdings_need_a_quote_and_a_rate(spark):
    from marketloom.operators.ledger import positions, valued

    trades = [("u", "A", "BUY", 10.0, 2.0, days(0), 1), ("u", "A", "SELL", 4.0, 3.0, days(1), 2), ("u", "B", "BUY", 1.0, 5.0, days(0), 3), ("u", "C", "BUY", 1.0, 5.0, days(0), 4), ("u", "D", "BUY", 1.0, 5.0, days(0), 5), ("u", "D", "SELL", 9.0, 5.0, days(2), 6)]
    h = positions(spark.createDataFrame(trades, "user_id string, symbol string, side string, quantity double, price double, trade_date date, seq int"))
    h = h.withColumn("currency", F.when(F.col("symbol") == "A", "USD").when(F.col("symbol") == "B", "INR").otherwise("EUR"))
    quotes = spark.createDataFrame([("A", 3.0), ("C", 9.0), ("B", 720.0)], "symbol string, last double")
    got = {r.symbol: r for r in valued(h, quotes, spark.createDataFrame([("USD", 80.0), ("INR", 1.0)], "currency string, rate double")).collect()}
    assert set(got) == {"A", "B", "C"} and got["A"].quantity == 6.0 and got["A"].value == 1440.0 and got["A"].cost == pytest.approx(12.0)
    assert got["A"].weight == pytest.approx(100 * 1440 / 2160) and got["C"].value is None and got["C"].weight is None


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_batch_of_one_day_rewrites_that_days_cells_alone(spark, tmp_path):
    path, schema = tmp_path / "t", "symbol string, day date, price double"
    table = lambda: KeyedTable(spark, str(path), ["symbol", "day"], schema, buckets=2, part=F.col("day"))
    rows = [(f"S{i}", days(d), float(i)) for d in range(5) for i in range(10)] + [(None, None, 1.0)]
    table().upsert(spark.createDataFrame(rows, schema), [F.col("price")])
    before = _files(path)
    table().upsert(spark.createDataFrame([("S1", days(3), 50.0), ("NEW", days(3), 1.0)], schema), [F.col("price")])
    after = _files(path)
    assert all(after[name] == t for name, t in before.items())  # nothing old is touched
    new = [name for name in after if name not in before]
    assert new and all(f"_part={days(3)}" in name for name in new)
    want = {(s, d): p for s, d, p in rows} | {("S1", days(3)): 50.0, ("NEW", days(3)): 1.0}
    assert {(r.symbol, r.day): r.price for r in table().read().collect()} == want
    plan = table()._rows({("2024-01-04", 0): 1})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(concat_ws(|, _part" in plan.replace("concat_ws(|, _part#", "(concat_ws(|, _part#").replace("((", "(")  # cells that are not asked for are not opened


def test_old_versions_are_folded_and_removed(spark, tmp_path):
    path, schema = tmp_path / "t", "k int, day int, v int"
    table = KeyedTable(spark, str(path), ["k", "day"], schema, buckets=1, part=F.col("day"), versions=3)
    want = {}
    for i in range(1, 10):
        batch = [(i, i, i), (0, 0, 100 + i)]
        table.upsert(spark.createDataFrame(batch, schema), [F.col("v")])
        want |= {(k, d): v for k, d, v in batch}
        assert {(r.k, r.day): r.v for r in table.read().collect()} == want
        assert len(set(table._state()[1].values())) <= 4
    assert len(table._versions()) <= 8
    table.vacuum()
    assert len(table._versions()) == 1 and {(r.k, r.day): r.v for r in table.read().collect()} == want


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k int, v int", buckets=2)
    row = lambda v: spark.createDataFrame([(1, v)], "k int, v int")
    assert table.upsert(row(1), [F.col("v")], ("s", 0)) and table.last_batch("s") == 0
    assert table.upsert(row(2), [F.col("v")], ("s", 1))
    versions = table._versions()
    for again in (0, 1):
        assert not table.upsert(row(99), [F.col("v")], ("s", again))
    assert table._versions() == versions and table.read().first().v == 2
    assert table.upsert(row(3), [F.col("v")], ("other", 0)) and table.upsert(row(4), [F.col("v")])
    assert table.last_batch("s") == 1 and table.last_batch("other") == 0 and table.read().first().v == 4
