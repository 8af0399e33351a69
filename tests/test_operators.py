"""Operators on small hand-made tables with known results."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.num import add_business_days, clip, finite, safe_div, sig_round
from marketloom.operators import evaluation, labels, portfolio
from marketloom.operators.asof import asof_backward, asof_forward, latest_per_group
from marketloom.operators.fracdiff import fracdiff, weights
from marketloom.operators.ledger import positions
from marketloom.operators.recursive import smooth, smoothed
from marketloom.sources.files import KeyedTable, read_csv, scratch

D = dt.date


def days(n, start=D(2024, 1, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def test_number_functions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (float("inf"), 2.0), (None, 1.0), (123456.0, 4.0)], "a double, b double")
    r = df.select(finite(F.col("a")).alias("f"), safe_div(F.col("a"), F.col("b")).alias("d"), clip(F.col("a"), 0.0, 5.0).alias("c"), sig_round(F.col("a"), 3).alias("s")).collect()
    assert [x.f for x in r] == [1.0, None, None, None, 123456.0]
    assert r[0].d is None and r[3].c is None and r[4].c == 5.0 and r[4].s == 123000.0


@pytest.mark.parametrize("n", [1, 3, 5, 10])
def test_business_days_match_pandas(spark, n):
    ds = days(14)
    got = [r.x for r in spark.createDataFrame([(i, d) for i, d in enumerate(ds)], "i int, d date").orderBy("i").select(add_business_days(F.col("d"), n).alias("x")).collect()]
    assert got == [(pd.Timestamp(d) + pd.offsets.BDay(n)).date() for d in ds]


def test_smoothing_matches_pandas(spark):
    x = np.array([np.nan, 1, 2, np.nan, 4, 5, 3, 8.0])
    s = pd.Series(x)
    np.testing.assert_allclose(smooth(x, 0.3), s.ewm(alpha=0.3, adjust=False).mean(), rtol=1e-12)
    np.testing.assert_allclose(smooth(x, 0.3, 4), s.ewm(alpha=0.3, adjust=False, min_periods=4).mean(), rtol=1e-12)
    df = spark.createDataFrame([("A", d, None if v != v else float(v)) for d, v in zip(days(8), x)], "symbol string, date date, v double")
    got = [r.y for r in smoothed(df, {"y": ("v", 0.3, 0)}).orderBy("date").collect()]
    assert got[0] is None and math.isclose(got[-1], s.ewm(alpha=0.3, adjust=False).mean().iloc[-1])


def test_fractional_difference_of_order_one_is_the_difference(spark):
    w = weights(1.0)
    assert list(w[:2]) == [1.0, -1.0] and len(w) == 2
    df = spark.createDataFrame([("A", d, float(i * i)) for i, d in enumerate(days(5))], "symbol string, date date, v double")
    got = [r.y for r in fracdiff(df, F.col("v"), 1.0, "y").orderBy("date").collect()]
    assert got == [None, 1.0, 3.0, 5.0, 7.0]
    assert len(weights(0.4)) == 200


def test_asof_joins(spark):
    left = spark.createDataFrame([("A", d) for d in days(8)], "k string, t date")
    right = spark.createDataFrame([("A", days(8)[2], 1.0), ("A", days(8)[5], None)], "k string, t date, v double")
    at = lambda df: [r.v for r in df.orderBy("t").collect()]
    assert at(asof_backward(left, right, ["k"], "t", ["v"])) == [None, None, 1.0, 1.0, 1.0, None, None, None]
    assert at(asof_backward(left, right, ["k"], "t", ["v"], strict=True)) == [None, None, None, 1.0, 1.0, 1.0, None, None]
    assert at(asof_backward(left, right, ["k"], "t", ["v"], limit=1)) == [None, None, 1.0, 1.0, None, None, None, None]
    assert at(asof_forward(left, right, ["k"], "t", ["v"])) == [1.0, 1.0, 1.0, None, None, None, None, None]


def test_latest_keeps_ties(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 2, 2), ("A", 2, 3)], "k string, t int, id int")
    assert sorted(r.id for r in latest_per_group(df, ["k"], "t").collect()) == [2, 3]


def test_triple_barrier_by_loop(spark):
    rng = np.random.default_rng(0)
    close, vol, n = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60))), 0.03, 60
    df = spark.createDataFrame([("A", d, float(c), vol) for d, c in zip(days(n), close)], "symbol string, date date, close double, vol double")
    got = {r.date: (r.barrier, r.t1) for r in labels.triple_barrier(df, "vol").collect()}
    assert len(got) == n - 1
    for t in range(n - 1):
        end, hit = min(t + 5, n - 1), "timeout"
        for j in range(t + 1, end + 1):
            r = close[j] / close[t] - 1
            if r >= vol or r <= -vol:
                hit, end = ("pt" if r >= vol else "sl"), j
                break
        assert got[days(n)[t]] == (hit, days(n)[end])


def test_purged_folds_do_not_overlap(spark):
    rows = [("A", d, d + dt.timedelta(5)) for d in days(90)]
    df = labels.pooled_position(spark.createDataFrame(rows, "symbol string, date date, t1 date"), "date", ["symbol"])
    f = labels.purged_folds(df).collect()
    for k in range(1, 6):
        train, test = [r for r in f if r.fold == k and r.role == "train"], [r for r in f if r.fold == k and r.role == "test"]
        assert len(test) == 15 and train and max(r.t1 for r in train) < min(r.date for r in test)


def test_auc_with_ties_and_conformal(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1), (0, 0.5)], "y int, p double")
    assert math.isclose(evaluation.auc(df, "y", "p").first().auc, (3 + 2 / 2 + 1) / 6)
    s = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 100)], "s double")
    q = {r.alpha: r for r in evaluation.conformal(s, "s", [0.2, 0.001]).collect()}
    assert 0.75 <= q[0.2].q <= 0.85 and q[0.001].q == float("inf")


def test_kelly_values(spark):
    df = spark.createDataFrame([(0.5,), (0.4,), (0.6,), (0.99,)], "p double")
    got = [r[0] for r in df.select(portfolio.kelly_fraction(F.col("p"))).collect()]
    assert got[:2] == [0.0, 0.0] and math.isclose(got[2], 0.05) and got[3] <= 0.5


def test_neutral_residuals(spark):
    beta, alpha = [0.2, 0.5, 1, 1.5, 2, 0.8], [0.01, -0.02, 0, 0.015, -0.01, 0.005]
    df = spark.createDataFrame([(D(2024, 1, 1), str(i), 0.04 * b + a, float(b), i % 2) for i, (b, a) in enumerate(zip(beta, alpha))], "date date, symbol string, ret double, beta double, sector int")
    r = [(x.residual, x.beta, x.sector) for x in portfolio.neutralise(df, "ret", "beta").collect()]
    res = np.array([x[0] for x in r])
    assert abs(res.mean()) < 1e-12 and abs(np.corrcoef(res, [x[1] for x in r])[0, 1]) < 1e-6
    by = portfolio.neutralise(df, "ret", "sector").groupBy("sector").agg(F.avg("residual").alias("m")).collect()
    assert all(abs(x.m) < 1e-12 for x in by)


def test_leg_weights(spark):
    make = lambda metas: spark.createDataFrame([(D(2024, 1, 1), str(i), float(m), 1.0) for i, m in enumerate(metas)], "date date, symbol string, meta double, vol double")
    w = lambda df, **k: [x.weight for x in portfolio.leg_weights(df, **k).orderBy("symbol").collect()]
    assert w(make([0.52, 0.60, 0.75, 0.55]), kelly=False) == [0.25] * 4
    assert int(np.argmax(w(make([0.52, 0.60, 0.75, 0.55])))) == 2
    assert np.allclose(w(make([0.5, 0.5, 0.5])), 1 / 3)


def test_positions_average_cost(spark):
    rows = [(1, "A", "BUY", 10.0, 5.0, D(2024, 1, 1), 1), (1, "A", "BUY", 10.0, 7.0, D(2024, 1, 2), 2), (1, "A", "SELL", 5.0, 9.0, D(2024, 1, 3), 3), (1, "B", "BUY", 2.0, 3.0, D(2024, 1, 1), 4), (1, "B", "SELL", 9.0, 3.0, D(2024, 1, 2), 5)]
    got = {r.symbol: r for r in positions(spark.createDataFrame(rows, "user_id int, symbol string, side string, quantity double, price double, trade_date date, seq int")).collect()}
    assert got["A"].quantity == 15 and got["A"].cost == 90 and got["A"].avg_price == 6
    assert got["B"].quantity == 0 and got["B"].avg_price is None


def test_keyed_table(spark):
    t = KeyedTable(spark, scratch(spark, "t"), ["k"], "k int, v int")
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), [F.desc("v")])
    t.upsert(spark.createDataFrame([(2, 1), (2, 5), (3, 3)], "k int, v int"), [F.desc("v")])
    t.insert_ignore(spark.createDataFrame([(3, 9), (4, 4)], "k int, v int"), [F.col("v")])
    t.prune(F.col("k") > 1)
    assert sorted(map(tuple, t.read().collect())) == [(2, 5), (3, 3), (4, 4)]


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("open_time,value\n1,2.5\n2,x\n")
    got = read_csv(spark, str(tmp_path / "a.csv"), {"t": "bigint", "v": "double"}, header=False).collect()
    assert sorted((r.t, r.v) for r in got) == [(1, 2.5), (2, None)]


def test_out_of_fold_scores_every_event_after_the_first_block(spark):
    import random
    from datetime import date, timedelta

    from marketloom.plans.models import out_of_fold

    rng, rows = random.Random(3), []
    for d in range(41):
        for s in "abc":
            x = rng.uniform(-1, 1)
            rows.append((s, date(2024, 1, 1) + timedelta(d), date(2024, 1, 6) + timedelta(d), x, *[rng.uniform(-1, 1) for _ in range(4)], float(x > 0)))
    df = spark.createDataFrame(rows, "symbol string, date date, t1 date, sma5 double, sma20 double, vol20 double, r1 double, r5 double, y double")
    got = out_of_fold(df, "logistic").collect()
    size = len(rows) // 7  # 123 events in order of (date, symbol): blocks of 17, the last one takes 4 more
    want = {(r[0], r[1]): min(i // size, 6) for i, r in enumerate(rows) if i >= 2 * size}  # nothing ends before fold 1's embargo
    fold_1 = {(r[0], r[1]) for i, r in enumerate(rows) if size <= i < 2 * size}
    trainable = any(r[2] < rows[size - 7][1] for r in rows[:size])
    want |= dict.fromkeys(fold_1, 1) if trainable else {}
    assert len(got) == len(want) and {(r.symbol, r.date): r.fold for r in got} == want
    late = [r for r in got if r.fold >= 3]
    assert sum((r.p > 0.5) == (r.y > 0.5) for r in late) > 0.85 * len(late)
