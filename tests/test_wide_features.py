"""The wide feature table: causal, never shorter for a further block; what a block is worth on identical rows."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators.features import assembled, feature_columns, market_block, price_block, with_market
from marketloom.operators.training import block_ablation

DAYS = [date(2020, 1, 6) + timedelta(days=i) for i in range(260)]


def bars(spark, last=260, tail=1.0):
    rng, rows = random.Random(1), []
    for s in ("A", "B"):
        p = 100.0
        for i, d in enumerate(DAYS):
            p *= math.exp(rng.gauss(0, 0.02))
            x = p * (tail if i >= last else 1.0)
            rows.append((s, d, x * 0.99, x * 1.02, x * 0.97, x, 1000 + rng.randint(0, 500)))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long")


def market(spark, days=DAYS):
    return spark.createDataFrame([(d, 100.0 + i, 10 + math.sin(i), 2.0 + i % 3) for i, d in enumerate(days)], "date date, level double, fear double, rate double")


def by_key(df):
    return {(r.symbol, r.date): r.asDict() for r in df.collect()}


def test_no_feature_sees_a_later_bar(spark):
    a, b = by_key(assembled({"market": market(spark)}, bars(spark))), by_key(assembled({"market": market(spark)}, bars(spark, 230, 3.0)))
    names = feature_columns(assembled({"market": market(spark)}, bars(spark).limit(0)))
    assert len(names) >= 42 and "ffd_order" not in names and "close" not in names
    for (s, d), row in a.items():
        if d < DAYS[230]:
            assert all(row[n] == b[s, d][n] for n in names), (s, d)
    changed = [n for n in names if any(a["A", d][n] != b["A", d][n] for d in DAYS[230:])]
    assert len(changed) > 30
    full = a["A", DAYS[-1]]
    assert all(full[n] is not None and math.isfinite(full[n]) for n in names)
    assert a["A", DAYS[10]]["sma_200"] is None and a["A", DAYS[0]]["fear_z"] == 0.0


def test_market_rows_carry_over_days_without_one(spark):
    m = market_block(market(spark, DAYS[::2]))
    got = by_key(with_market(price_block(bars(spark)), m))
    rows = {r.date: r for r in m.collect()}
    for i, d in enumerate(DAYS[2:200], 2):
        have = got["A", d]
        assert have["fear_change"] == rows[DAYS[i - i % 2]].fear_change
        assert have["rs_1"] is None or abs(have["rs_1"] - (have["ret_1"] - have["market_ret_1"])) < 1e-12
    late = with_market(price_block(bars(spark)), market_block(market(spark, DAYS[100:])))
    assert {r.fear_z for r in late.where(F.col("date") < DAYS[100]).collect()} == {0.0}


def test_further_blocks_are_switched_on_and_cost_no_row(spark):
    crypto = spark.createDataFrame([("A", DAYS[5], 0.5), ("A", DAYS[6], None)], "symbol string, date date, funding double")
    macro = spark.createDataFrame([(DAYS[7], 1.5)], "date date, spread double")
    blocks, b = {"crypto": crypto, "macro": macro, "market": market(spark)}, bars(spark)
    off = assembled(blocks, b)
    assert "funding" not in off.columns and "spread" not in off.columns
    on = assembled(blocks, b, {"USE_CRYPTO": "1", "USE_MACRO": "1", "USE_EQUITY": "1"})
    got = by_key(on)
    assert len(got) == off.count() == 520
    assert got["A", DAYS[5]]["funding"] == 0.5 and got["A", DAYS[6]]["funding"] == 0.0 and got["B", DAYS[5]]["funding"] == 0.0
    assert got["B", DAYS[7]]["spread"] == 1.5 and got["B", DAYS[8]]["spread"] == 0.0


def test_ablation_finds_the_block_that_tells(spark):
    from pyspark.ml.classification import LogisticRegression

    rng, rows = random.Random(3), []
    for i in range(700):
        a, noise = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append(("S", date(2020, 1, 1) + timedelta(days=i), date(2020, 1, 1) + timedelta(days=i + 1), a, a + rng.gauss(0, 1), noise if i % 50 else None, float(a + rng.gauss(0, 0.5) > 0)))
    df = spark.createDataFrame(rows, "symbol string, date date, t1 date, a double, b double, noise double, y double")
    got = block_ablation(df, LogisticRegression(featuresCol="_x", labelCol="y", regParam=0.01), {"signal": ["a", "b"], "noise": ["noise"]})
    (signal, n1, whole, without, lift), (noise, n2, whole2, _, lift2) = got
    assert (signal, n1, noise, n2) == ("signal", 2, "noise", 1) and whole == whole2  # the same rows and folds
    assert whole > 0.85 and abs(without - 0.5) < 0.1 and lift > 0.3 and abs(lift2) < 0.02


def test_inactive_days_are_dropped(spark, tmp_path):
    from marketloom.sources.feeds import onchain

    (tmp_path / "c.csv").write_text("asset,time,AdrActCnt,TxCnt,SplyCur,CapMrktCurUSD,PriceUSD\nbtc,2020-01-01,0,0,1,2,3\nbtc,2020-01-02,,,1,2,3\nbtc,2020-01-03,0,5,1,2,3\nbtc,2020-01-04,7,,1,2,3\nbtc,2020-01-05,x,0,1,2,3\neth,2020-01-01,1,1,1,1,1\n")
    assert sorted(str(r.date) for r in onchain(spark, str(tmp_path / "c.csv"), ["BTC"]).collect()) == ["2020-01-03", "2020-01-04"]


@pytest.mark.parametrize("n", [62, 65])
def test_the_last_fold_reaches_the_last_event(spark, n):
    from marketloom.operators.labels import pooled_position, purged_folds

    df = spark.createDataFrame([("S", date(2020, 1, 1) + timedelta(days=i), date(2020, 1, 2) + timedelta(days=i)) for i in range(n)], "symbol string, date date, t1 date")
    folds = purged_folds(pooled_position(df, "date", ["symbol"]), whole=True)
    tested = {r.pos: r.fold for r in folds.where("role = 'test'").collect()}
    assert sorted(tested) == list(range(n // 6, n)) and tested[n - 1] == 5
