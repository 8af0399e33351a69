"""Trades of crossing averages against a loop over bars; throttled runs against a loop over triggers."""

import math
import random
from datetime import date, datetime, timedelta

from marketloom.operators.throttle import runs_apart
from marketloom.operators.trading import trade_ledger, traded_bars, trading_report


def walked(closes, short, long, initial=10_000.0):
    """The account bar by bar: (equity, trades, sharpe, drawdown, wins)."""
    mean = lambda i, n: sum(closes[i - n + 1 : i + 1]) / n
    cash, shares, equity, trades, before = initial, 0.0, [], [], None
    for i in range(long - 1, len(closes)):
        signal, price = int(mean(i, short) > mean(i, long)), closes[i]
        if before is not None and signal - before == 1 and cash > 0:
            shares, cash = cash / price, 0.0
            trades.append(("BUY", round(price, 4), round(shares, 6), None))
        elif before is not None and signal - before == -1 and shares > 0:
            cash = shares * price
            trades.append(("SELL", round(price, 4), round(shares, 6), round(cash - trades[-1][1] * shares, 2)))
            shares = 0.0
        before = signal
        equity.append(round(cash + shares * price, 2))
    r = [b / a - 1 for a, b in zip(equity, equity[1:])]
    m = sum(r) / len(r)
    spread = math.sqrt(sum((x - m) ** 2 for x in r) / len(r))
    peak, down = equity[0], 0.0
    for v in equity:
        peak = max(peak, v)
        down = max(down, (peak - v) / peak * 100)
    sells = [t for t in trades if t[0] == "SELL"]
    return equity, trades, round(m / spread * 252**0.5, 3) if spread > 0 else 0.0, round(down, 2), round(sum(t[3] > 0 for t in sells) / max(len(sells), 1) * 100, 1)


def prices(seed, n, trend):
    rng, p, out = random.Random(seed), 50.0, []
    for i in range(n):
        p *= math.exp(rng.gauss(trend * math.sin(i / 17), 0.02))
        out.append(p)
    return out


def test_ledger_equity_and_report_equal_a_loop(spark):
    series = {"A": prices(1, 400, 0.02), "B": prices(2, 300, 0.01), "UP": [100 * 1.01**i for i in range(120)], "FLAT": [7.0] * 80, "DOWN": [100 * 0.99**i for i in range(90)], "SHORT": [1.0] * 8}
    rows = [(s, date(2020, 1, 1) + timedelta(days=i), p) for s, ps in series.items() for i, p in enumerate(ps)]
    rows += [("A", date(2020, 1, 3), None), ("B", date(2020, 1, 4), float("nan")), ("B", date(2020, 1, 5), -1.0), (None, date(2020, 1, 1), 5.0), ("A", None, 5.0)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, date date, close double").selectExpr("*", "1 as action", "2 as value", "3 as _signal")
    traded = traded_bars(df, 5, 20).cache()
    ledger = trade_ledger(traded).orderBy("date").collect()
    report = {r.symbol: r for r in trading_report(traded).collect()}
    curve = traded.orderBy("date").collect()
    assert set(report) == set(series) - {"SHORT"}
    for s in report:
        equity, trades, sharpe, down, wins = walked(series[s], 5, 20)
        own = [(r.action, r.price, r.shares, r.pnl) for r in ledger if r.symbol == s]
        assert len(own) == len(trades)
        for a, b in zip(own, trades):
            assert a[0] == b[0] and all(x is y is None or abs(x - y) < 0.011 for x, y in zip(a[1:], b[1:]))
        assert max(abs(r.value - v) for r, v in zip((r for r in curve if r.symbol == s), equity)) < 0.011
        r = report[s]
        assert abs(r.final_value - equity[-1]) < 0.011 and abs(r.sharpe - sharpe) < 0.002 and abs(r.max_drawdown - down) < 0.011 and r.win_rate == wins and r.total_trades == len(trades)
    assert len([r for r in ledger if r.symbol == "A"]) >= 4 and report["UP"].total_trades == 0 and report["FLAT"].sharpe == 0
    assert trading_report(traded_bars(df.limit(0))).count() == 0
    traded.unpersist()


def test_runs_are_those_of_a_loop(spark):
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), t0 + timedelta(minutes=rng.randint(0, 60_000))) for _ in range(3000)]
    rows += [("even", t0 + timedelta(hours=i)) for i in range(2000)] + [("once", t0)] * 3 + [(None, t0), ("a", None)]
    got = runs_apart(spark.createDataFrame(rows, "k string, ts timestamp").selectExpr("*", "1 as at", "2 as next"), "k", "ts", "12 hours").collect()
    want = []
    for k in {r[0] for r in rows if r[0]}:
        last = None
        for t in sorted({t for key, t in rows if key == k and t}):
            if last is None or t >= last + timedelta(hours=12):
                want.append((k, t))
                last = t
    assert sorted(map(tuple, got)) == sorted(want) and sum(k == "even" for k, _ in want) == 167
    assert runs_apart(spark.createDataFrame([], "k string, ts timestamp"), "k", "ts", "1 hour").count() == 0
