"""Backtests with trades: ledger, equity of every bar, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows as w
from ..operators.trading import INITIAL, trade_ledger, traded_bars, trading_report
from ..registry import query
from ..sources.logical import bars, twin

#: The test tables' prices are drawn anew each week; an index of twelve of them has trends to follow.
SHORT, LONG, SMOOTH = 5, 20, 12
_W = "PARTITION BY symbol ORDER BY date"
#: The same bar by bar: cash and shares are carried from one row to the next.
_LOOP = (
    ("ix", f"SELECT symbol, date, close FROM (SELECT symbol, date, avg(close) OVER ({_W} ROWS {SMOOTH - 1} PRECEDING) AS close, count(*) OVER ({_W} ROWS {SMOOTH - 1} PRECEDING) AS k FROM bars) WHERE k >= {SMOOTH}"),
    ("av", f"SELECT *, row_number() OVER ({_W}) AS rn, s - lag(s) OVER ({_W}) AS chg FROM (SELECT symbol, date, close, (avg(close) OVER ({_W} ROWS {SHORT - 1} PRECEDING) > avg(close) OVER ({_W} ROWS {LONG - 1} PRECEDING))::INT AS s, count(*) OVER ({_W} ROWS {LONG - 1} PRECEDING) AS k FROM ix) WHERE k >= {LONG}"),
    ("sm", f"""SELECT symbol, date, close, rn, {INITIAL}::DOUBLE AS cash, 0::DOUBLE AS sh, NULL::DOUBLE AS entry, NULL::VARCHAR AS act, NULL::DOUBLE AS sold FROM av WHERE rn = 1
      UNION ALL SELECT a.symbol, a.date, a.close, a.rn, CASE WHEN a.chg = 1 AND cash > 0 THEN 0 WHEN a.chg = -1 AND sh > 0 THEN sh * a.close ELSE cash END, CASE WHEN a.chg = 1 AND cash > 0 THEN cash / a.close WHEN a.chg = -1 AND sh > 0 THEN 0 ELSE sh END,
        CASE WHEN a.chg = 1 AND cash > 0 THEN a.close ELSE entry END, CASE WHEN a.chg = 1 AND cash > 0 THEN 'BUY' WHEN a.chg = -1 AND sh > 0 THEN 'SELL' END, CASE WHEN a.chg = -1 AND sh > 0 THEN sh END FROM sm JOIN av a ON a.symbol = sm.symbol AND a.rn = sm.rn + 1"""),
    ("lg", "SELECT symbol, date, act AS action, round(close, 4) AS price, round(coalesce(sold, sh), 6) AS shares, CASE WHEN act = 'SELL' THEN round(cash - round(entry, 4) * sold, 2) END AS pnl FROM sm WHERE act IS NOT NULL"),
    ("eq", "SELECT symbol, date, round(cash + sh * close, 2) AS value, cash + sh * close AS v FROM sm"),
)


def _traded(spark, sf_dir) -> DataFrame:
    index = bars(spark, sf_dir).select("symbol", "date", w.rmean(F.col("close"), SMOOTH).alias("close"))
    return traded_bars(index, SHORT, LONG)


@query("trade_ledger", twin("SELECT * FROM lg", *_LOOP[:4], recursive=True))
def ledger(spark, sf_dir) -> DataFrame:
    """Every buy and sell of every symbol."""
    return trade_ledger(_traded(spark, sf_dir))


@query("equity_curve", twin("SELECT symbol, date, value FROM eq", *_LOOP[:3], _LOOP[4], recursive=True))
def equity(spark, sf_dir) -> DataFrame:
    """Value of the account of each symbol at every bar."""
    return _traded(spark, sf_dir).select("symbol", "date", "value")


@query("backtest_report", twin(f"""SELECT r.symbol, final_value, round((f - {INITIAL}) / {INITIAL} * 100, 2) AS total_return, CASE WHEN sd > 0 THEN round(m / sd * sqrt(252), 3) ELSE 0 END AS sharpe, round(down, 2) AS max_drawdown,
      round(coalesce(won, 0) / greatest(coalesce(sells, 0), 1)::DOUBLE * 100, 1) AS win_rate, coalesce(n, 0) AS total_trades FROM (
    SELECT symbol, arg_max(v, date) AS f, round(arg_max(v, date), 2) AS final_value, avg(ret) AS m, stddev_pop(ret) AS sd, max((peak - value) / peak * 100) AS down FROM (
      SELECT *, (value - lag(value) OVER ({_W})) / nullif(lag(value) OVER ({_W}), 0) AS ret, max(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS peak FROM eq) GROUP BY symbol) r
    LEFT JOIN (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE action = 'SELL') AS sells, count(*) FILTER (WHERE pnl > 0) AS won FROM lg GROUP BY symbol) t ON t.symbol = r.symbol""", *_LOOP, recursive=True))
def report(spark, sf_dir) -> DataFrame:
    """Return, Sharpe ratio by the population deviation, drawdown as a positive percentage, and win rate of each symbol."""
    return trading_report(_traded(spark, sf_dir))
