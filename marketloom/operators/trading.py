"""Crossing averages traded all in and all out: the ledger of trades, the equity of every bar and the report on it.

A signal is 1 while the short average is above the long one; bars without both averages take no part.  A change to 1 buys with
all the capital, a change to 0 sells all shares; a signal that is 1 on the first bar buys nothing.  Trades are the segments between a buy and the
sell after it, so capital compounds by the product of their price ratios: a running sum of logarithms, one sort per symbol and no loop over bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INITIAL, SHORT, LONG, PERIODS = 10_000.0, 20, 50, 252


def traded_bars(bars: DataFrame, short: int = SHORT, long: int = LONG, initial: float = INITIAL) -> DataFrame:
    """symbol, date, close, action (BUY, SELL or null), entry (price of the last buy), shares held after the bar's action, capital
    that is not in shares, value (rounded to cents).

    Prices that are null, NaN or not positive are no bars.  Of bars equal in symbol and date, the order is that of the price.
    """
    c = F.col("close")
    rows = bars.select("symbol", "date", c.cast("double").alias("close")).where("symbol IS NOT NULL AND date IS NOT NULL AND close > 0 AND NOT isnan(close)")
    by = Window.partitionBy("symbol").orderBy("date", "close")
    mean = lambda n: F.when(F.count(c).over(by.rowsBetween(1 - n, 0)) >= n, F.avg(c).over(by.rowsBetween(1 - n, 0)))
    rows = rows.withColumn("_s", mean(short)).withColumn("_l", mean(long)).where("_s IS NOT NULL AND _l IS NOT NULL")
    rows = rows.withColumn("_signal", (F.col("_s") > F.col("_l")).cast("int")).withColumn("_change", F.col("_signal") - F.lag("_signal").over(by))
    sofar = by.rowsBetween(Window.unboundedPreceding, 0)
    bought = F.count(F.when(F.col("_change") == 1, 1)).over(sofar)
    rows = rows.withColumn("action", F.when(F.col("_change") == 1, "BUY").when((F.col("_change") == -1) & (bought > 0), "SELL"))
    rows = rows.withColumn("entry", F.last(F.when(F.col("action") == "BUY", c), ignorenulls=True).over(sofar))
    gained = F.sum(F.when(F.col("action") == "SELL", F.log(c / F.col("entry"))).otherwise(0.0)).over(sofar)
    held = F.last("action", ignorenulls=True).over(sofar)
    rows = rows.withColumn("_wealth", initial * F.exp(gained)).withColumn("_held", F.coalesce(held == "BUY", F.lit(False)))
    rows = rows.withColumn("shares", F.when(F.col("_held"), F.col("_wealth") / F.col("entry")).otherwise(0.0)).withColumn("capital", F.when(F.col("_held"), 0.0).otherwise(F.col("_wealth")))
    value = F.round(F.col("capital") + F.col("shares") * c, 2)
    sold = F.when(F.col("action") == "SELL", F.col("_wealth") / c)  # what a sell has sold
    return rows.select("symbol", "date", "close", "action", "entry", "shares", "capital", value.alias("value"), sold.alias("sold"))


def trade_ledger(traded: DataFrame) -> DataFrame:
    """One row per action: symbol, date, action, price, shares, pnl (of sells, against the entry price as it is shown)."""
    pnl = F.when(F.col("action") == "SELL", F.round(F.col("capital") - F.round("entry", 4) * F.col("sold"), 2))
    return traded.where("action IS NOT NULL").select("symbol", "date", "action", F.round("close", 4).alias("price"), F.round(F.coalesce("sold", "shares"), 6).alias("shares"), pnl.alias("pnl"))


def trading_report(traded: DataFrame, initial: float = INITIAL, periods: int = PERIODS) -> DataFrame:
    """Per symbol: final_value, total_return (%), sharpe (population deviation), max_drawdown (a positive percentage), win_rate (%), total_trades.

    Returns are those of the rounded values; a series without spread has a Sharpe ratio of 0, one without sells a win rate of 0.
    """
    by = Window.partitionBy("symbol").orderBy("date", "close")
    value = F.col("value")
    rows = traded.withColumn("_r", F.try_divide(value - F.lag("value").over(by), F.nullif(F.lag("value").over(by), F.lit(0.0)))).withColumn("_peak", F.max("value").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    won = (F.col("action") == "SELL") & (F.round(F.col("capital") - F.round("entry", 4) * F.col("sold"), 2) > 0)
    out = rows.groupBy("symbol").agg(
        F.max_by(F.col("capital") + F.col("shares") * F.col("close"), F.struct("date", "close")).alias("_final"), F.avg("_r").alias("_mean"), F.stddev_pop("_r").alias("_spread"),
        F.max((F.col("_peak") - value) / F.col("_peak") * 100).alias("_down"), F.count("action").alias("total_trades"), F.count(F.when(F.col("action") == "SELL", 1)).alias("_sells"), F.count(F.when(won, 1)).alias("_won"),
    )
    sharpe = F.when(F.col("_spread") > 0, F.round(F.col("_mean") / F.col("_spread") * periods**0.5, 3)).otherwise(0.0)
    return out.select(
        "symbol", F.round("_final", 2).alias("final_value"), F.round((F.col("_final") - initial) / initial * 100, 2).alias("total_return"), sharpe.alias("sharpe"), F.round("_down", 2).alias("max_drawdown"),
        F.round(F.col("_won") / F.greatest("_sells", F.lit(1)) * 100, 1).alias("win_rate"), "total_trades",
    )
