"""The day's target book: selection, regime gate, volatility lever, verdicts and orders.  All tables here have a row per symbol of the universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .portfolio import regime_scale

FRAC, VOL_TARGET, VOL_WINDOW, MAX_LEVERAGE, PERIODS, EQUITY, MAX_NOTIONAL = 0.10, 0.30, 20, 3.0, 252, 100_000.0, 10_000.0


def basket_leverage(returns: DataFrame, held: DataFrame, window: int = VOL_WINDOW, target: float = VOL_TARGET, most: float = MAX_LEVERAGE, periods: int = PERIODS) -> DataFrame:
    """One row with ``leverage``: the daily target over the deviation of the last ``window`` mean returns of the held names, within 0 and ``most``.

    It is 1 while there are fewer than max(5, window // 2) dates, or no spread.
    """
    basket = returns.join(held.select("symbol"), "symbol", "left_semi").where("ret IS NOT NULL AND NOT isnan(ret)").groupBy("date").agg(F.avg("ret").alias("m"))
    last = basket.orderBy(F.desc("date")).limit(window)  # a bounded window of dates
    enough = basket.agg((F.count(F.lit(1)) >= max(5, window // 2)).alias("enough"))
    spread = last.agg(F.stddev_samp("m").alias("spread")).crossJoin(F.broadcast(enough))  # one row each
    lever = F.least(F.lit(most), F.greatest(F.lit(0.0), F.lit(target / periods**0.5) / F.col("spread")))
    return spread.select(F.when(F.col("enough") & (F.col("spread") > 0), lever).otherwise(1.0).alias("leverage"))


def target_book(predictions: DataFrame, returns: DataFrame, frac: float = FRAC, min_edge: float = 0.0, equity: float = EQUITY, **lever) -> DataFrame:
    """symbol, edge, confidence, weight, target_frac, notional of the names to hold.

    ``predictions``: symbol, prob_up, confidence, regime (the market's, the same for all).  The universe are all rows with a
    probability; of those with an edge above ``min_edge`` the best round(frac * universe) are held, one at least, in equal weights; ties go to the smaller
    symbol.  Exposure is scaled by regime and leverage.  ``returns``: symbol, date, ret.
    """
    everything = Window.partitionBy(F.lit(0))  # a row per symbol
    valid = predictions.where("prob_up IS NOT NULL").withColumn("_n", F.count(F.lit(1)).over(everything)).withColumn("edge", F.col("prob_up") - 0.5)
    ranked = valid.where(F.col("edge") > min_edge).withColumn("_rank", F.row_number().over(everything.orderBy(F.desc("edge"), "symbol")))
    held = ranked.where(F.col("_rank") <= F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(frac)).cast("int")))
    held = held.withColumn("_w", 1 / F.count(F.lit(1)).over(everything)).crossJoin(F.broadcast(basket_leverage(returns, held, **lever)))  # one row
    target = regime_scale(F.col("regime")) * F.col("leverage") * F.col("_w")
    return held.select("symbol", F.round("edge", 4).alias("edge"), "confidence", F.round("_w", 4).alias("weight"), F.round(target, 4).alias("target_frac"), F.round(equity * target, 2).alias("notional"))


def with_verdicts(book: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The book after a review that can only take away: a veto drops a name, a lower final confidence scales it by that share of the
    model's; names without a verdict stay as they are, and the rest is not scaled up again.  ``verdicts``: symbol, veto, final_confidence, a row per symbol."""
    v = verdicts.select("symbol", F.coalesce("veto", F.lit(False)).alias("_veto"), F.col("final_confidence").alias("_final"))
    scale = F.when((F.col("confidence") > 0) & (F.col("_final") < F.col("confidence")), F.col("_final") / F.col("confidence"))
    kept = book.join(v, "symbol", "left").where("_veto IS NULL OR NOT _veto").withColumn("_scale", scale)
    sized = lambda c, digits: F.when(F.col("_scale").isNotNull(), F.round(F.col(c) * F.col("_scale"), digits)).otherwise(F.col(c)).alias(c)
    return kept.select("symbol", "edge", "confidence", "weight", sized("target_frac", 4), sized("notional", 2))


def planned_orders(book: DataFrame, equity: float = EQUITY, most: float = MAX_NOTIONAL) -> DataFrame:
    """symbol and notional of the orders: bounded, and none under one unit."""
    notional = F.round(F.least(F.lit(most), equity * F.col("target_frac")), 2)
    return book.where("target_frac > 0").select(F.upper("symbol").alias("symbol"), F.lit("buy").alias("side"), notional.alias("notional")).where("notional >= 1")
