"""Volatility models: conditional volatility of each bar and the forecast after the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import r6
from ..operators import windows as w
from ..operators.garch import conditional_volatility
from ..registry import query
from ..sources.logical import bars


def log_returns(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "date", w.log_return(F.col("close")).alias("ret")).where("ret is not null")


@query("garch_volatility")
def garch_volatility(spark, sf_dir) -> DataFrame:
    """Volatility of every bar and of the five after it; the weighted form where a symbol's history is short."""
    return conditional_volatility(log_returns(spark, sf_dir)).select("symbol", "date", r6(F.col("vol")).alias("vol"), r6(F.col("vol_h")).alias("vol_5"), "model")


@query("garch_forecast")
def garch_forecast(spark, sf_dir) -> DataFrame:
    """Per symbol: the fitted model, its long-run volatility and the forecast for the five bars after the last one."""
    v = conditional_volatility(log_returns(spark, sf_dir))
    last = v.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("model", "omega", "alpha", "beta", "vol", "vol_h"), "date").alias("m"))
    long_run = F.sqrt(F.col("m.omega") / F.nullif(1 - F.col("m.alpha") - F.col("m.beta"), F.lit(0.0)))
    return last.select("symbol", "n", "m.model", *[F.round(f"m.{c}", 4).alias(c) for c in ("alpha", "beta")], r6(long_run).alias("long_run_vol"), r6(F.col("m.vol")).alias("vol"), r6(F.col("m.vol_h")).alias("vol_5"))
