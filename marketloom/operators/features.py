"""Feature blocks over bars (symbol, date, open, high, low, close, volume) and their assembly behind switches.

The price block is one select of windows (one exchange, one sort) around one grouped pass that holds all recursions.  Blocks that are the same for all
symbols of a date have a row per date and are joined to the bars, each date carrying the last row at or before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import safe_div
from . import windows as w
from .fracdiff import fracdiff
from .recursive import smooth, span

#: Columns that are no features: raw prices, what is kept for diagnosis, and the keys.
RAW_COLUMNS, DIAGNOSTIC, KEYS = ("open", "high", "low", "close", "volume", "adj_close"), ("ffd_order",), ("symbol", "date")
#: Blocks and whether they are built unless asked for otherwise.
BLOCKS = {"price": True, "crypto": False, "equity": False, "sentiment": False, "macro": False}
RECURSIVE = ("macd", "macd_signal", "macd_hist", "rsi_14", "atr_14", "plus_di", "minus_di", "adx_14")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*RAW_COLUMNS, *DIAGNOSTIC, *KEYS)]


def enabled_blocks(flags: dict[str, str] | None = None) -> list[str]:
    """Blocks to build: the default ones, and those whose flag ``USE_<BLOCK>`` is "1"."""
    return [b for b, on in BLOCKS.items() if on or (flags or {}).get(f"USE_{b.upper()}") == "1"]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


def _recursions(pdf: pd.DataFrame) -> pd.DataFrame:
    """All exponential recursions of one symbol's history."""
    pdf = pdf.sort_values("date", kind="stable")
    high, low, close = (pd.to_numeric(pdf[c]).to_numpy(dtype=float, na_value=np.nan) for c in ("high", "low", "close"))
    before = np.r_[np.nan, close[:-1]]
    wilder = lambda x: smooth(x, 1 / 14, 14)
    line = smooth(close, span(12)) - smooth(close, span(26))
    signal = smooth(line, span(9))
    change = close - before
    gain, loss = wilder(np.where(np.isnan(change), np.nan, np.maximum(change, 0))), wilder(np.where(np.isnan(change), np.nan, np.maximum(-change, 0)))
    true_range = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    rise, fall = high - np.r_[np.nan, high[:-1]], np.r_[np.nan, low[:-1]] - low
    with np.errstate(invalid="ignore"):
        plus, minus = np.where((rise > fall) & (rise > 0), rise, 0.0), np.where((fall > rise) & (fall > 0), fall, 0.0)
    average = wilder(true_range)
    plus, minus = _ratio(100 * wilder(plus), average), _ratio(100 * wilder(minus), average)
    values = (line / close, signal / close, (line - signal) / close, 100 - 100 / (1 + _ratio(gain, loss)), average / close, plus, minus, wilder(_ratio(100 * np.abs(plus - minus), plus + minus)))
    return pdf.assign(**{n: pd.array(np.where(np.isfinite(x), x, None), dtype="object") for n, x in zip(RECURSIVE, values)})


def price_block(bars: DataFrame, ffd_order: float = 0.4) -> DataFrame:
    """The bars with all price features; what a window is too short for is null."""
    names = [*KEYS, "open", "high", "low", "close", "volume"]
    kinds = dict(bars.select(*names).dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in names] + [f"{c} double" for c in RECURSIVE])
    b = bars.select(*names).groupBy("symbol").applyInPandas(_recursions, schema)
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    typical, sofar = (h + lo + c) / 3, w.by().rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({"_r": w.log_return(c), "_ma": w.rmean(c, 20), "_sd": w.rstd(c, 20), "_lo": w.rolling(F.min, lo, 14), "_hi": w.rolling(F.max, h, 14), "_mv": w.rmean(v, 20), "_d": c - w.lag(c), "_tp": typical, "_td": typical - w.lag(typical)})
    b = b.withColumns({
        "_k": safe_div(100 * (c - F.col("_lo")), F.col("_hi") - F.col("_lo")), "_obv": F.sum(F.coalesce(F.signum("_d"), F.lit(0.0)) * v).over(sofar),
        "_in": F.when(F.col("_td") > 0, F.col("_tp") * v).otherwise(0.0), "_out": F.when(F.col("_td") < 0, F.col("_tp") * v).otherwise(0.0),
    })
    day, month = 2 * F.pi() * F.weekday("date") / 5, 2 * F.pi() * (F.month("date") - 1) / 12
    features = {f"sma_{n}": c / w.rmean(c, n) - 1 for n in (5, 10, 20, 50, 200)}
    features |= {f"ret_{n}": w.log_return(c, n) for n in (1, 5, 10, 20)}
    features |= {f"rvol_{n}": w.rstd(F.col("_r"), n) for n in (5, 20)}
    features |= {
        "stoch_k": F.col("_k"), "stoch_d": w.rmean(F.col("_k"), 3), "roc_10": w.change(c, 10), "williams_r": safe_div(-100 * (F.col("_hi") - c), F.col("_hi") - F.col("_lo")),
        "bb_width": 4 * F.col("_sd") / F.col("_ma"), "bb_pct": safe_div(c - (F.col("_ma") - 2 * F.col("_sd")), 4 * F.col("_sd")),
        "obv_slope": (F.col("_obv") - w.lag(F.col("_obv"), 5)) / (F.col("_mv") + 1), "volume_ratio": v / (F.col("_mv") + 1),
        "mfi_14": 100 - safe_div(F.lit(100.0), 1 + safe_div(w.rsum(F.col("_in"), 14), w.rsum(F.col("_out"), 14))),
        "gap": safe_div(o, w.lag(c)) - 1, "intraday": (h - lo) / c,
        "dow_sin": F.sin(day), "dow_cos": F.cos(day), "month_sin": F.sin(month), "month_cos": F.cos(month), "month_end": (F.col("date") == F.last_day("date")).cast("double"),
    }
    out = fracdiff(b.withColumns(features), F.log(c), ffd_order, "fracdiff_04").withColumn("ffd_order", F.lit(ffd_order))
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def market_block(market: DataFrame) -> DataFrame:
    """One row per date (date, level, fear, rate): returns of the level over 1, 5 and 20 dates, z-score and change of the fear gauge, change of the rate; unknown ones are 0."""
    days = Window.orderBy("date")  # one row per date
    year = days.rowsBetween(-251, 0)
    fear, lag = F.col("fear"), lambda c, n=1: F.lag(c, n).over(days)
    spread = F.when(F.count("fear").over(year) >= 60, F.stddev_samp("fear").over(year))
    features = {f"market_ret_{n}": F.log(safe_div(F.col("level"), lag("level", n))) for n in (1, 5, 20)}
    features |= {"fear_z": safe_div(fear - F.avg("fear").over(year), spread), "fear_change": F.log(safe_div(fear, lag("fear"))), "rate_change": F.col("rate") - lag("rate")}
    return market.select("date", *[F.coalesce(e, F.lit(0.0)).alias(n) for n, e in features.items()])


def with_market(price: DataFrame, market: DataFrame) -> DataFrame:
    """The price block with the market block of the last date at or before each bar, and strength relative to it."""
    names = [c for c in market.columns if c != "date"]
    out = price.join(_on_dates(price, market, names), "date", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})
    return out.withColumns({f"rs_{n}": F.col(f"ret_{n}") - F.col(f"market_ret_{n}") for n in (1, 5)})


def _on_dates(price: DataFrame, market: DataFrame, names: list[str]) -> DataFrame:
    """The market's rows on the dates of the bars: a row per date on either side, so the carry needs no partition."""
    dates = price.select("date").distinct()
    rows = market.select("date", F.struct(*names).alias("_m")).join(dates.withColumn("_asked", F.lit(True)), "date", "full")
    carried = F.last("_m", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_m", carried).where("_asked").select("date", "_m.*")


def assembled(blocks: dict[str, DataFrame], bars: DataFrame, flags: dict[str, str] | None = None) -> DataFrame:
    """The wide table: the price block, the market block if its series is given, and of the further ones (by symbol and date, or by date) those enabled.

    Further blocks never cost a row: where they have none, or a null, their features are 0.
    """
    on = enabled_blocks(flags)
    out = price_block(bars)
    if "market" in blocks:
        out = with_market(out, market_block(blocks["market"]))
    for name in on:
        if name in blocks and name != "price":
            names = [c for c in blocks[name].columns if c not in KEYS]
            keys = [c for c in KEYS if c in blocks[name].columns]
            out = out.join(blocks[name], keys, "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    return out
