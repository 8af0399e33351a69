"""Measures of options chains, all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plausible volatilities, and strikes of the skew as shares of the spot.
IV_LOW, IV_HIGH, PUT_MONEY, CALL_MONEY = 0.01, 5.0, 0.9, 1.1


def clean(chain: DataFrame) -> DataFrame:
    """Contracts with a plausible volatility and some liquidity (a bid or open interest)."""
    liquid = (F.coalesce(F.col("bid"), F.lit(0.0)) > 0) | (F.coalesce(F.col("open_interest"), F.lit(0)) > 0)
    return chain.where((F.col("iv") > IV_LOW) & (F.col("iv") < IV_HIGH) & liquid & F.col("strike").isNotNull())


def nearest_expiry(expiries: DataFrame, today: Column, days: int) -> DataFrame:
    """Per symbol the expiry after today whose distance is nearest to ``days``; the earlier of two."""
    ahead = F.datediff("expiry", today)
    return expiries.where(ahead >= 1).groupBy("symbol").agg(F.min_by("expiry", F.struct(F.abs(ahead - days), "expiry")).alias("expiry"))


def chain_measures(chain: DataFrame, spots: DataFrame, today: Column, near_days: int = 30, far_days: int = 90) -> DataFrame:
    """From contracts (symbol, side, expiry, strike, iv, bid, open_interest, id) and spots (symbol, spot): near, far, atm_iv, skew, term_slope, n_contracts.

    The skew is the put's volatility below the spot less the call's above it; the term slope is NULL without a second expiry.
    Symbols without a usable contract at the near expiry are left out.
    """
    expiries = chain.select("symbol", "expiry").distinct()
    near = nearest_expiry(expiries, today, near_days).withColumnRenamed("expiry", "near")
    others = expiries.join(near, "symbol").where("expiry <> near").select("symbol", "expiry")
    dates = near.join(nearest_expiry(others, today, far_days).withColumnRenamed("expiry", "far"), "symbol", "left").join(spots, "symbol")
    rows = clean(chain).join(dates, "symbol").where("expiry = near or expiry = far")

    def at(side: str, expiry: str, money: float) -> Column:
        own = (F.col("side") == side) & (F.col("expiry") == F.col(expiry))
        return F.min_by(F.when(own, F.col("iv")), F.when(own, F.struct(F.abs(F.col("strike") - money * F.col("spot")), "id")))

    mean = lambda a, b: F.coalesce((F.col(a) + F.col(b)) / 2, a, b)
    out = rows.groupBy("symbol", "near", "far").agg(
        at("call", "near", 1.0).alias("_c"), at("put", "near", 1.0).alias("_p"), at("put", "near", PUT_MONEY).alias("_po"), at("call", "near", CALL_MONEY).alias("_co"),
        at("call", "far", 1.0).alias("_fc"), at("put", "far", 1.0).alias("_fp"), F.count(F.when(F.col("expiry") == F.col("near"), 1)).alias("n_contracts"),
    )
    out = out.select("symbol", "near", "far", mean("_c", "_p").alias("atm_iv"), (F.col("_po") - F.col("_co")).alias("skew"), (mean("_fc", "_fp") - mean("_c", "_p")).alias("term_slope"), "n_contracts")
    return out.where("n_contracts > 0 and (atm_iv is not null or skew is not null)")
