"""Positions and cash flow derived from append-only ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-9


def positions(trades: DataFrame) -> DataFrame:
    """Average-cost positions (user_id, symbol, quantity, cost, avg_price).

    A BUY adds quantity and cost; a SELL takes its share of the cost and never more than is held; what remains at
    or under 1e-9 is flat.  The fold runs over one user's trades in one symbol.
    """
    step = lambda acc, t: F.when(
        t["side"] == "BUY", F.struct((acc["q"] + t["quantity"]).alias("q"), (acc["c"] + t["quantity"] * t["price"]).alias("c")),
    ).when(
        acc["q"] - t["quantity"] > FLAT, F.struct((acc["q"] - t["quantity"]).alias("q"), (acc["c"] * (1 - t["quantity"] / acc["q"])).alias("c")),
    ).otherwise(F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("c")))
    ordered = F.sort_array(F.collect_list(F.struct("trade_date", "seq", "side", "quantity", "price")))
    p = trades.groupBy("user_id", "symbol").agg(F.aggregate(ordered, F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("c")), step).alias("p"))
    return p.select("user_id", "symbol", F.col("p.q").alias("quantity"), F.col("p.c").alias("cost"), F.try_divide("p.c", F.nullif("p.q", F.lit(0.0))).alias("avg_price"))


def valued(positions: DataFrame, quotes: DataFrame, fx: DataFrame) -> DataFrame:
    """Adds value, weight (percent of the user's priced holdings) and pnl_pct to open positions (with ``currency``).

    ``quotes`` has symbol and last, ``fx`` currency and rate; without either a position has NULLs and no part in the weights.
    """
    v = positions.where(F.col("quantity") > FLAT).join(quotes, "symbol", "left").join(fx, "currency", "left")
    v = v.withColumn("value", F.col("quantity") * F.col("last") * F.col("rate"))
    total = F.nullif(F.sum("value").over(Window.partitionBy("user_id")), F.lit(0.0))
    return v.withColumn("weight", 100 * F.col("value") / total).withColumn("pnl_pct", 100 * (F.col("value") - F.col("cost")) / F.nullif("cost", F.lit(0.0)))


def income(amount: Column) -> Column:
    return F.when(amount > 0, amount).otherwise(0.0)


def expense(amount: Column, category: Column, excluded: str) -> Column:
    """Money out, without the excluded category (investments)."""
    return F.when((amount < 0) & (category != excluded), -amount).otherwise(0.0)
