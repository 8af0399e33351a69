"""Cross-sections and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def market_returns(returns: DataFrame, span: int = 5) -> DataFrame:
    """Equal-weight mean return ``m`` of all symbols by date, and its trailing sum ``m_span`` over ``span`` dates.

    The window runs over one row per date, which is why it needs no partitioning.
    """
    m = returns.groupBy("date").agg(F.avg("r").alias("m"))
    w = Window.orderBy("date").rowsBetween(-(span - 1), 0)
    return m.withColumn("m_span", F.when(F.count("m").over(w) >= span, F.sum("m").over(w)))


def neutralise(df: DataFrame, ret: str, mode: str) -> DataFrame:
    """Residual of ``ret`` within each date: mode none, market, sector, beta or sector_beta; fewer than three names stay raw.

    Where betas hardly differ the beta mode only demeans.
    """
    day, cell = Window.partitionBy("date"), Window.partitionBy("date", "sector")
    x = F.col(ret)
    if mode in ("sector", "sector_beta"):
        df = df.withColumn("_x", x - F.avg(x).over(cell))
    else:
        df = df.withColumn("_x", x)
    if mode == "market":
        res = F.col("_x") - F.avg("_x").over(day)
    elif mode in ("beta", "sector_beta"):
        spread = F.stddev_pop("beta").over(day)
        slope = F.when(spread < 1e-9, 0.0).otherwise(F.covar_pop("_x", "beta").over(day) / F.nullif(F.var_pop("beta").over(day), F.lit(0.0)))
        res = F.col("_x") - F.avg("_x").over(day) - slope * (F.col("beta") - F.avg("beta").over(day))
    else:
        res = F.col("_x")
    return df.withColumn("residual", F.when(F.count(F.lit(1)).over(day) < 3, x).otherwise(res)).drop("_x")


def top_fraction(df: DataFrame, score: str, frac: float, tie: str = "symbol", lowest: bool = False) -> DataFrame:
    """Per date the k best names, k = max(1, half-even round of frac * names)."""
    day = Window.partitionBy("date")
    order = day.orderBy(F.col(score) if lowest else F.desc(score), tie)
    df = df.withColumn("_k", F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(day) * F.lit(frac)))).withColumn("_n", F.row_number().over(order))
    return df.where("_n <= _k").drop("_k", "_n")


def leg_weights(df: DataFrame, kelly: bool = True, inverse_vol: bool = True, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Weights that sum to 1 within each group: quarter-Kelly of ``meta``, over volatility.

    A name without an edge takes the mean Kelly share of those that have one; a missing volatility is the group's median; where
    nothing is left to tell names apart they weigh the same.
    """
    group = Window.partitionBy(*by)
    tilt = F.lit(1.0)
    if inverse_vol:
        vol = F.when(F.col("vol") > 0, F.col("vol"))
        tilt = 1 / F.coalesce(vol, F.median(vol).over(group), F.lit(1.0))
    if kelly:
        share = kelly_fraction(F.coalesce("meta", F.lit(0.5)))
        usual = F.coalesce(F.avg(F.when(share > 0, share)).over(group), F.lit(1.0))
        tilt = tilt * F.when(share > 0, share).otherwise(usual)
    total = F.sum("_w").over(group)
    return df.withColumn("_w", tilt).withColumn("weight", F.when(total > 1e-12, F.col("_w") / F.nullif(total, F.lit(0.0))).otherwise(1 / F.count(F.lit(1)).over(group))).drop("_w")


def simulate(panel: DataFrame, dates: DataFrame, frac: float = 0.2, long_short: bool = True, use_regime: bool = True, meta_gate: float = 0.0, mode: str = "none", kelly: bool = True, inverse_vol: bool = True, cost: float = 0.0005) -> DataFrame:
    """One return per rebalance date: the weighted top ``frac`` by score, less the weighted bottom one if ``long_short``, half each.

    Each leg costs ``cost`` before the legs are halved; the whole period is scaled by regime.  With a neutralising ``mode`` the legs
    earn residual returns.  Both legs come out of one ranking of each date.
    """
    day = Window.partitionBy("date")
    p = panel.join(dates, "date")
    p = p.where(F.coalesce("meta", F.lit(0.0)) >= meta_gate) if meta_gate > 0 else p
    p = neutralise(p, "ret", mode)
    n = F.count(F.lit(1)).over(day)
    p = p.withColumns({"_n": n, "_k": F.greatest(F.lit(1), F.bround(n * F.lit(frac))), "_at": F.row_number().over(day.orderBy(F.desc("score"), "symbol"))})
    leg = F.when(F.col("_at") <= F.col("_k"), "long").when(F.lit(long_short) & (F.col("_at") > F.col("_n") - F.col("_k")), "short")
    p = leg_weights(p.withColumn("_leg", leg).where("_leg is not null"), kelly, inverse_vol, ("date", "_leg"))
    side = lambda name, sign: F.sum(F.when(F.col("_leg") == name, sign * F.col("weight") * F.col("residual")))
    sums = p.groupBy("date").agg(side("long", 1) .alias("_up"), side("short", -1).alias("_down"), F.min("regime").alias("regime"), F.max("_n").alias("breadth"), F.max("_k").cast("long").alias("n_leg"))
    up = F.col("_up") - cost
    period = 0.5 * up + 0.5 * (F.col("_down") - cost) if long_short else up
    return sums.select("date", (period * regime_scale(F.col("regime")) if use_regime else period).alias("ret"), "breadth", "n_leg")


def vol_target(returns: DataFrame, ret: str, target: float, least: int = 10, most: float = 3.0) -> DataFrame:
    """Adds ``leverage`` and ``scaled`` = leverage * ``ret`` to returns (one row per date, hence the unpartitioned window).

    Leverage is target over the deviation of all earlier dates, ``most`` at most; 1 before ``least`` of them and where they do
    not deviate.
    """
    past = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    sd = F.stddev_samp(ret).over(past)
    lever = F.when((F.count(ret).over(past) < least) | (sd <= 1e-12), 1.0).otherwise(F.least(F.lit(most), target / F.nullif(sd, F.lit(0.0))))
    return returns.withColumn("leverage", lever).withColumn("scaled", F.col("leverage") * F.col(ret))


def spaced_dates(dates: DataFrame, next_date) -> DataFrame:
    """From the distinct dates those that a non-overlapping grid takes; ``next_date`` maps a taken date to the earliest next one.

    The fold runs over one array of calendar dates, whose length does not depend on the number of rows.
    """
    kept = F.aggregate(
        F.sort_array(F.collect_set("date")), F.struct(F.lit(None).cast("date").alias("next"), F.array().cast("array<date>").alias("taken")),
        lambda acc, d: F.when(acc["next"].isNull() | (d >= acc["next"]), F.struct(next_date(d).alias("next"), F.concat(acc["taken"], F.array(d)).alias("taken"))).otherwise(acc),
        lambda acc: acc["taken"],  # the appends copy a list of at most one date in ten weekdays
    )
    return dates.agg(kept.alias("dates")).select(F.explode("dates").alias("date"))


def kelly_fraction(p, b: float = 1.0, frac: float = 0.25, cap: float = 0.5):
    f = (p * b - (1 - p)) / b
    return F.when((p <= 0) | (p >= 1) | (f <= 0), 0.0).otherwise(F.least(F.lit(cap), frac * f))


def regime_scale(c):
    return F.when(c == "chop", 0.6).when(c == "risk_off", 0.25).otherwise(1.0)


def performance(df: DataFrame, r: str, by: list[str], order: str, periods: float) -> DataFrame:
    """Sharpe (sample deviation), worst drawdown, profit factor (infinite without losses), win rate, total and annual return of each group's return stream."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(r)
    df = df.withColumn("_e", F.product(1 + x).over(w))
    df = df.withColumn("_dd", F.col("_e") / F.max("_e").over(w) - 1)
    sd = F.stddev_samp(x)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.when((F.count(x) < 2) | (sd == 0), 0.0).otherwise(F.avg(x) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(periods))).alias("sharpe"), F.min("_dd").alias("max_drawdown"),
        F.when(F.sum(F.when(x < 0, x).otherwise(0.0)) == 0, float("inf")).otherwise(F.try_divide(F.sum(F.when(x > 0, x).otherwise(0.0)), -F.sum(F.when(x < 0, x).otherwise(0.0)))).alias("profit_factor"), F.avg((x > 0).cast("int")).alias("win_rate"), (F.max_by("_e", order) - 1).alias("total_return"), (F.pow(1 + F.avg(x), F.lit(periods)) - 1).alias("annual_return"), sd.alias("deviation"),
    )
