"""Selection rules, logs and copies, market regimes by date, and the options chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import r6
from ..operators.asof import asof_backward, latest_per_group
from ..operators.features import enabled_blocks, feature_columns  # noqa: F401
from ..operators.options import chain_measures
from ..registry import query
from ..sources.files import KeyedTable, append, copy_since, scratch
from ..sources.logical import bars, predictions, raw, ticks, twin

#: Symbols that are kept in the store but listed no more.
RETIRED = ("S7", "S13")


def listed(df: DataFrame, retired: tuple[str, ...] = RETIRED) -> DataFrame:
    return df.where(~F.coalesce(F.upper("symbol"), F.lit("")).isin(*retired))


@query("leaderboard", twin("SELECT symbol, id, confidence FROM (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY generated_at DESC) AS k FROM predictions) WHERE k = 1 AND symbol NOT IN ('S7', 'S13') ORDER BY confidence DESC, symbol LIMIT 50"))
def leaderboard(spark, sf_dir) -> DataFrame:
    """Latest prediction of each listed symbol, most confident first."""
    return latest_per_group(listed(predictions(spark, sf_dir)), ["symbol"], "generated_at").orderBy(F.desc("confidence"), "symbol").limit(50).select("symbol", "id", "confidence")


_REG = ("rg", "SELECT date, CASE WHEN v > 1.5::DOUBLE * avg(v) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) THEN 'risk_off' WHEN v > avg(v) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) THEN 'chop' ELSE 'trend' END AS regime FROM (SELECT date, avg(high - low) AS v FROM bars WHERE month(date) % 2 = 0 GROUP BY date)")


def with_regime(events: DataFrame, regimes: DataFrame, default: str = "trend") -> DataFrame:
    """Events (with ``date``) with the last regime at or before their date; before the first one the default.

    Regimes have one row per date.  They are first brought onto every date that occurs (one row per date), and joined to the events then.
    """
    dates = events.select("date").distinct().withColumn("_k", F.lit(0))
    on = asof_backward(dates, regimes.withColumn("_k", F.lit(0)), ["_k"], "date", ["regime"]).select("date", F.coalesce("regime", F.lit(default)).alias("regime"))
    return events.join(on, "date")


@query("regime_asof", twin("SELECT symbol, date, close, coalesce((SELECT arg_max(regime, rg.date) FROM rg WHERE rg.date <= bars.date), 'trend') AS regime FROM bars", _REG))
def regime_asof(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    b = bars(spark, sf_dir)
    m = b.where(F.month("date") % 2 == 0).groupBy("date").agg(F.avg(F.col("high") - F.col("low")).alias("v"))
    usual = F.avg("v").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # one row per date
    regimes = m.select("date", F.when(F.col("v") > 1.5 * usual, "risk_off").when(F.col("v") > usual, "chop").otherwise("trend").alias("regime"))
    return with_regime(b.select("symbol", "date", "close"), regimes)


@query("append_log", twin("SELECT id, symbol, price FROM ticks UNION ALL SELECT id, symbol, price FROM ticks WHERE id % 2 = 0"))
def append_log(spark, sf_dir) -> DataFrame:
    """Appends keep every row, repeated ones too."""
    path, t = scratch(spark, "log"), ticks(spark, sf_dir).select("id", "symbol", "price")
    append(t, path)
    append(t.where("id % 2 = 0"), path)
    return spark.read.schema(t.schema).parquet(path)


@query("bulk_copy", twin("SELECT symbol, date, close, (SELECT count(*) FROM bars b WHERE b.symbol = bars.symbol AND b.date >= DATE '2000-01-01')::BIGINT AS planned FROM bars WHERE date >= DATE '2000-01-01'"))
def bulk_copy(spark, sf_dir) -> DataFrame:
    """History since a date into a keyed table: a dry run, which writes nothing, then twice in earnest, which writes it once."""
    b = bars(spark, sf_dir).select("symbol", "date", "close")
    path = scratch(spark, "copy")
    target = KeyedTable(spark, path, ["symbol", "date"], "symbol string, date date, close double")
    plan = copy_since(b, target, "date", "2000-01-01", [F.col("close")])
    if not target.read().isEmpty():
        raise RuntimeError("a dry run has written")
    for _ in range(2):
        copy_since(b, target, "date", "2000-01-01", [F.col("close")], apply=True)
    return KeyedTable(spark, path, ["symbol", "date"], target.schema).read().join(plan.withColumnRenamed("n", "planned"), "symbol")


@query("point_skill", twin("SELECT symbol, round(mae, 6) AS mae, round(naive, 6) AS naive_mae, coalesce(mae > 0 AND naive > 0 AND 1 - mae / nullif(naive, 0) > 0, false) AS has_skill FROM (SELECT symbol, avg(abs((prob_up - 0.5::DOUBLE) * 0.2::DOUBLE - actual_return)) AS mae, avg(abs(actual_return)) AS naive FROM predictions p JOIN outcomes o ON o.prediction_id = p.id GROUP BY symbol)"))
def point_skill(spark, sf_dir) -> DataFrame:
    """Does a symbol's point forecast beat "no change"?  Without an error to compare there is no skill."""
    from .learning import resolved

    m = resolved(spark, sf_dir).groupBy("symbol").agg(F.avg(F.abs(F.col("pred") - F.col("actual_return"))).alias("mae"), F.avg(F.abs("actual_return")).alias("naive_mae"))
    return m.select("symbol", r6(F.col("mae")).alias("mae"), r6(F.col("naive_mae")).alias("naive_mae"), has_skill(F.col("mae"), F.col("naive_mae")).alias("has_skill"))


def has_skill(mae, naive, margin: float = 0.0):
    known = (F.coalesce(mae, F.lit(0.0)) > 0) & (F.coalesce(naive, F.lit(0.0)) > 0)
    return known & F.coalesce(1 - mae / F.nullif(naive, F.lit(0.0)) > margin, F.lit(False))


_CHAIN = ("ch", """SELECT 'S' || (user_id % 20)::VARCHAR AS symbol, CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'put' END AS side, (DATE '2024-01-28' + (event_id % 9 * 12)::INT)::DATE AS expiry, 40 + (event_id * 7) % 41 AS strike, CASE WHEN event_id % 17 <> 0 THEN value / 37 END AS iv,
    CASE WHEN event_id % 4 = 0 THEN 0::DOUBLE WHEN event_id % 4 = 1 THEN NULL ELSE 1::DOUBLE END AS bid, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN NULL ELSE 5 END AS open_interest, event_id AS id FROM events""")


def _near(side: str, expiry: str, money: str) -> str:
    return f"(SELECT arg_min(iv, (abs(strike - {money} * 60::DOUBLE), id)) FROM ok WHERE ok.symbol = e.symbol AND ok.expiry = e.{expiry} AND side = '{side}')"


def _mean(a: str, b: str) -> str:
    return f"coalesce(({a} + {b}) / 2, {a}, {b})"


_EXPIRY = "(SELECT arg_min(expiry, (abs(expiry - DATE '2024-02-01' - {days}), expiry)) FROM (SELECT DISTINCT symbol, expiry FROM ch) c WHERE c.symbol = s.symbol AND expiry > DATE '2024-02-01' {but})"


@query("options_chain", twin(f"""SELECT symbol, near, far, round(atm, 4) AS atm_iv, round(po - co, 4) AS skew, round(fatm - atm, 4) AS term_slope, n::BIGINT AS n_contracts FROM (
    SELECT *, {_mean('c', 'p')} AS atm, {_mean('fc', 'fp')} AS fatm FROM (SELECT symbol, near, far, {_near('call', 'near', '1')} AS c, {_near('put', 'near', '1')} AS p, {_near('put', 'near', '0.9')} AS po, {_near('call', 'near', '1.1')} AS co,
      {_near('call', 'far', '1')} AS fc, {_near('put', 'far', '1')} AS fp, (SELECT count(*) FROM ok WHERE ok.symbol = e.symbol AND ok.expiry = e.near) AS n
    FROM (SELECT symbol, near, {_EXPIRY.format(days=90, but='AND expiry <> s.near')} AS far FROM (SELECT symbol, {_EXPIRY.format(days=30, but='')} AS near FROM (SELECT DISTINCT symbol FROM ch) s) s) e)) WHERE n > 0 AND (atm IS NOT NULL OR po - co IS NOT NULL)""", _CHAIN, ("ok", "SELECT * FROM ch WHERE iv > 0.01::DOUBLE AND iv < 5 AND (bid > 0 OR open_interest > 0)")))
def options_chain(spark, sf_dir) -> DataFrame:
    """Volatility at the money, skew and term slope of each symbol's chain, by the nearest expiries to 30 and 90 days."""
    e, i = raw(spark, sf_dir, "events"), F.col("event_id")
    chain = e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("symbol"), F.when(i % 2 == 0, "call").otherwise("put").alias("side"), F.date_add(F.lit("2024-01-28").cast("date"), (i % 9 * 12).cast("int")).alias("expiry"), (40 + (i * 7) % 41).alias("strike"),
        F.when(i % 17 != 0, F.col("value") / 37).alias("iv"), F.when(i % 4 == 0, 0.0).when(i % 4 != 1, 1.0).alias("bid"), F.when(i % 3 == 0, 0).when(i % 3 != 1, 5).alias("open_interest"), i.alias("id"),
    )
    spots = chain.select("symbol").distinct().withColumn("spot", F.lit(60.0))
    out = chain_measures(chain, spots, F.lit("2024-02-01").cast("date"))
    fixed = lambda c: F.round(c, 4).alias(c)
    return out.select("symbol", "near", "far", fixed("atm_iv"), fixed("skew"), fixed("term_slope"), "n_contracts")
