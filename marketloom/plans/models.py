"""Models and sequential series: boosted trees over purged folds, regime filter, volatility and autoregressive baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import r6, safe_div
from ..operators import windows as w
from ..operators.fracdiff import fracdiff, weights
from ..operators.labels import uniqueness
from ..operators.recursive import smooth_sql, smoothed
from ..operators.regimes import decode
from ..operators.training import fold_rows, stored, walk_forward
from ..registry import query
from ..sources.logical import SQL, bars, twin
from .learning import events, stored_bars

_W = "(PARTITION BY symbol ORDER BY date"
#: Boosted trees of the narrow models; on 8,382 events twenty take hardly longer than five (13.5 and 12.7 s for six folds on eight cores) and rank better.
TREES = 20
INPUTS = ["sma5", "sma20", "vol20", "r1", "r5"]


def features(spark, sf_dir, b: DataFrame | None = None) -> DataFrame:
    """A feature row for every labelled event, weighted by its uniqueness; ``b``: the bars if they are stored already."""
    c = F.col("close")
    b = (stored_bars(spark, sf_dir) if b is None else b).withColumn("r", w.log_return(c))
    f = b.select("symbol", "date", (c / w.rmean(c, 5) - 1).alias("sma5"), (c / w.rmean(c, 20) - 1).alias("sma20"), w.rstd(F.col("r"), 20).alias("vol20"), F.col("r").alias("r1"), w.log_return(c, 5).alias("r5"))
    e = events(spark, sf_dir, b)
    rows = e.join(f, ["symbol", "date"]).join(uniqueness(e, b), ["symbol", "date"])
    return stored(rows.dropna().withColumn("y", (F.col("label") > 0).cast("double")), "features")  # read by every fold and count


def learner(kind: str, trees: int = TREES, depth: int = 3):
    """Boosted trees for the direction, for the first model's being right or for the return; or the elastic-net logistic base."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.regression import GBTRegressor

    if kind == "logistic":
        return LogisticRegression(featuresCol="_x", labelCol="y", elasticNetParam=0.5, regParam=0.01)
    boosted = {"maxIter": trees, "maxDepth": depth, "seed": 7, "featuresCol": "_x"}
    if kind == "gbt_return":
        return GBTRegressor(labelCol="ret", **boosted)
    return GBTClassifier(labelCol="right" if kind == "gbt_meta" else "y", **boosted)


def out_of_fold(rows: DataFrame, model: str) -> DataFrame:
    """Scores of test rows by a model trained on the purged rows before them: six walk-forward folds, as in the surveyed evaluation.

    A fold without training rows is left out; the last one reaches the last event.
    """
    return walk_forward(fold_rows(rows), learner(model), INPUTS).select("symbol", "date", "fold", "y", "p")


@query("oof_gbt")
def oof_gbt(spark, sf_dir) -> DataFrame:
    return out_of_fold(features(spark, sf_dir), "gbt").withColumn("p", r6(F.col("p")))


@query("oof_logistic")
def oof_logistic(spark, sf_dir) -> DataFrame:
    return out_of_fold(features(spark, sf_dir), "logistic").withColumn("p", r6(F.col("p")))


_VOL = ("WITH RECURSIVE bars AS (" + SQL["bars"] + f"),\nr2 AS (SELECT symbol, date, pow(ln(close / lag(close) OVER {_W})), 2) AS x FROM bars),\n" + smooth_sql("r2", "x", 0.06, "e", 10)
    + "\nSELECT symbol, date, round(sqrt(y), 6) AS vol, round(sqrt(5 * y), 6) AS vol_5 FROM e")


@query("ewma_conditional_vol", _VOL)
def ewma_conditional_vol(spark, sf_dir) -> DataFrame:
    """Conditional volatility with decay 0.94 and its five-step forecast, the fallback of the GARCH model."""
    b = _smoothed_squares(spark, sf_dir)
    return b.select("symbol", "date", r6(F.sqrt("y")).alias("vol"), r6(F.sqrt(5 * F.col("y"))).alias("vol_5"))


def _smoothed_squares(spark, sf_dir, b: DataFrame | None = None) -> DataFrame:
    b = (bars(spark, sf_dir) if b is None else b).select("symbol", "date", F.pow(w.log_return(F.col("close")), 2).alias("x"))
    return smoothed(b, {"y": ("x", 0.06, 10)})


def conditional_scale(spark, sf_dir, b: DataFrame | None = None) -> DataFrame:
    """symbol, date, scale: the volatility forecast for the five bars to come."""
    return _smoothed_squares(spark, sf_dir, b).select("symbol", "date", F.sqrt(5 * F.col("y")).alias("scale"))


@query("ar1_baseline", twin("SELECT symbol, round(regr_slope(x, b), 6) AS phi, round(regr_intercept(x, b), 6) AS c, round(avg((sign(x) = sign(b))::INT), 6) AS persistence, count(*)::BIGINT AS n FROM (SELECT symbol, x, lag(x) OVER (PARTITION BY symbol ORDER BY date) AS b FROM (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS x FROM bars)) WHERE x IS NOT NULL AND b IS NOT NULL GROUP BY symbol"))
def ar1_baseline(spark, sf_dir) -> DataFrame:
    """First-order autoregression of returns per symbol, by least squares."""
    r = bars(spark, sf_dir).select("symbol", "date", w.log_return(F.col("close")).alias("x")).withColumn("b", w.lag(F.col("x"))).where("x is not null and b is not null")
    return r.groupBy("symbol").agg(r6(F.regr_slope("x", "b")).alias("phi"), r6(F.regr_intercept("x", "b")).alias("c"), r6(F.avg((F.signum("x") == F.signum("b")).cast("int"))).alias("persistence"), F.count(F.lit(1)).alias("n"))


#: The published small-sample surface of the Dickey-Fuller p-value with a constant, and the normal quantile of 5 percent.
_SURFACE, _FIVE_PERCENT = (2.1659, 1.4412, 0.038269), -1.6448536269514722
_ADF_SQL = """SELECT {by}, CASE WHEN n >= 48 THEN b / sqrt((syy - b * sy1 - (sy2 * s11 - sy1 * s12) / det * sy2) / (n - 3) * s22 / det) END AS t, n FROM
  (SELECT *, s11 * s22 - s12 * s12 AS det, (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) AS b FROM (SELECT {by}, count(*) AS n, covar_pop(y, y) * count(*) AS syy, covar_pop(y, x1) * count(*) AS sy1, covar_pop(y, x2) * count(*) AS sy2,
    covar_pop(x1, x1) * count(*) AS s11, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x2, x2) * count(*) AS s22 FROM
    (SELECT {by}, x - lag(x) OVER w AS y, lag(x) OVER w AS x1, lag(x) OVER w - lag(x, 2) OVER w AS x2 FROM {src} WHERE x IS NOT NULL WINDOW w AS (PARTITION BY {by} ORDER BY date)) WHERE x2 IS NOT NULL GROUP BY {by}))"""


def adf(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per series (rows with ``x`` by date) the augmented Dickey-Fuller t with a constant and one lagged difference, and whether p < 0.05.

    Series of fewer than fifty values count as not stationary.  The regression on two columns is solved from its centred sums, so
    a series is only aggregated.
    """
    order = Window.partitionBy(*keys).orderBy("date")
    x = F.col("x")
    rows = df.where("x is not null").select(*keys, (x - F.lag(x).over(order)).alias("y"), F.lag(x).over(order).alias("x1"), (F.lag(x).over(order) - F.lag(x, 2).over(order)).alias("x2")).where("x2 is not null")
    both = lambda a, b: (F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"s{a[-1]}{b[-1]}")
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), both("y", "y"), both("y", "x1"), both("y", "x2"), both("x1", "x1"), both("x1", "x2"), both("x2", "x2"))
    s = s.withColumn("det", F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")).withColumn("b", F.try_divide(F.col("sy1") * F.col("s22") - F.col("sy2") * F.col("s12"), F.col("det")))
    lagged = F.try_divide(F.col("sy2") * F.col("s11") - F.col("sy1") * F.col("s12"), F.col("det"))
    rest = F.col("syy") - F.col("b") * F.col("sy1") - lagged * F.col("sy2")
    t = F.when(F.col("n") >= 48, F.try_divide(F.col("b"), F.sqrt(rest / (F.col("n") - 3) * F.col("s22") / F.col("det"))))
    surface = _SURFACE[0] + _SURFACE[1] * F.col("t") + _SURFACE[2] * F.col("t") * F.col("t")
    return s.withColumn("t", t).select(*keys, "t", (F.coalesce(surface < _FIVE_PERCENT, F.lit(False)) & (F.col("t") > -18.83) | F.coalesce(F.col("t") <= -18.83, F.lit(False))).alias("stationary"))


_P_SQL = f"coalesce(t <= -18.83::DOUBLE OR {_SURFACE[0]!r}::DOUBLE + {_SURFACE[1]!r}::DOUBLE * t + {_SURFACE[2]!r}::DOUBLE * t * t < {_FIVE_PERCENT!r}::DOUBLE, false)"


@query("adf_statistic", twin(f"SELECT symbol, round(t, 4) AS t_stat, {_P_SQL} AS stationary FROM ({_ADF_SQL.format(by='symbol', src='(SELECT symbol, date, ln(close) AS x FROM bars)')})"))
def adf_statistic(spark, sf_dir) -> DataFrame:
    """Is the log price stationary?"""
    return adf(bars(spark, sf_dir).select("symbol", "date", F.log("close").alias("x")), ["symbol"]).select("symbol", F.round("t", 4).alias("t_stat"), "stationary")


ORDERS = tuple(k / 10 for k in range(1, 11))


def least_order(b: DataFrame, orders: tuple[float, ...] = ORDERS) -> DataFrame:
    """Per symbol the smallest order whose fractionally differenced log price is stationary; 1 if none is."""
    for k, d in enumerate(orders):
        b = fracdiff(b, F.log("close"), d, f"_d{k}")  # one sort for all orders
    pairs = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_d{k}").alias("x")) for k, d in enumerate(orders)])
    tests = adf(b.select("symbol", "date", F.explode(pairs).alias("p")).select("symbol", "date", "p.d", "p.x"), ["symbol", "d"])
    return b.select("symbol").distinct().join(tests.where("stationary").groupBy("symbol").agg(F.min("d").alias("d")), "symbol", "left").select("symbol", F.coalesce("d", F.lit(1.0)).alias("d"))


def _order_sql() -> str:
    parts = []
    for d in ORDERS:
        c = weights(d)
        dot = " + ".join(f"{float(v)!r}::DOUBLE * lag(lx, {i}) OVER w" for i, v in reversed(list(enumerate(c))))
        parts.append(f"SELECT symbol, {d!r}::DOUBLE AS d, date, {dot} AS x FROM (SELECT symbol, date, ln(close) AS lx FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY date)")
    return " UNION ALL ".join(parts)


@query("least_ffd_order", twin(f"SELECT symbol, coalesce(min(d) FILTER (WHERE {_P_SQL}), 1) AS d FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN ({_ADF_SQL.format(by='symbol, d', src='fd')}) USING (symbol) GROUP BY symbol", ("fd", _order_sql())))
def least_ffd_order(spark, sf_dir) -> DataFrame:
    return least_order(bars(spark, sf_dir).select("symbol", "date", "close"))


def regimes(spark, sf_dir, b: DataFrame | None = None) -> DataFrame:
    """Regimes of each symbol from its trend, its turbulence and its range; only past bars enter a bar's probabilities."""
    b = (bars(spark, sf_dir) if b is None else b).withColumn("r", w.log_return(F.col("close")))
    b = b.select("symbol", "date", w.log_return(F.col("close"), 20).alias("ret20"), w.rstd(F.col("r"), 20).alias("vol20"), F.log(w.rmean((F.col("high") - F.col("low")) / F.col("close"), 5) + 1e-6).alias("fear"))
    return decode(b, "symbol", ["ret20", "vol20", "fear"])


@query("regime_filter")
def regime_filter(spark, sf_dir) -> DataFrame:
    d = regimes(spark, sf_dir)
    return d.select("symbol", "date", "regime", *[r6(F.col(c)).alias(c) for c in ("p_risk_off", "p_chop", "p_trend")])


@query("feature_matrix", twin(f"""SELECT symbol, date, round(close / (CASE WHEN count(close) OVER s5 >= 5 THEN avg(close) OVER s5 END) - 1, 6) AS sma5, round(close / (CASE WHEN count(close) OVER s20 >= 20 THEN avg(close) OVER s20 END) - 1, 6) AS sma20, round(ln(close / lag(close) OVER {_W})), 6) AS r1,
    round((high - low) / close, 6) AS span, round(volume / (CASE WHEN count(volume) OVER s20 >= 20 THEN avg(volume) OVER s20 END + 1), 6) AS vol_ratio FROM bars WINDOW s5 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), s20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))
def feature_matrix(spark, sf_dir) -> DataFrame:
    """Several blocks in one select: one exchange and one sort."""
    c, v = F.col("close"), F.col("volume")
    return bars(spark, sf_dir).select("symbol", "date", r6(c / w.rmean(c, 5) - 1).alias("sma5"), r6(c / w.rmean(c, 20) - 1).alias("sma20"), r6(w.log_return(c)).alias("r1"), r6(safe_div(F.col("high") - F.col("low"), c)).alias("span"), r6(v / (w.rmean(v, 20) + 1)).alias("vol_ratio"))


@query("sequence_windows", twin("SELECT symbol, date, len(x)::INT AS n, round(list_aggregate(x, 'sum'), 5) AS total, round(fwd, 6) AS fwd FROM (SELECT symbol, date, list(r) OVER s AS x, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd FROM (SELECT symbol, date, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM bars) WHERE r IS NOT NULL WINDOW s AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE len(x) = 30 AND fwd IS NOT NULL"))
def sequence_windows(spark, sf_dir) -> DataFrame:
    """Windows of thirty returns with the forward return over five bars."""
    c = F.col("close")
    b = bars(spark, sf_dir).withColumn("r", w.log_return(c)).where("r is not null")
    b = b.select("symbol", "date", F.collect_list("r").over(w.trailing(30)).alias("x"), (F.lead(c, 5).over(w.by()) / c - 1).alias("fwd")).where((F.size("x") == 30) & F.col("fwd").isNotNull())
    return b.select("symbol", "date", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"), r6(F.col("fwd")).alias("fwd"))
