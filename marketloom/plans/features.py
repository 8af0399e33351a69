"""Price features: windows and recursions over weekly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import r6, safe_div
from ..operators import windows as w
from ..operators.fracdiff import fracdiff, weights
from ..operators.portfolio import market_returns
from ..operators.recursive import smooth_sql, smoothed, span
from ..registry import query
from ..sources.logical import SQL, bars, twin

_W = "(PARTITION BY symbol ORDER BY date"


def _over(n: int) -> str:
    return f"OVER {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(agg: str, c: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({c}) {_over(n)} >= {least or n} THEN {agg}({c}) {_over(n)} END"


_RET = f"ln(close / lag(close) OVER {_W}))"


@query("feat_sma_rvol", twin(f"SELECT symbol, date, round(close / ({_roll('avg', 'close', 20)}) - 1, 6) AS sma20, round({_roll('stddev_samp', 'r', 20)}, 6) AS rvol20 FROM r", ("r", f"SELECT *, {_RET} AS r FROM bars")))
def feat_sma_rvol(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("r", w.log_return(F.col("close")))
    return b.select("symbol", "date", r6(F.col("close") / w.rmean(F.col("close"), 20) - 1).alias("sma20"), r6(w.rstd(F.col("r"), 20)).alias("rvol20"))


@query("feat_sma", twin("SELECT symbol, date, " + ", ".join(f"round(close / ({_roll('avg', 'close', n)}) - 1, 6) AS sma_{n}" for n in (5, 10, 20, 50, 200)) + " FROM bars"))
def feat_sma(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "date", *[r6(F.col("close") / w.rmean(F.col("close"), n) - 1).alias(f"sma_{n}") for n in (5, 10, 20, 50, 200)])


@query("feat_rvol", twin(f"SELECT symbol, date, round({_roll('stddev_samp', 'r', 5)}, 6) AS rvol_5, round({_roll('stddev_samp', 'r', 20)}, 6) AS rvol_20 FROM r", ("r", f"SELECT *, {_RET} AS r FROM bars")))
def feat_rvol(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("r", w.log_return(F.col("close")))
    return b.select("symbol", "date", *[r6(w.rstd(F.col("r"), n)).alias(f"rvol_{n}") for n in (5, 20)])


@query("feat_returns_gap", twin("SELECT symbol, date, " + ", ".join(f"round(ln(close / lag(close, {n}) OVER {_W})), 6) AS ret_{n}" for n in (1, 5, 10, 20)) + f", round(open / lag(close) OVER {_W}) - 1, 6) AS gap, round((high - low) / close, 6) AS intraday FROM bars"))
def feat_returns_gap(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "date", *[r6(w.log_return(F.col("close"), n)).alias(f"ret_{n}") for n in (1, 5, 10, 20)], r6(safe_div(F.col("open"), w.lag(F.col("close"))) - 1).alias("gap"), r6((F.col("high") - F.col("low")) / F.col("close")).alias("intraday"))


@query("feat_stoch_williams", twin(f"""SELECT symbol, date, round(k, 6) AS stoch_k, round({_roll('avg', 'k', 3)}, 6) AS stoch_d, round(roc, 6) AS roc_10, round(wr, 6) AS williams_r FROM s""",
    ("s", f"SELECT symbol, date, 100 * (close - lo) / nullif(hi - lo, 0) AS k, close / lag(close, 10) OVER {_W}) - 1 AS roc, -100 * (hi - close) / nullif(hi - lo, 0) + 0 AS wr FROM (SELECT *, {_roll('min', 'low', 14)} AS lo, {_roll('max', 'high', 14)} AS hi FROM bars)")))
def feat_stoch_williams(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("lo", w.rolling(F.min, F.col("low"), 14)).withColumn("hi", w.rolling(F.max, F.col("high"), 14))
    width = F.col("hi") - F.col("lo")
    b = b.withColumn("k", safe_div(100 * (F.col("close") - F.col("lo")), width))
    return b.select("symbol", "date", r6(F.col("k")).alias("stoch_k"), r6(w.rmean(F.col("k"), 3)).alias("stoch_d"), r6(w.change(F.col("close"), 10)).alias("roc_10"), r6(safe_div(-100 * (F.col("hi") - F.col("close")), width)).alias("williams_r"))


@query("feat_bollinger", twin("SELECT symbol, date, round(4 * sd / ma, 6) AS bb_width, round((close - (ma - 2 * sd)) / nullif(4 * sd, 0), 6) AS bb_pct FROM s", ("s", f"SELECT symbol, date, close, {_roll('avg', 'close', 20)} AS ma, {_roll('stddev_samp', 'close', 20)} AS sd FROM bars")))
def feat_bollinger(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).select("symbol", "date", "close", w.rmean(F.col("close"), 20).alias("ma"), w.rstd(F.col("close"), 20).alias("sd"))
    return b.select("symbol", "date", r6(4 * F.col("sd") / F.col("ma")).alias("bb_width"), r6(safe_div(F.col("close") - (F.col("ma") - 2 * F.col("sd")), 4 * F.col("sd"))).alias("bb_pct"))


@query("feat_obv_volume", twin(f"SELECT symbol, date, round((obv - lag(obv, 5) OVER {_W})) / (m + 1), 6) AS obv_slope, round(volume / (m + 1), 6) AS volume_ratio FROM o",
    ("o", f"SELECT *, {_roll('avg', 'volume', 20)} AS m, sum(coalesce(sign(d), 0) * volume) OVER {_W} ROWS UNBOUNDED PRECEDING) AS obv FROM (SELECT *, close - lag(close) OVER {_W}) AS d FROM bars)")))
def feat_obv_volume(spark, sf_dir) -> DataFrame:
    v = F.col("volume")
    b = bars(spark, sf_dir).withColumn("d", F.col("close") - w.lag(F.col("close"))).withColumn("m", w.rmean(v, 20))
    b = b.withColumn("obv", F.sum(F.coalesce(F.signum("d"), F.lit(0.0)) * v).over(w.by().rowsBetween(Window.unboundedPreceding, 0)))
    return b.select("symbol", "date", r6((F.col("obv") - w.lag(F.col("obv"), 5)) / (F.col("m") + 1)).alias("obv_slope"), r6(v / (F.col("m") + 1)).alias("volume_ratio"))


@query("feat_mfi", twin(f"SELECT symbol, date, round(100 - 100 / (1 + {_roll('sum', 'up', 14)} / nullif({_roll('sum', 'down', 14)}, 0)), 6) AS mfi_14 FROM f",
    ("f", f"SELECT symbol, date, CASE WHEN d > 0 THEN tp * volume ELSE 0 END AS up, CASE WHEN d < 0 THEN tp * volume ELSE 0 END AS down FROM (SELECT *, tp - lag(tp) OVER {_W}) AS d FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars))")))
def feat_mfi(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.withColumn("d", F.col("tp") - w.lag(F.col("tp"))).withColumn("flow", F.col("tp") * F.col("volume"))
    up, down = F.when(F.col("d") > 0, F.col("flow")).otherwise(0.0), F.when(F.col("d") < 0, F.col("flow")).otherwise(0.0)
    b = b.withColumn("up", up).withColumn("down", down)
    return b.select("symbol", "date", r6(100 - safe_div(F.lit(100.0), 1 + safe_div(w.rsum(F.col("up"), 14), w.rsum(F.col("down"), 14)))).alias("mfi_14"))


@query("feat_calendar", twin("SELECT symbol, date, round(sin(2 * pi() * dow / 5), 6) AS dow_sin, round(cos(2 * pi() * dow / 5), 6) AS dow_cos, month(date)::INT AS month, (date = last_day(date))::INT AS month_end FROM (SELECT *, isodow(date) - 1 AS dow FROM bars)"))
def feat_calendar(spark, sf_dir) -> DataFrame:
    angle = 2 * F.pi() * F.weekday("date") / 5
    return bars(spark, sf_dir).select("symbol", "date", r6(F.sin(angle)).alias("dow_sin"), r6(F.cos(angle)).alias("dow_cos"), F.month("date").alias("month"), (F.col("date") == F.last_day("date")).cast("int").alias("month_end"))


@query("feat_fracdiff", twin(f"SELECT symbol, date, CASE WHEN len(x) = {len(weights(0.4))} THEN round(list_dot_product(x, [{', '.join(repr(float(v)) + '::DOUBLE' for v in weights(0.4)[::-1])}]), 6) END AS fracdiff_04 FROM (SELECT symbol, date, list(ln(close)) {_over(len(weights(0.4)))} AS x FROM bars)"))
def feat_fracdiff(spark, sf_dir) -> DataFrame:
    return fracdiff(bars(spark, sf_dir), F.log("close"), 0.4, "fracdiff_04").select("symbol", "date", r6(F.col("fracdiff_04")).alias("fracdiff_04"))


def _ema_twin(*steps: str, body: str) -> str:
    return f"WITH RECURSIVE bars AS ({SQL['bars']}),\n" + ",\n".join(steps) + "\n" + body


@query("feat_macd", _ema_twin(smooth_sql("bars", "close", span(12), "e12"), smooth_sql("bars", "close", span(26), "e26"), "line AS (SELECT symbol, date, a.y - b.y AS l FROM e12 a JOIN e26 b USING (symbol, date))", smooth_sql("line", "l", span(9), "sig"),
    body="SELECT symbol, date, round(l / close, 6) AS macd, round(sig.y / close, 6) AS macd_signal, round((l - sig.y) / close, 6) AS macd_hist FROM line JOIN sig USING (symbol, date) JOIN bars USING (symbol, date)"))
def feat_macd(spark, sf_dir) -> DataFrame:
    b = smoothed(bars(spark, sf_dir).select("symbol", "date", "close"), {"fast": ("close", span(12), 0), "slow": ("close", span(26), 0)}).withColumn("line", F.col("fast") - F.col("slow"))
    b = smoothed(b, {"sig": ("line", span(9), 0)})
    return b.select("symbol", "date", r6(F.col("line") / F.col("close")).alias("macd"), r6(F.col("sig") / F.col("close")).alias("macd_signal"), r6((F.col("line") - F.col("sig")) / F.col("close")).alias("macd_hist"))


@query("feat_rsi_wilder", _ema_twin("d AS (SELECT symbol, date, CASE WHEN x IS NOT NULL THEN greatest(x, 0) END AS up, CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END AS down FROM (SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS x FROM bars))", smooth_sql("d", "up", 1 / 14, "g", 14), smooth_sql("d", "down", 1 / 14, "l", 14),
    body="SELECT symbol, date, round(100 - 100 / (1 + g.y / nullif(l.y, 0)), 6) AS rsi_14 FROM g JOIN l USING (symbol, date)"))
def feat_rsi_wilder(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).select("symbol", "date", (F.col("close") - w.lag(F.col("close"))).alias("d"))
    b = b.select("symbol", "date", F.when(F.col("d") > 0, F.col("d")).when(F.col("d").isNotNull(), 0.0).alias("up"), F.when(F.col("d") < 0, -F.col("d")).when(F.col("d").isNotNull(), 0.0).alias("down"))
    b = smoothed(b, {"g": ("up", 1 / 14, 14), "l": ("down", 1 / 14, 14)})
    return b.select("symbol", "date", r6(100 - safe_div(F.lit(100.0), 1 + safe_div(F.col("g"), F.col("l")))).alias("rsi_14"))


_TR = f"greatest(high - low, coalesce(abs(high - lag(close) OVER {_W})), 0), coalesce(abs(low - lag(close) OVER {_W})), 0))"


def _true_range(b: DataFrame) -> DataFrame:
    high, low, before = F.col("high"), F.col("low"), w.lag(F.col("close"))
    return b.withColumn("tr", F.greatest(high - low, F.abs(high - before), F.abs(low - before)))


@query("feat_atr", _ema_twin(f"t AS (SELECT symbol, date, close, {_TR} AS tr FROM bars)", smooth_sql("t", "tr", 1 / 14, "a", 14), body="SELECT symbol, date, round(a.y / close, 6) AS atr_14 FROM a JOIN t USING (symbol, date)"))
def feat_atr(spark, sf_dir) -> DataFrame:
    b = smoothed(_true_range(bars(spark, sf_dir)).select("symbol", "date", "close", "tr"), {"atr": ("tr", 1 / 14, 14)})
    return b.select("symbol", "date", r6(F.col("atr") / F.col("close")).alias("atr_14"))


@query("feat_adx", _ema_twin(
    f"t AS (SELECT symbol, date, {_TR} AS tr, high - lag(high) OVER {_W}) AS u, lag(low) OVER {_W}) - low AS d FROM bars)",
    "m AS (SELECT symbol, date, tr, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS p, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS n FROM t)",
    smooth_sql("m", "tr", 1 / 14, "a", 14), smooth_sql("m", "p", 1 / 14, "pp", 14), smooth_sql("m", "n", 1 / 14, "nn", 14),
    "di AS (SELECT symbol, date, 100 * pp.y / nullif(a.y, 0) AS up, 100 * nn.y / nullif(a.y, 0) AS down FROM a JOIN pp USING (symbol, date) JOIN nn USING (symbol, date))",
    "dx AS (SELECT symbol, date, up, down, 100 * abs(up - down) / nullif(up + down, 0) AS x FROM di)", smooth_sql("dx", "x", 1 / 14, "adx", 14),
    body="SELECT symbol, date, round(up, 6) AS plus_di, round(down, 6) AS minus_di, round(adx.y, 6) AS adx_14 FROM dx JOIN adx USING (symbol, date)"))
def feat_adx(spark, sf_dir) -> DataFrame:
    b = _true_range(bars(spark, sf_dir)).withColumn("u", F.col("high") - w.lag(F.col("high"))).withColumn("d", w.lag(F.col("low")) - F.col("low"))
    move = lambda a, c: F.when((F.col(a) > F.col(c)) & (F.col(a) > 0), F.col(a)).otherwise(0.0)
    b = smoothed(b.select("symbol", "date", "tr", move("u", "d").alias("p"), move("d", "u").alias("n")), {"a": ("tr", 1 / 14, 14), "pp": ("p", 1 / 14, 14), "nn": ("n", 1 / 14, 14)})
    b = b.select("symbol", "date", safe_div(100 * F.col("pp"), F.col("a")).alias("up"), safe_div(100 * F.col("nn"), F.col("a")).alias("down"))
    b = smoothed(b.withColumn("x", safe_div(100 * F.abs(F.col("up") - F.col("down")), F.col("up") + F.col("down"))), {"adx": ("x", 1 / 14, 14)})
    return b.select("symbol", "date", r6(F.col("up")).alias("plus_di"), r6(F.col("down")).alias("minus_di"), r6(F.col("adx")).alias("adx_14"))


_MKT = ("mkt", f"SELECT date, avg(r) AS m FROM (SELECT symbol, date, {_RET} AS r FROM bars) GROUP BY date")


@query("feat_rel_strength", twin(f"SELECT symbol, date, round(r1 - m1, 6) AS rs_1, round(r5 - m5, 6) AS rs_5 FROM a JOIN (SELECT date, m AS m1, CASE WHEN count(m) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5 THEN sum(m) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS m5 FROM mkt) USING (date)",
    ("a", f"SELECT symbol, date, {_RET} AS r1, ln(close / lag(close, 5) OVER {_W})) AS r5 FROM bars"), _MKT))
def feat_rel_strength(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).select("symbol", "date", w.log_return(F.col("close")).alias("r1"), w.log_return(F.col("close"), 5).alias("r5"))
    m = market_returns(b.select("symbol", "date", F.col("r1").alias("r")), span=5)
    return b.join(m, "date").select("symbol", "date", r6(F.col("r1") - F.col("m")).alias("rs_1"), r6(F.col("r5") - F.col("m_span")).alias("rs_5"))


@query("feat_rolling_zscore", twin(f"SELECT symbol, date, round((r - ({_roll('avg', 'r', 20, 10)})) / nullif({_roll('stddev_samp', 'r', 20, 10)}, 0), 6) AS z20, round(greatest(-4, least(4, (volume - ({_roll('avg', 'volume', 30, 10)})) / nullif({_roll('stddev_samp', 'volume', 30, 10)}, 0))), 6) AS z30_clipped FROM r", ("r", f"SELECT *, {_RET} AS r FROM bars")))
def feat_rolling_zscore(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("r", w.log_return(F.col("close")))
    z30 = w.zscore(F.col("volume"), 30, 10)
    return b.select("symbol", "date", r6(w.zscore(F.col("r"), 20, 10)).alias("z20"), r6(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z30))).alias("z30_clipped"))
